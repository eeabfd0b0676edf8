"""Order-dependent operators over turns and events: windows partitioned by their conversation or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_rank(role: Column) -> Column:
    """W3. user, tool, assistant, others."""
    return F.when(role == "user", 0).when(role == "tool", 1).when(role == "assistant", 2).otherwise(3)


def qa_pairs(turns: DataFrame) -> DataFrame:
    """W4. Each user turn opens a pair; assistant texts until the next one are its answer, joined by line feeds. Turns
    before a conversation's first user turn belong to no pair."""
    w = Window.partitionBy("conv_id").orderBy("turn", role_rank(F.col("role")), "text").rowsBetween(Window.unboundedPreceding, 0)
    p = turns.withColumn("pair", F.sum((F.col("role") == "user").cast("int")).over(w)).where("pair > 0")
    texts = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"])
    return p.groupBy("conv_id", "pair").agg(F.array_join(texts("user"), "\n").alias("question"), F.array_join(texts("assistant"), "\n").alias("answer"), F.count("*").alias("n_turns"))


def pair_spans(turns: DataFrame) -> DataFrame:
    """W5. Start turn of each pair and the next pair's start, or one past the last turn."""
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.where("role = 'user'").withColumn("next", F.lead("turn").over(w)).join(ends, "conv_id").select("conv_id", F.col("turn").alias("begin"), F.coalesce("next", "n").alias("end"))


def streaks(rows: DataFrame, keys: list[str], value: str, order: list[str], least: int) -> DataFrame:
    """W8. Runs of at least `least` equal values in a row within each key (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    both = Window.partitionBy(*keys, value).orderBy(*order)
    g = rows.withColumn("_n", F.row_number().over(w)).withColumn("_island", F.col("_n") - F.row_number().over(both))
    return g.groupBy(*keys, value, "_island").agg(F.min("_n").alias("first_place"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_island")


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """W9/W10. The prefix of each key whose sizes add up to at most the budget; a key's first row always stays. order must
    end in a key that is unique within keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("used", F.sum(size).over(w)).withColumn("_n", n).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def split_tail(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """W11. Marks the first `keep` rows of each key in an order, newest first, as tail, the others as overflow."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("part", F.when(n <= keep, "tail").otherwise("overflow"))


def keyset_page(rows: DataFrame, time: str, key: str, before: tuple | None, limit: int) -> DataFrame:
    """T5/T6/P16. The newest `limit` rows strictly before a cursor (time, key), and whether there are more.

    One row more than the page is read; a page never repeats or skips a row of equal time.
    """
    if before is not None:
        rows = rows.where(F.struct(time, key) < F.struct(F.lit(before[0]).cast(rows.schema[time].dataType), F.lit(before[1]).cast(rows.schema[key].dataType)))
    page = rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)
    w = Window.orderBy(F.desc(time), F.desc(key))  # over limit + 1 rows
    return page.withColumn("place", F.row_number().over(w)).withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """W7. The last known value before each row, within its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def history_page(messages: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """T6. A page of a transcript (created_at, turn_rank, id, ...): the newest `limit` messages before a cursor (created_at, turn_rank, id), newest
    first, with place, has_more and the cursor to the next page.

    The cut is made in the order of display: of a group of equal times that does not fit, the page takes those that are
    displayed latest, and the next page begins inside the group, so nothing is skipped or repeated however large the group is.
    """
    key = ["created_at", "turn_rank", "id"]
    if before is not None:
        at = [F.lit(v).cast(messages.schema[c].dataType) for v, c in zip(before, key)]
        older = F.col("created_at") < at[0]
        same = (F.col("created_at") == at[0]) & ((F.col("turn_rank") < at[1]) | ((F.col("turn_rank") == at[1]) & (F.col("id") < at[2])))
        messages = messages.where(older | same)  # the first test reaches the scan
    page = messages.orderBy(*[F.desc(c) for c in key]).limit(limit + 1)
    w = Window.orderBy(*[F.desc(c) for c in key])  # over limit + 1 rows
    page = page.withColumn("place", F.row_number().over(w)).withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)
    return page.withColumn("cursor", F.when(F.col("has_more"), F.min(F.struct(*key)).over(Window.partitionBy())))


def first_match(messages: DataFrame, pattern: str) -> DataFrame:
    """W2. The earliest message of each session whose text holds the pattern, whatever its case: session_id, id, created_at and a
    snippet. Sessions without one have no row; the least of each session is found before the shuffle."""
    hit = messages.where(F.contains(F.lower("text"), F.lower(F.lit(pattern))))
    at = F.position(F.lower(F.lit(pattern)), F.lower(F.col("text")))
    first = hit.select("session_id", F.struct("created_at", "id", F.substring("text", F.greatest(at - 20, F.lit(1)), F.lit(len(pattern) + 40)).alias("snippet")).alias("x"))
    return first.groupBy("session_id").agg(F.min("x").alias("x")).select("session_id", "x.id", "x.created_at", "x.snippet")
