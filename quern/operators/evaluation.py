"""Ranking and classification metrics over whole evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.curation import checkpointed


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """A quotient, 0 where the divisor is 0."""
    return F.round(F.when(b == 0, 0.0).otherwise(a / b), digits)


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """R33. Per query: recall@k, precision@k (over k) and reciprocal rank on the deduplicated list. hits: query_id, rank, item;
    relevant: query_id, item. Queries without a relevant item are left out."""
    rel = relevant.distinct()
    return _metrics(rel.groupBy("query_id").agg(F.count("*").alias("n_rel")), _places(hits, k).join(rel, ["query_id", "item"]), k)


def class_metrics(hits: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """R33 where relevant are all items that hold a row of the query's class but the query itself. hits as in ranking_metrics; rows: id
    (unique), item, cls; queries: query_id, the rows that ask. Items are counted by class, so no query meets all rows of its class."""
    held = rows.groupBy("cls", "item").agg(F.count("*").alias("_in"))
    sizes = held.groupBy("cls").agg(F.count("*").alias("_items"))
    q = queries.join(rows.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "cls", F.col("item").alias("_own"))
    alone = q.join(held.where("_in = 1").select("cls", F.col("item").alias("_own"), F.lit(1).alias("_alone")), ["cls", "_own"], "left")
    total = alone.join(sizes, "cls").select("query_id", (F.col("_items") - F.coalesce("_alone", F.lit(0))).alias("n_rel")).where("n_rel > 0")
    found = _places(hits, k).join(q, "query_id").join(held, ["cls", "item"]).where((F.col("item") != F.col("_own")) | (F.col("_in") > 1))
    return _metrics(total, found, k)


def _places(hits: DataFrame, k: int) -> DataFrame:
    d = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))).where(F.col("place") <= k)


def _metrics(total: DataFrame, right: DataFrame, k: int) -> DataFrame:
    found = right.groupBy("query_id").agg(F.count("*").alias("hit"), F.min("place").alias("first"))
    j = total.join(found, "query_id", "left")
    hit = F.coalesce("hit", F.lit(0))
    return j.select("query_id", F.round(hit / F.col("n_rel"), 6).alias("recall"), F.round(hit / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def confusion(rows: DataFrame, gold: Column, pred: Column, by: list[str] = ()) -> DataFrame:
    """A12/A13/A15. tp, fp, fn, tn with precision, recall, F1 and false-positive rate, by groups and over all (grouping sets)."""
    r = rows.select(*by, gold.alias("_g"), pred.alias("_p"))
    aggs = [F.count_if(F.col("_g") & F.col("_p")).alias("tp"), F.count_if(~F.col("_g") & F.col("_p")).alias("fp"), F.count_if(F.col("_g") & ~F.col("_p")).alias("fn"), F.count_if(~F.col("_g") & ~F.col("_p")).alias("tn")]
    c = r.rollup(*by).agg(*aggs) if by else r.agg(*aggs)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def threshold_sweep(hits: DataFrame, thresholds: list[float]) -> DataFrame:
    """K19. Each threshold replayed on the same scored best hits (query_id, score, correct): accepted, right, precision.

    A row is multiplied by the number of thresholds in place, so nothing is shuffled but one row a threshold and task.
    """
    t = hits.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    ok = F.col("score") >= F.col("threshold")
    return t.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("correct")).alias("right")).withColumn("precision", ratio(F.col("right"), F.col("accepted")))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int) -> DataFrame:
    """A26. Expected calibration error over equal-width bins."""
    b = rows.withColumn("_bin", F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)))
    g = b.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def _ranked_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's distinct values with how many rows they and all smaller ones hold (_upto) and all hold (_n).

    Equal values are counted before the shuffle. Values are then range-partitioned, so a key of many values is spread: a
    partition adds up its own rows, and what stands before it comes from one small row for each key and partition.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    c = c.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id())
    c = checkpointed(c)
    parts = c.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_p")
    parts = parts.withColumn("_before", F.sum("_s").over(w) - F.col("_s")).withColumn("_n", F.sum("_s").over(Window.partitionBy(*keys)))
    within = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("_w", within).join(parts.select(*keys, "_p", "_before", "_n"), [*keys, "_p"]).select(*keys, value, "_c", (F.col("_before") + F.col("_w")).alias("_upto"), "_n")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """A16. The value at the half-even rounded place q * (n - 1) of each key's sorted values."""
    place = F.bround(F.lit(q) * (F.col("_n") - 1))
    return _ranked_counts(rows, keys, value).where((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)).select(*keys, F.col(value).alias("value"))


def interpolated(rows: DataFrame, keys: list[str], value: str, quantiles: list[float], digits: int = 6) -> DataFrame:
    """A3. Interpolated quantiles p<100 q> of each key's values."""
    r = _ranked_counts(rows, keys, value).withColumn("q", F.explode(F.array(*[F.lit(x) for x in quantiles])))
    at = F.col("q") * (F.col("_n") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
    g = r.where(holds(low) | holds(high)).groupBy(*keys, "q").agg(F.max(F.when(holds(low), F.col(value))).alias("a"), F.max(F.when(holds(high), F.col(value))).alias("b"), F.max(at - low).alias("f"))
    v = F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"), digits)
    return g.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == x, v)).alias(f"p{round(x * 100)}") for x in quantiles])


def graded(rows: DataFrame) -> DataFrame:
    """K20. Rows (expected, expected_id, actual, actual_id; routes TOOL, AGENT, ...) with the grades exact (TP, FP, FN, TN, or FP+FN
    where the wrong tool is taken) and binary (by route alone; null where the expected route is neither TOOL nor AGENT)."""
    et, at = F.col("expected") == "TOOL", F.col("actual") == "TOOL"
    exact = F.when(et & at, F.when(F.col("expected_id") == F.col("actual_id"), "TP").otherwise("FP+FN")).when(at, "FP").when(et, "FN").otherwise("TN")
    binary = F.when(F.col("expected").isin("TOOL", "AGENT"), F.when(at, F.when(et, "TP").otherwise("FP")).otherwise(F.when(et, "FN").otherwise("TN")))
    return rows.withColumn("exact", exact).withColumn("binary", binary)


def scored_arguments(rows: DataFrame) -> DataFrame:
    """K17. Rows (id, capability, predicted, gold, pred: map<string, string>, slots, required: arrays) with exact_match,
    fields_considered, field_hits, required_total, required_present, required_correct and illegal (keys outside the slots)."""
    within = lambda m: F.map_filter(m, lambda k, v: F.array_contains("slots", k))
    r = rows.withColumn("g", within("gold")).withColumn("p", within("pred"))
    same = lambda k: F.element_at("g", k).eqNullSafe(F.element_at("p", k))
    keys = F.array_union(F.map_keys("g"), F.map_keys("p"))
    name_ok = F.col("predicted").eqNullSafe(F.col("capability"))
    hits = F.size(F.filter(keys, same))
    return r.select("id", "capability", (name_ok & (hits == F.size(keys))).alias("exact_match"), F.size(keys).alias("fields_considered"), hits.alias("field_hits"), F.size("required").alias("required_total"), F.size(F.filter("required", lambda k: F.map_contains_key("p", k))).alias("required_present"), F.size(F.filter("required", same)).alias("required_correct"), F.array_sort(F.filter(F.map_keys("pred"), lambda k: ~F.array_contains("slots", k))).alias("illegal"))


def argument_report(scored: DataFrame, digits: int = 4) -> DataFrame:
    """K17/K18/A11. Micro ratios of scored_arguments by capability and over all (capability null)."""
    s = lambda c: F.sum(c)
    g = scored.rollup("capability").agg(F.count("*").alias("samples"), s(F.col("exact_match").cast("int")).alias("e"), s("field_hits").alias("h"), s("fields_considered").alias("c"), s("required_total").alias("t"), s("required_present").alias("rp"), s("required_correct").alias("rc"), F.count_if(F.size("illegal") > 0).alias("i"), s(F.size("illegal")).alias("illegal_keys_total"))
    return g.select("capability", "samples", ratio(F.col("e"), F.col("samples"), digits).alias("exact_match"), ratio(F.col("h"), F.col("c"), digits).alias("field_accuracy"), F.round(1 - F.when(F.col("t") == 0, 0.0).otherwise(F.col("rp") / F.col("t")), digits).alias("required_missing_rate"), ratio(F.col("rc"), F.col("t"), digits).alias("required_accuracy"), ratio(F.col("i"), F.col("samples"), digits).alias("illegal_slot_rate"), "illegal_keys_total")
