"""Test cases and sessions expanded from templates with slots, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Routes that a case may expect.
ROUTES = ("TOOL", "AGENT", "AMBIGUOUS", "ABSTAIN")
ID = r"^[a-z0-9][a-z0-9._-]*$"


def _turn(seed: str, template: Column, name: Column) -> Column:
    """A number by which the digits of a template's slot are turned."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), template, name), 256), 1, 7), 16, 10).cast("long")


def expanded(templates: DataFrame, slots: DataFrame, cases: Column, seed: str) -> DataFrame:
    """K30. The first `cases` combinations of slot values of each template, all different, in an order drawn by the seed: template columns,
    case_no from 1, args (map of slot to value) and query (the text with its {slots} filled).

    templates: template, text, ...; slots: template, slot, values (array). The product of the slots is never made: a case's number
    is read as digits in mixed radix, one digit a slot in the order of names, each turned by a seeded number and the digits before it,
    which maps numbers to combinations one to one. A template without slots has one case, one with an empty slot none.
    """
    s = slots.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("slot", "values"))).alias("_s"))
    t = templates.join(s, "template", "left")
    t = t.withColumn("_s", F.coalesce("_s", F.array().cast(s.schema["_s"].dataType)))
    sizes = F.aggregate("_s", F.lit(1).cast("long"), lambda n, x: n * F.size(x["values"]))
    t = t.withColumn("_n", F.least(F.greatest(cases.cast("long"), F.lit(0).cast("long")), sizes)).where("_n > 0")
    t = t.withColumn("case_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kind = "struct<rest: bigint, sum: bigint, out: array<struct<slot: string, value: string>>>"

    def digit(a: Column, x: Column) -> Column:
        size = F.size(x["values"]).cast("long")
        d = F.pmod(a["rest"], size)
        at = F.pmod(d + a["sum"] + _turn(seed, F.col("template"), x["slot"]), size).cast("int")
        one = F.struct(x["slot"].alias("slot"), F.get(x["values"], at).cast("string").alias("value"))
        return F.struct(F.floor(a["rest"] / size).alias("rest"), (a["sum"] + d).alias("sum"), F.concat(a["out"], F.array(one)).alias("out")).cast(kind)

    start = F.struct((F.col("case_no") - 1).alias("rest"), F.lit(0).cast("long").alias("sum"), F.expr("array()").alias("out")).cast(kind)
    t = t.withColumn("_a", F.aggregate("_s", start, digit)["out"])
    query = F.aggregate("_a", F.col("text"), lambda text, x: F.replace(text, F.concat(F.lit("{"), x["slot"], F.lit("}")), F.coalesce(x["value"], F.lit(""))))
    return t.withColumn("args", F.map_from_entries("_a")).withColumn("query", query).drop("_s", "_n", "_a")


def case_ids(cases: DataFrame) -> DataFrame:
    """K30. cases with case_id: the template and the number of two digits or more."""
    n = F.col("case_no").cast("string")
    return cases.withColumn("case_id", F.concat_ws("-", "template", F.when(F.col("case_no") < 10, F.concat(F.lit("0"), n)).otherwise(n)))


def sessions(cases: DataFrame, by: str, length: int) -> DataFrame:
    """K30. Cases of a column's value chained in the order of their numbers into sessions of `length` turns: session_id, turn_id, and
    a case_id of both; history, how many turns stand before it."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("case_no", "template")) - 1
    x = cases.withColumn("_n", n)
    sid = F.concat_ws("-", F.lit("sess"), F.lower(F.regexp_replace(by, "[^A-Za-z0-9]+", ".")), F.floor(F.col("_n") / length).cast("string"))
    x = x.withColumn("session_id", sid).withColumn("turn_id", (F.col("_n") % length + 1).cast("int"))
    return x.withColumn("case_id", F.concat_ws("-", "session_id", F.concat(F.lit("t"), F.col("turn_id").cast("string")))).withColumn("history", F.col("turn_id") - 1).drop("_n")


def violations(cases: DataFrame, capabilities: DataFrame) -> DataFrame:
    """K30. case_id and problem, one row for each rule that a case breaks. cases: case_id, query, route, capability, args (map), and
    turn_id, session_id or nulls; capabilities: capability, slots (array).

    A null id is a bad id; a chain whose turns are not 1, 2, 3, ... is broken at each turn that does not follow."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    w = Window.partitionBy("session_id").orderBy("turn_id", "case_id")
    x = cases.withColumn("_n", n).withColumn("_place", F.row_number().over(w))
    caps = capabilities.select(F.col("capability").alias("_cap"), F.col("slots").alias("_slots"))
    x = x.join(caps, x["capability"] == F.col("_cap"), "left")
    args = F.map_keys(F.coalesce("args", F.expr("cast(map() as map<string,string>)")))
    tool = F.col("route") == "TOOL"
    rules = {
        "bad id": ~F.coalesce(F.col("case_id").rlike(ID), F.lit(False)),
        "duplicate id": F.col("_n") > 1,
        "empty query": F.trim(F.coalesce("query", F.lit(""))) == "",
        "open slot": F.coalesce(F.col("query").rlike(r"\{[a-z_]+\}"), F.lit(False)),
        "unknown route": ~F.coalesce(F.col("route").isin(*ROUTES), F.lit(False)),
        "unknown capability": tool & F.col("_cap").isNull(),
        "stray argument": tool & F.col("_cap").isNotNull() & (F.size(F.array_except(args, "_slots")) > 0),
        "no arguments": tool & (F.size(args) == 0),
        "capability without tool": ~F.coalesce(tool, F.lit(False)) & F.col("capability").isNotNull(),
        "broken chain": F.col("session_id").isNotNull() & ~F.col("turn_id").eqNullSafe(F.col("_place")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return x.select("case_id", F.explode(found).alias("problem"))
