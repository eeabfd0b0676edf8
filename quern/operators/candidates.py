"""Labelled candidate records at a threshold, their cohorts, and why a routing decision failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECT = "REJECT"


def failure_cause(expected: Column, expected_id: Column, actual: Column, actual_id: Column, hard_negative: Column, scores: Column, admitted: Column, margin: float, near: float = 0.55) -> Column:
    """A25. Why a decision is wrong; null where it is right.

    scores: map of every capability that recall scored to its score; admitted: the capabilities that the selector was shown.
    Expected a tool: D it was not scored, or screened away with a score below `near`; A screened away with a score from `near` on; B a
    rival among the admitted comes within `margin` of it; C it was shown and not taken. Expected none: E a hard negative
    was certified, C another was, F neither.
    """
    tool, took = expected == "TOOL", F.coalesce(actual == "TOOL", F.lit(False))
    own = F.try_element_at(scores, expected_id)
    rivals = F.map_values(F.map_filter(scores, lambda k, v: (k != expected_id) & F.array_contains(admitted, k)))
    shown = F.coalesce(F.array_contains(admitted, expected_id), F.lit(False))
    missed = F.when(own.isNull(), "D").when(~shown, F.when(own >= near, "A").otherwise("D")).when(F.coalesce(F.array_max(rivals) - own < margin, F.lit(False)), "B").otherwise("C")
    right = (tool & took & expected_id.eqNullSafe(actual_id)) | (~tool & ~took)
    return F.when(right, None).when(tool, missed).when(took, F.when(hard_negative, "E").otherwise("C")).otherwise("F")


def candidate_records(queries: DataFrame, scores: DataFrame, threshold: float, k: int, seed: str) -> DataFrame:
    """K26. A record of every query (query_id, gold: null for no action, ...) at a threshold, from the best score of each
    capability (query_id, capability, score): retrieved (all from the threshold on, best first, ties by name), candidates (the first k), label
    (the gold capability, or REJECT) with label_reason and detail, gold_rank, options (candidates and REJECT in an order
    drawn for this row by the seed), gold_index and reject_index into them (from 0) and decision_state.

    A query's scores are as many as there are capabilities, so they are one array.
    """
    s = scores.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("capability").cast("string").alias("c")))).alias("_s"))
    gold = F.col("gold").cast("string")
    r = queries.join(s, "query_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast(s.schema["_s"].dataType)))
    r = r.withColumn("retrieved", F.transform(F.filter("_s", lambda x: -x["m"] >= threshold), lambda x: x["c"]))
    r = r.withColumn("candidates", F.slice("retrieved", 1, k)).withColumn("k", F.size("candidates"))
    place = F.when(gold.isNotNull(), F.array_position("retrieved", gold)).otherwise(0)
    r = r.withColumn("gold_rank", F.when(place > 0, place))
    found = F.coalesce(F.array_contains("candidates", gold), F.lit(False))
    reason = F.when(gold.isNull(), "no_action").when(F.col("k") == 0, "no_candidates").when(found, "gold_in_candidates").otherwise("gold_not_retrieved")
    detail = F.when(gold.isNull(), "source_no_action").when(F.col("k") == 0, "no_capability_above_threshold").when(found, f"gold_in_top{k}").when(F.col("gold_rank").isNull(), "gold_below_threshold").otherwise(f"gold_outside_top{k}")
    r = r.withColumn("label", F.when(found, gold).otherwise(REJECT)).withColumn("label_reason", reason).withColumn("detail", detail)
    drawn = F.array_sort(F.transform(F.concat("candidates", F.array(F.lit(REJECT))), lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"), c), 256).alias("h"), c.alias("c"))))
    r = r.withColumn("options", F.transform(drawn, lambda x: x["c"]))
    r = r.withColumn("gold_index", F.array_position("options", F.col("label")) - 1).withColumn("reject_index", F.array_position("options", F.lit(REJECT)) - 1)
    return r.withColumn("decision_state", F.when(F.col("k") == 0, "direct_reject").otherwise("choose")).drop("_s")


def cohort(records: DataFrame, by: list[str]) -> DataFrame:
    """A30/A31. Of each group of candidate_records and over all (nulls): rows, action_rows, mean_k, how many golds are among the retrieved, first,
    and in the first three, and how many rows have each reason."""
    act = F.col("gold").isNotNull()
    g = records.rollup(*by) if by else records.groupBy()
    out = g.agg(
        F.count("*").alias("rows"), F.count_if(act).alias("action_rows"), F.round(F.avg("k"), 6).alias("mean_k"),
        F.count_if(act & F.col("gold_rank").isNotNull()).alias("gold_in"), F.count_if(act & (F.col("gold_rank") == 1)).alias("gold_top1"), F.count_if(act & (F.col("gold_rank") <= 3)).alias("gold_top3"),
        *[F.count_if(F.col("label_reason") == x).alias(x) for x in ("gold_not_retrieved", "no_candidates", "no_action")],
    )
    return out.withColumn("gold_in_pct", F.round(F.when(F.col("action_rows") > 0, 100 * F.col("gold_in") / F.col("action_rows")), 6))


def k_distribution(records: DataFrame, by: str, most: int) -> DataFrame:
    """A30. How many rows of each group have k = 0, 1, ..., most candidates, with shares of the group; numbers that no row has count
    nought, as the counts are joined to their domain."""
    counts = records.groupBy(by, "k").agg(F.count("*").alias("n"))
    domain = counts.groupBy(by).agg(F.sum("n").alias("all")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most))))
    j = domain.join(counts.withColumnRenamed(by, "_by"), domain[by].eqNullSafe(F.col("_by")) & (domain["k"] == counts["k"]), "left")
    return j.select(domain[by], domain["k"], F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.col("all"), 6).alias("percent"))


def compared(low: DataFrame, high: DataFrame) -> DataFrame:
    """J20. The same queries at two thresholds: how many candidates each has, and which the higher threshold loses; a query that loses
    all of them is a row too."""
    a = low.select("query_id", F.col("retrieved").alias("low"))
    b = high.select("query_id", F.col("retrieved").alias("high"))
    return a.join(b, "query_id").select("query_id", F.size("low").alias("n_low"), F.size("high").alias("n_high"), F.array_join(F.array_sort(F.array_except("low", "high")), ",").alias("lost"))
