"""Property-graph operators over node and edge tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.curation import checkpointed


def edges_between(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """G4/J17. Distinct edges (src, dst, kind) whose ends are nodes, or whose dst is one of targets, where those are given. Repeats
    go last: rows of equal dst are together by then, so they are not shuffled for it."""
    to = nodes if targets is None else targets
    e = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(to.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.dropDuplicates(["src", "dst", "kind"])


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """G1/G2. Nodes reachable from each start (start, depth of first reach): start, node, depth. Cycles end, as only nodes
    not seen before go on, so there are as many levels as the longest of the shortest paths; each is checkpointed."""
    e = edges.select("src", "dst").distinct()
    front = checkpointed(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct())
    seen = front.withColumn("depth", F.lit(0))
    for depth in itertools.count(1):
        front = checkpointed(front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen.where("depth > 0")
        seen = seen.union(front.withColumn("depth", F.lit(depth)))


def gates(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """G5/G6/A18. Per claim: number of supports and contradicts, whether all its evidence is verified (no evidence fails), and the
    verdict. evidence: claim_id, kind, verified."""
    g = evidence.groupBy("claim_id").agg(F.count_if(F.col("kind") == "supports").alias("supports"), F.count_if(F.col("kind") == "contradicts").alias("contradicts"), F.bool_and("verified").alias("all_verified"))
    j = claims.join(g, "claim_id", "left")
    ok = F.coalesce("all_verified", F.lit(False))
    return j.select("claim_id", F.coalesce("supports", F.lit(0)).alias("supports"), F.coalesce("contradicts", F.lit(0)).alias("contradicts"), ok.alias("all_verified"), (ok & (F.coalesce("supports", F.lit(0)) > 0)).alias("passes"))


def fingerprints(items: DataFrame, key: str, item: str) -> DataFrame:
    """G7. A hash of each key's set of items, whatever their order or number: the sums of four 32-bit words of the items'
    hashes, which combine before the shuffle, so no key's items meet in one task; and the number of items."""
    h = F.sha2(F.col(item), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(4)]
    g = items.select(key, item).distinct().groupBy(key).agg(F.count("*").alias("_n"), *[w.alias(f"_w{i}") for i, w in enumerate(words)])
    return g.select(key, F.sha2(F.concat_ws("|", "_n", *[f"_w{i}" for i in range(4)]), 256).alias("fingerprint"))


def pending(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """M8. Keys and whether their fingerprint is new, changed or the same."""
    j = now.join(before.withColumnRenamed("fingerprint", "_old"), key, "left")
    return j.select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("fingerprint"), "changed").otherwise("same").alias("state"))


def pending_rule(claims: DataFrame) -> DataFrame:
    """G8. claims (claim_id, terminal, stored_fp, current_fp, gate_ok): whether a claim is to be verified again. A terminal
    gap never is; one never verified is; one whose gate fails is; else if its evidence changed."""
    p = F.when(F.col("terminal"), False).when(F.col("stored_fp").isNull(), True).when(~F.coalesce("gate_ok", F.lit(False)), True).otherwise(F.col("stored_fp") != F.col("current_fp"))
    return claims.select("claim_id", p.alias("pending"))


def packed_claims(claims: DataFrame, budget: int, most: int) -> DataFrame:
    """W13. Claims (project, claim_id, tokens) packed in order of their ids into chunks of at most `budget` tokens and `most`
    claims, a single larger claim by itself: project, claim_id, chunk. Greedy within a project, so a fold over its claims."""
    c = F.array_sort(F.collect_list(F.struct("claim_id", "tokens")))
    kind = "struct<chunk: int, used: bigint, n: int, out: array<int>>"

    def step(a, x):
        new = (a["n"] > 0) & ((a["used"] + x["tokens"] > budget) | (a["n"] >= most))
        chunk = a["chunk"] + new.cast("int")
        used = F.when(new, F.lit(0).cast("long")).otherwise(a["used"]) + x["tokens"]
        return F.struct(chunk.alias("chunk"), used.cast("long").alias("used"), (F.when(new, 0).otherwise(a["n"]) + 1).alias("n"), F.concat(a["out"], F.array(chunk)).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out")).cast(kind)
    g = claims.groupBy("project").agg(c.alias("c")).select("project", "c", F.aggregate("c", start, step)["out"].alias("out"))
    return g.select("project", F.explode(F.arrays_zip(F.col("c.claim_id").alias("claim_id"), F.col("out").alias("chunk"))).alias("x")).select("project", "x.claim_id", "x.chunk")


def usable_evidence(findings: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """G9. Findings (claim_id, source_id, item_id, verdict, text) that may be stored: their source is usable, the text is long
    enough and the verdict supports or contradicts; one row for each claim and item, the longest text first."""
    ok = findings.where(F.col("verdict").isin("supports", "contradicts") & (F.length("text") >= least)).join(sources.where("usable").select("source_id"), "source_id", "left_semi")
    w = Window.partitionBy("claim_id", "item_id").orderBy(F.desc(F.length("text")), "source_id", "text")
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def known_gaps(claims: DataFrame, evidence: DataFrame, first: int = 20) -> DataFrame:
    """G11/A19. One row: claims, how many have evidence, and the first ids of those that have and have not."""
    j = claims.select("claim_id").join(evidence.select("claim_id").distinct().withColumn("_e", F.lit(True)), "claim_id", "left")
    place = F.row_number().over(Window.partitionBy(F.col("_e").isNotNull()).orderBy("claim_id"))
    firsts = j.withColumn("_n", place).where(F.col("_n") <= first)  # cut per partition before the shuffle
    ids = firsts.agg(F.array_sort(F.collect_list(F.when(F.col("_e"), F.col("claim_id")))).alias("anchored_ids"), F.array_sort(F.collect_list(F.when(F.col("_e").isNull(), F.col("claim_id")))).alias("gap_ids"))
    return j.agg(F.count("*").alias("claims"), F.count("_e").alias("anchored")).crossJoin(ids)


def source_map(evidence: DataFrame) -> DataFrame:
    """G12. Each source with the claims and items that rest on it: source_id, claims, items."""
    return evidence.groupBy("source_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("item_id").alias("items"))


def marked(items: DataFrame) -> DataFrame:
    """Items of a batch (item_id, claim_id, findings) with _row (a number of their own), n (their findings) and the fingerprint of
    their set of findings, whatever its order; written once, for all batches that verify them."""
    marks = F.array_sort(F.array_distinct(F.transform("findings", lambda f: F.sha2(F.concat_ws("\x1f", f["source_id"].cast("string"), f["verdict"], f["text"]), 256))))
    n = F.coalesce(F.size("findings"), F.lit(0)).alias("n")
    return checkpointed(items.select(F.monotonically_increasing_id().alias("_row"), "item_id", "claim_id", "findings", n, F.sha2(F.array_join(marks, ","), 256).alias("fingerprint")))


def judged(items: DataFrame, claims: DataFrame, baseline: DataFrame) -> DataFrame:
    """_row, item_id, claim_id, fingerprint, status and reason of marked items, by the rules of verified_batch; findings are not read."""
    w = Window.partitionBy("item_id").orderBy("claim_id", "fingerprint")
    x = items.select("_row", "item_id", "claim_id", "n", "fingerprint").withColumn("_rn", F.when(F.col("item_id").isNotNull(), F.row_number().over(w)).otherwise(1))
    x = x.join(claims.select("claim_id", F.col("gate_ok").alias("_gate"), F.lit(True).alias("_known")), "claim_id", "left")
    x = x.join(baseline.select("claim_id", F.col("fingerprint").alias("_last")), "claim_id", "left")
    reason = (
        F.when(F.trim(F.coalesce("item_id", F.lit(""))) == "", "no item id")
        .when(F.col("_rn") > 1, "duplicate item id")
        .when(F.col("claim_id").isNull(), "no claim")
        .when(F.col("_known").isNull(), "unknown claim")
        .when(F.col("n") <= 0, "no findings")
    )
    same = F.coalesce(F.col("_gate"), F.lit(False)) & F.coalesce(F.col("_last") == F.col("fingerprint"), F.lit(False))
    status = F.when(reason.isNotNull(), "rejected").when(same, "skipped").otherwise("verified")
    return x.select("_row", "item_id", "claim_id", "fingerprint", status.alias("status"), reason.alias("reason"))


def verified_batch(items: DataFrame, claims: DataFrame, sources: DataFrame, baseline: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """G9/G10. A batch of verifications: results of all items (item_id, claim_id, status, fingerprint, reason), and the evidence rows that
    the accepted ones store (claim_id, source_id, verdict, text, and the first item that gave it).

    items: item_id, claim_id, findings (array of struct source_id, verdict, text); claims: claim_id, gate_ok; baseline: claim_id,
    fingerprint of its last verification; sources: source_id, usable. An item that breaks a rule is rejected by itself and the others go on: no id, an id twice
    (the first of equal ids by claim and findings counts), no claim or one unknown, no findings. An item whose claim passes its gate and whose
    findings have the fingerprint of the last verification is skipped. Of the findings of the others those are stored whose source is usable,
    whose text has `least` characters and whose verdict is clear; what is left out is counted in the reason. Items may be marked already.
    """
    m = items if "_row" in items.columns else marked(items)
    x = checkpointed(judged(m, claims, baseline))
    f = x.where("status = 'verified'").join(m.select("_row", "findings"), "_row").select("_row", "item_id", "claim_id", F.explode("findings").alias("f")).select("_row", "item_id", "claim_id", "f.*")
    f = f.join(sources.where("usable").select("source_id", F.lit(True).alias("_ok")), "source_id", "left")
    good = F.coalesce(F.col("_ok") & F.col("verdict").isin("supports", "contradicts") & (F.length("text") >= least), F.lit(False))
    left = f.groupBy("_row").agg(F.count_if(~good).alias("_left"))
    stored = f.where(good).groupBy("claim_id", "source_id", "verdict", "text").agg(F.min("item_id").alias("item_id"))
    results = x.join(left, "_row", "left").select("item_id", "claim_id", "status", F.when(F.col("status") != "rejected", F.col("fingerprint")).alias("fingerprint"), F.when((F.col("status") == "verified") & (F.col("_left") > 0), F.concat(F.col("_left").cast("string"), F.lit(" findings left out"))).otherwise(F.col("reason")).alias("reason"))
    return results, stored
