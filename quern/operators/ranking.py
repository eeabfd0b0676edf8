"""Ranked lists as data: fusion, recency, best of a key, parent expansion, top-k. Every order ends in a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query words that a pass over files looks for at once.
QUERIES_AT_ONCE = 512


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in an order, numbered from 1. Spark cuts each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """R1/A9. Reciprocal rank fusion of rows (query_id, ranking_id, rank from 0, id): each id once per query with its score,
    in order of score and then of first sight."""
    fused = rankings.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min(F.struct("ranking_id", "rank")).alias("first_seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", "id")
    return fused.withColumn("fused_rank", F.row_number().over(order)).select("query_id", "id", "score", "fused_rank", F.col("first_seen.ranking_id").alias("first_ranking"))


def recency(age_days: Column, scale: float = 30.0) -> Column:
    """R9. Weight 0.5 + 0.5 exp(-age / scale); 1 where the age is unknown, and ages below zero count as zero."""
    return F.when(age_days.isNull(), F.lit(1.0)).otherwise(F.lit(0.5) + F.lit(0.5) * F.exp(-F.greatest(age_days, F.lit(0.0)) / scale))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A8/W12/T11/J18. The first row of each key in an order."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def keep_first_fusion(hits: DataFrame, key: list[str], order: list[Column], per_source: str | None, limit_each: int, limit: int) -> DataFrame:
    """R28/R30/R32/T12. Hits of several sources: at most limit_each of each source, one of each key, at most limit in all."""
    if per_source:
        hits = top_k(hits, ["query_id", per_source], order, limit_each, "_each").drop("_each")
    return top_k(best_per_key(hits, ["query_id", *key], order), ["query_id"], order, limit, "place")


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """R14/J2. Hits (query_id, rank, id, score) with parents (id, parent_id): a parent stands at the place and score of
    its first leaf; a leaf without a parent passes through."""
    joined = hits.join(parents.select("id", "parent_id"), "id", "left").withColumn("node_id", F.coalesce("parent_id", "id"))
    kept = best_per_key(joined, ["query_id", "node_id"], [F.col("rank"), F.col("id")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return kept.withColumn("place", place).select("query_id", "place", "node_id", "score", F.col("parent_id").isNotNull().alias("expanded"))


def support_rank(hits: DataFrame) -> DataFrame:
    """R35. Candidates with the best score, the number of supporting hits and their best hit, by score and id."""
    g = hits.groupBy("query_id", "candidate").agg(F.max("score").alias("score"), F.count("*").alias("n_support"), F.max_by("id", F.struct(F.col("score"), -F.col("id"))).alias("top_id"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate")))


def memory_fusion(rankings: DataFrame, ages: DataFrame, k: int) -> DataFrame:
    """R9. Rankings (query_id, ranking_id, rank from 0, id) fused by reciprocal rank, weighted by the recency of ages (id, age_days;
    null where unknown), sorted anew and cut to k. With one channel empty the other's order stays but for recency."""
    fused = rrf(rankings).join(ages, "id", "left")
    score = F.round(F.col("score") * recency(F.col("age_days")), 9)
    seen = rankings.groupBy("query_id", "id").agg(F.min(F.struct("ranking_id", "rank")).alias("first_seen"))
    w = fused.select("query_id", "id", score.alias("s")).join(seen, ["query_id", "id"])
    return top_k(w, ["query_id"], [F.desc("s"), F.col("first_seen"), F.col("id")], k).select("query_id", "id", F.round("s", 6).alias("score"), "rank")


def file_memory(files: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """R12. Files (id, name, description, content, importance, status) of each query (query): 3 for the name, 2 for the description
    and 1 for the content that holds it, times importance; superseded ones are left out, equal scores by id.

    A substring has no key to join on. The queries are a stated set of words and phrases: every file is read once against a
    block of them, and only the queries that it holds are multiplied out.
    """
    holds = lambda c, q: F.contains(F.lower(c), q).cast("int")
    active = files.where("status <> 'superseded'").select("id", "name", "description", "content", "importance")
    asked = [r["query"] for r in queries.select("query").distinct().toLocalIterator()]
    out = None
    for at in range(0, max(len(asked), 1), QUERIES_AT_ONCE):
        block = F.array(*[F.lit(q) for q in asked[at : at + QUERIES_AT_ONCE]]).cast("array<string>")
        scored = F.transform(block, lambda q: F.struct(q.alias("query"), ((3 * holds("name", F.lower(q)) + 2 * holds("description", F.lower(q)) + holds("content", F.lower(q))) * F.col("importance")).alias("score")))
        part = active.select("id", F.explode(F.filter(scored, lambda x: x["score"] > 0)).alias("x")).select("id", "x.query", "x.score")
        out = part if out is None else out.union(part)
    return top_k(out, ["query"], [F.desc("score"), F.col("id")], k).select("query", "id", F.col("score").cast("int").alias("score"), "rank")


def host_quota(hits: DataFrame, order: str, k: int) -> DataFrame:
    """R30. Hits (query_id, host, title): one of each (host, title), at most ceil(k / hosts of the query) of a host, k in all."""
    quota = hits.groupBy("query_id").agg(F.ceil(F.lit(k) / F.countDistinct("host")).alias("quota"))
    one = best_per_key(hits, ["query_id", "host", "title"], [F.col(order)])
    n = F.row_number().over(Window.partitionBy("query_id", "host").orderBy(order))
    held = one.withColumn("_n", n).join(quota, "query_id").where(F.col("_n") <= F.col("quota"))
    return top_k(held, ["query_id"], [F.col(order)], k, "place")


def resolved_citations(answers: DataFrame, blocks: DataFrame, tag: str = r"\[(b[0-9]+)\]") -> DataFrame:
    """R37. Tags of answers (answer_id, answer) in order of their first place, each once, with the block (tag, block_id) they
    name or known = false."""
    t = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(tag), F.lit(1))).alias("pos", "tag"))
    first = t.groupBy("answer_id", "tag").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))
    return first.withColumn("place", place).join(blocks, "tag", "left").select("answer_id", "tag", "place", "block_id", F.col("block_id").isNotNull().alias("known"))


def marker_hits(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """R38. (id, claim) for each text (id, text) that holds a marker (claim, marker of three or more tokens) as tokens; of several
    claims of one marker the first wins. Three-token sequences are the join key, and a marker stands where all of its sequences do, one
    after the other; so no text travels with its sequences."""
    from quern.operators.recall import tokens

    def grams(rows: DataFrame, key: list[str], place: str) -> DataFrame:
        of = F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.xxhash64(F.get("t", i - 1), F.get("t", i), F.get("t", i + 1)))
        return rows.where("size(t) >= 3").select(*key, F.posexplode(of).alias(place, "g"))

    m = markers.groupBy("marker").agg(F.min("claim").alias("claim")).select("claim", "marker", F.explode(F.array(F.split("marker", " "))).alias("t"))
    m = grams(m.withColumn("need", F.size("t") - 2), ["claim", "marker", "need"], "off")
    d = grams(texts.select("id", F.explode(F.array(tokens(F.col("text")))).alias("t")), ["id"], "pos")
    j = d.join(m, "g").groupBy("id", "claim", "marker", "need", (F.col("pos") - F.col("off")).alias("begin")).agg(F.count("*").alias("n"))
    return j.where("n = need").select("id", "claim").distinct()
