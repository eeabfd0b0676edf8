"""Curation and graph queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import curation, evaluation, graph
from quern.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}
BARE = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def exact_dedup(spark, d):
    """Groups of documents of equal letters and digits."""
    return curation.exact_groups(_docs(spark, d), T.bare(F.col("text")))


ORACLE_SQL["exact_dedup"] = f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY k) AS keep, count(*) OVER (PARTITION BY k) AS size FROM (SELECT doc_id, {BARE} AS k FROM documents)"


def _lines(spark, d):
    """All distinct lines of documents; the md5 of the line is its id."""
    l = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").distinct()
    return l.select(F.md5("text").alias("id"), "text")


def near_dup_pairs(spark, d):
    """Distinct lines whose sets of character four-grams have a Jaccard similarity of at least 0.8; lines of
    equal sets are represented by the least. (All lines against all are too much for SQL; a test compares brute force.)"""
    return curation.similar_texts(curation.distinct_sets(_lines(spark, d), 4)[0], 4, 800)


def dup_components(spark, d):
    """Components of all lines over those pairs and equal sets."""
    reps, members = curation.distinct_sets(_lines(spark, d), 4)
    links = curation.similar_texts(reps, 4, 800).select("a", "b").union(members.where("id <> rep").select("rep", "id"))
    return curation.connected(links)


def cluster_split(spark, d):
    """Documents dealt to splits by the hash of their family, 80, 10 and 10 per cent."""
    g = curation.exact_groups(_docs(spark, d), T.bare(F.col("text")))
    return g.select("id", "keep", curation.split_of(F.col("keep"), {"train": 80, "dev": 10, "test": 10}).alias("split"))


_SPLIT = "CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' WHEN h < 100 THEN 'test' END"
ORACLE_SQL["cluster_split"] = f"SELECT id, keep, {_SPLIT} AS split FROM (SELECT *, ('0x' || sha256(keep::VARCHAR)[1:8])::BIGINT % 100 AS h FROM ({ORACLE_SQL['exact_dedup']}))"


def split_leakage(spark, d):
    """K6, K8, U4, Q14: how often a normal text is in several splits when rows are dealt by id alone."""
    r = _docs(spark, d).select(F.sha2(T.bare(F.col("text")), 256).alias("k"), curation.split_of(F.col("id"), {"train": 80, "dev": 10, "test": 10}).alias("split"))
    return curation.leakage(r, "k", "split")


ORACLE_SQL["split_leakage"] = f"SELECT count(*) FILTER (n > 1) AS leaked_keys, coalesce(sum(n - 1), 0)::BIGINT AS leaks FROM (SELECT k, count(DISTINCT {_SPLIT}) AS n FROM (SELECT {BARE} AS k, ('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 100 AS h FROM documents) GROUP BY 1)"


def benchmark_contamination(spark, d):
    """K7, U4: documents that share an eight-word sequence with a benchmark item, by hashed n-grams; an item of fewer words is
    looked for whole. Only the benchmark's n-grams are looked for."""
    def words(rows, key):
        # words are hashed once; explode of one array keeps that from being done anew for every n-gram
        return rows.select(key, F.explode(F.array(F.transform(F.split(T.normalized(F.col("text")), " "), lambda x: F.xxhash64(x)))).alias("w"))

    def ngrams(rows, key, n):
        return rows.where(F.size("w") >= n).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(*[F.get("w", i + (j - 1)) for j in range(n)])))).alias("g"))

    items = words(table(spark, d, "benchmark").where("trim(text) <> ''"), "item_id")
    docs = words(table(spark, d, "documents"), "doc_id")
    seeds, grams = ngrams(items, "item_id", 8), ngrams(docs, "doc_id", 8)
    found = grams.join(seeds, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    short = items.where(F.size("w") < 8).withColumn("n", F.size("w"))
    sizes = [r["n"] for r in short.select("n").distinct().collect()]  # seven at most
    for n in sizes:
        s = ngrams(short.where(F.col("n") == n), "item_id", n)
        found = found.union(ngrams(docs, "doc_id", n).join(s, "g").groupBy("doc_id", "item_id").agg(F.lit(1).cast("long").alias("shared")))
    return found


_NG = r"list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))"
_W = r"string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ')"
ORACLE_SQL["benchmark_contamination"] = f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark WHERE trim(text) <> ''), x AS (SELECT doc_id, {_W} AS w FROM documents),
  s AS (SELECT item_id, unnest({_NG}) AS g FROM b), t AS (SELECT doc_id, unnest({_NG}) AS g FROM x)
  SELECT doc_id, item_id, count(*) AS shared FROM s JOIN t USING (g) GROUP BY ALL
  UNION ALL SELECT doc_id, item_id, 1 FROM x JOIN b ON len(b.w) < 8 AND contains(' ' || array_to_string(x.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')"""


def corpus_conflicts(spark, d):
    """Lines that several sources own."""
    l = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return curation.conflicts(l, F.lower(F.trim("line")), "source").select(F.md5("phrase").alias("phrase"), "owners", "n")


ORACLE_SQL["corpus_conflicts"] = "SELECT md5(k) AS phrase, count(DISTINCT source) AS owners, count(*) AS n FROM (SELECT source, lower(trim(unnest(string_split(text, chr(10))))) AS k FROM documents) GROUP BY k HAVING count(DISTINCT source) > 1"


def row_eligibility(spark, d):
    """The first reason that excludes a document; every 50th document is held out."""
    r = _docs(spark, d)
    return curation.eligibility(r.where("id % 50 <> 0").select("id", "text"), r.where("id % 50 = 0").select("id", "text"), T.bare(F.col("text")))


ORACLE_SQL["row_eligibility"] = f"""WITH r AS (SELECT doc_id AS id, {BARE} AS k FROM documents) SELECT id, CASE WHEN k = '' THEN 'empty' WHEN k IN (SELECT k FROM r WHERE id % 50 = 0) THEN 'held_out' WHEN row_number() OVER (PARTITION BY k ORDER BY id) > 1 THEN 'duplicate' ELSE 'eligible' END AS status FROM r WHERE id % 50 <> 0"""


def calibration_sample(spark, d):
    """Five documents of each language and source in seeded hash order (a sampling operator)."""
    return curation.sampled(_docs(spark, d), ["lang", "source"], "id", 5, "seed-1").select("id", "lang", "source", "place")


ORACLE_SQL["calibration_sample"] = "SELECT * FROM (SELECT doc_id AS id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('seed-1|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5"


def corpus_fingerprint(spark, d):
    """G7, hashes, A6: an order-free fingerprint of each source's documents."""
    items = _docs(spark, d).select("source", F.concat_ws("|", "id", F.md5("text")).alias("item"))
    return graph.fingerprints(items, "source", "item")


def _fp(items: str) -> str:
    """SQL of graph.fingerprints over a query with source and item."""
    words = ", ".join(f"sum(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)" for i in range(4))
    return f"SELECT source, sha256(concat_ws('|', count(*), {words})) AS fingerprint FROM (SELECT source, sha256(item) AS h FROM (SELECT DISTINCT source, item FROM ({items}))) GROUP BY 1"


_ITEMS = "SELECT source, doc_id || '|' || md5({t}) AS item FROM documents {w}"
ORACLE_SQL["corpus_fingerprint"] = _fp(_ITEMS.format(t="text", w=""))


def pending_sources(spark, d):
    """Sources whose documents changed since a state that lacks src3, after those below 500 were put in upper case."""
    item = lambda x: x.select("source", F.concat_ws("|", "id", F.md5("text")).alias("item"))
    r = _docs(spark, d)
    now = graph.fingerprints(item(r.withColumn("text", F.when((F.col("id") < 500) & (F.col("source") != "src5"), F.upper("text")).otherwise(F.col("text")))), "source", "item")
    return graph.pending(now, graph.fingerprints(item(r.where("source <> 'src3'")), "source", "item"), "source")


_NOW = _fp(_ITEMS.format(t="CASE WHEN doc_id < 500 AND source <> 'src5' THEN upper(text) ELSE text END", w=""))
ORACLE_SQL["pending_sources"] = f"SELECT source, CASE WHEN o.fingerprint IS NULL THEN 'new' WHEN o.fingerprint <> n.fingerprint THEN 'changed' ELSE 'same' END AS state FROM ({_NOW}) n LEFT JOIN ({_fp(_ITEMS.format(t='text', w=chr(87) + 'HERE source <> ' + repr('src3')))}) o USING (source)"


def _edges(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return n.union(c).union(o)


_EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def lineage_closure(spark, d):
    """What depends on each region and on every nation, by depth."""
    starts = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.closure(_edges(spark, d), starts).groupBy("start", "depth").agg(F.count("*").alias("n"))


ORACLE_SQL["lineage_closure"] = f"WITH RECURSIVE {_EDGES}, t AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT start, e.dst, depth + 1 FROM t JOIN e ON e.src = t.node) SELECT start, depth, count(*) AS n FROM t WHERE depth > 0 GROUP BY ALL"


def cascade_status(spark, d):
    """Nodes below an invalid nation (those of Asia and an unknown one) become stale."""
    starts = table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n"), "n_nationkey").alias("id")).union(spark.createDataFrame([("n999",)], "id string"))
    stale = graph.closure(_edges(spark, d), starts).select("node").distinct()
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), "o_orderstatus")
    return orders.join(stale.withColumn("stale", F.lit(True)), "node", "left").groupBy("o_orderstatus", F.coalesce("stale", F.lit(False)).alias("stale")).agg(F.count("*").alias("n"))


ORACLE_SQL["cascade_status"] = "SELECT o_orderstatus, coalesce(c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), false) AS stale, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


def gate_checks(spark, d):
    """Orders as claims, lines as evidence; a claim without evidence fails."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("kind"), (F.col("l_quantity") > 5).alias("verified"))
    return graph.gates(table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id")), l)


ORACLE_SQL["gate_checks"] = """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS s, count(*) FILTER (l_returnflag = 'R') AS c, bool_and(l_quantity > 5) AS v FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS claim_id, coalesce(s, 0) AS supports, coalesce(c, 0) AS contradicts, coalesce(v, false) AS all_verified, coalesce(v, false) AND coalesce(s, 0) > 0 AS passes FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""


def label_quality(spark, d):
    """A length rule as a predictor of the quality label, by language and over all."""
    r = table(spark, d, "labels").join(_docs(spark, d), F.col("doc_id") == F.col("id"))
    return evaluation.confusion(r, F.col("quality") == 1, F.col("n_chars") >= 500, ["lang"])


_Q = "count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn, count(*) FILTER (quality <> 1 AND n_chars < 500) AS tn"
ORACLE_SQL["label_quality"] = f"""SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr FROM (SELECT lang, {_Q} FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang))"""

for _f in (exact_dedup, near_dup_pairs, dup_components, cluster_split, split_leakage, benchmark_contamination, corpus_conflicts, row_eligibility, calibration_sample, corpus_fingerprint, pending_sources, lineage_closure, cascade_status, gate_checks, label_quality):
    QUERIES[_f.__name__] = _f
