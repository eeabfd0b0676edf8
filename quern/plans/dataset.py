"""Queries that build and grade datasets: links, splits, samples, scores, gates and backfills, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import candidates, chunking, curation, evaluation, graph, recall
from quern.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def _docs(spark, d):
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def term_sentences(spark, d):
    """Sentences of documents that hold a term as a word, whatever its case. Terms are the words of part names and of benchmark items; the
    word is the join key, so no term is tried against all sentences."""
    terms = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).union(table(spark, d, "benchmark").select(F.explode(recall.tokens(F.col("text"))))).where("term rlike '^[a-z0-9]+$'").distinct()
    s = chunking.sentences(_docs(spark, d), 5)
    words = s.select("id", "seq", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("unit"), F.lit(r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count("*").alias("sentences"), F.countDistinct("id").alias("documents"), F.min("id").alias("first"))


_SENT = r"SELECT id, pos, u FROM (SELECT doc_id AS id, unnest(us) AS u, generate_subscripts(us, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(31), 'g'), '\n', chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: length(x) >= 5) AS us FROM documents))"
ORACLE_SQL["term_sentences"] = rf"""WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION SELECT unnest(regexp_extract_all(lower(text), '{recall.TOKEN}')) FROM benchmark) WHERE regexp_matches(term, '^[a-z0-9]+$')),
  w AS (SELECT DISTINCT id, pos, unnest(regexp_extract_all(lower(u), '[\p{{L}}\p{{N}}_]+')) AS term FROM ({_SENT})) SELECT term, count(*) AS sentences, count(DISTINCT id) AS documents, min(id) AS first FROM w JOIN t USING (term) GROUP BY 1"""


def _samples(spark, d):
    """Events as predicted calls: the JSON property is a slot, gold and predicted values differ by arithmetic on ids."""
    e = table(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    v = lambda n: F.when(F.col("event_id") % n == 0, "other").otherwise(k)
    gold = F.map_from_arrays(F.array(F.lit("k"), F.lit("user"), F.lit("pages")), F.array(k, F.col("user_id").cast("string"), F.lit("1,3-5")))
    pred = F.map_concat(F.map_from_arrays(F.array(F.lit("k"), F.lit("pages")), F.array(v(4), F.when(F.col("event_id") % 6 == 0, "3-5,1").otherwise("1,3"))), F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("stray"), F.lit("x"))))
    name = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.col("event_type"))
    pages = lambda m: F.map_zip_with(m, m, lambda key, a, b: F.when(key == "pages", F.array_join(T.pages_of(a), ",")).otherwise(a))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("capability"), name.alias("predicted"), pages(gold).alias("gold"), pages(pred).alias("pred"), F.array(F.lit("k"), F.lit("user"), F.lit("pages")).alias("slots"), F.array(F.lit("k"), F.lit("user")).alias("required"))


def argument_scores(spark, d):
    """Each sample's exact match, field hits, required slots and illegal keys; page lists count by their pages."""
    return evaluation.scored_arguments(_samples(spark, d)).select("id", "capability", "exact_match", "fields_considered", "field_hits", "required_present", "required_correct", F.array_join("illegal", ",").alias("illegal"))


_AS = """sc AS (SELECT event_id AS id, event_type AS capability, event_id % 10 <> 0 AS name_ok, event_id % 4 <> 0 OR coalesce(json_extract_string(props, '$.k'), '0') = 'other' AS k_ok, event_id % 3 > 0 AS u_ok, event_id % 6 = 0 AS p_ok FROM events)"""
ORACLE_SQL["argument_scores"] = f"""WITH {_AS} SELECT id, capability, name_ok AND k_ok AND u_ok AND p_ok AS exact_match, 3 AS fields_considered, k_ok::INT + u_ok::INT + p_ok::INT AS field_hits, 1 + u_ok::INT AS required_present, k_ok::INT + u_ok::INT AS required_correct, CASE WHEN u_ok THEN '' ELSE 'stray' END AS illegal FROM sc"""


def argument_report(spark, d):
    """Micro ratios of those scores by capability and over all."""
    return evaluation.argument_report(evaluation.scored_arguments(_samples(spark, d)))


ORACLE_SQL["argument_report"] = f"""WITH {_AS} SELECT capability, count(*) AS samples, round(avg((name_ok AND k_ok AND u_ok AND p_ok)::INT), 4) AS exact_match, round(sum(k_ok::INT + u_ok::INT + p_ok::INT) / (3 * count(*)), 4) AS field_accuracy,
  round(1 - sum(1 + u_ok::INT) / (2 * count(*)), 4) AS required_missing_rate, round(sum(k_ok::INT + u_ok::INT) / (2 * count(*)), 4) AS required_accuracy, round(avg((NOT u_ok)::INT), 4) AS illegal_slot_rate, sum((NOT u_ok)::INT)::BIGINT AS illegal_keys_total FROM sc GROUP BY ROLLUP (capability)"""


def _graded(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.element_at(F.array(*[F.lit(x) for x in ("TOOL", "AGENT", "TOOL", "ABSTAIN", "AMBIGUOUS")]), (F.col("event_id") % 5 + 1).cast("int")).alias("expected"), (F.col("event_id") % 7).alias("expected_id"), F.when(F.col("event_id") % 3 == 0, "AGENT").otherwise("TOOL").alias("actual"), (F.col("event_id") % 7 + (F.col("event_id") % 11 == 0).cast("int")).alias("actual_id"))
    return evaluation.graded(e)


_GR = """gr AS (SELECT *, CASE WHEN et AND act THEN CASE WHEN eid = aid THEN 'TP' ELSE 'FP+FN' END WHEN act THEN 'FP' WHEN et THEN 'FN' ELSE 'TN' END AS exact, CASE WHEN expected IN ('TOOL', 'AGENT') THEN CASE WHEN act THEN CASE WHEN et THEN 'TP' ELSE 'FP' END ELSE CASE WHEN et THEN 'FN' ELSE 'TN' END END END AS "binary" FROM (
  SELECT event_id, user_id, x AS expected, x = 'TOOL' AS et, event_id % 3 <> 0 AS act, event_id % 7 AS eid, event_id % 7 + (event_id % 11 = 0)::INT AS aid FROM (SELECT *, ['TOOL', 'AGENT', 'TOOL', 'ABSTAIN', 'AMBIGUOUS'][event_id % 5 + 1] AS x FROM events)))"""


def grades(spark, d):
    """Exact and binary grades of routing decisions."""
    return _graded(spark, d).groupBy("expected", "exact", "binary").agg(F.count("*").alias("n"))


ORACLE_SQL["grades"] = f'WITH {_GR} SELECT expected, exact, "binary", count(*) AS n FROM gr GROUP BY ALL'


def threshold_pairs(spark, d):
    """The candidates of each query at two thresholds: how many, and which the higher one loses; a query may lose all."""
    from quern.plans.retrieval import _nearest

    h = _nearest(spark, d, 20)
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"))
    at = lambda t: q.join(h.where(F.col("score") >= t), "query_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("retrieved"))
    return candidates.compared(at(0.1), at(0.2))


def _tp_sql():
    from quern.plans.retrieval import _nearest_sql

    return f"SELECT q.vec_id AS query_id, count(n.id)::INT AS n_low, count(n.id) FILTER (n.score >= 0.2)::INT AS n_high, coalesce(string_agg(n.id, ',' ORDER BY n.id) FILTER (n.score < 0.2), '') AS lost FROM embeddings q LEFT JOIN (SELECT * FROM ({_nearest_sql(20)}) WHERE score >= 0.1) n ON n.query_id = q.vec_id WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL GROUP BY 1"


ORACLE_SQL["threshold_pairs"] = _tp_sql()


def quota_split(spark, d):
    """Families of equal documents dealt whole to splits so that each language's rows meet 80, 10 and 10 per cent."""
    g = curation.exact_groups(_docs(spark, d), T.bare(F.col("text"))).join(_docs(spark, d).select("id", "lang"), "id")
    fam = g.groupBy(F.col("keep").alias("family")).agg(F.min_by("lang", "id").alias("stratum"), F.count("*").alias("n"))
    return curation.quota_split(fam, {"train": 80, "dev": 10, "test": 10}, "s1")


_BARE = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')"
ORACLE_SQL["quota_split"] = f"""WITH g AS (SELECT doc_id AS id, lang, min(doc_id) OVER (PARTITION BY {_BARE}) AS keep FROM documents), f AS (SELECT keep AS family, arg_min(lang, id) AS stratum, count(*) AS n FROM g GROUP BY 1),
  p AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY sha256('s1|' || family), family ROWS UNBOUNDED PRECEDING) AS e, sum(n) OVER (PARTITION BY stratum) AS t FROM f)
  SELECT family, stratum, n, CASE WHEN (2 * e - n) * 50 / t < 80 THEN 'train' WHEN (2 * e - n) * 50 / t < 90 THEN 'dev' ELSE 'test' END AS split FROM p"""


def coverage_sample(spark, d):
    """Six documents of each language and source, families not seen before first (a sampling operator)."""
    r = _docs(spark, d).withColumn("family", F.substring(F.md5(T.bare(F.col("text"))), 1, 1))
    return curation.coverage_sample(r, ["lang", "source"], "family", "id", 6, "s2").select("id", "lang", "source", "turn", "place")


ORACLE_SQL["coverage_sample"] = f"""WITH r AS (SELECT doc_id AS id, lang, source, md5({_BARE})[1] AS family, sha256('s2|' || doc_id) AS h FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, family ORDER BY h, id) AS turn FROM r)
  SELECT id, lang, source, turn, row_number() OVER (PARTITION BY lang, source ORDER BY turn, h, id) AS place FROM t QUALIFY place <= 6"""


def unique_batches(spark, d):
    """Batches of eight documents with at most one of a source."""
    return curation.unique_batches(_docs(spark, d).select("id", "source"), "source", "id", 8, "s3").select("id", "source", "round", "batch", "place")


ORACLE_SQL["unique_batches"] = """WITH r AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s3|' || doc_id), doc_id) AS round FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY sha256('s3|' || source), source) - 1 AS n FROM r)
  SELECT id, source, round, n // 8 AS batch, n % 8 AS place FROM n"""


def shared_grams(spark, d):
    """Benchmark items against all turns of conversations: pairs with six common character four-grams or more, counted by bands of the cosine of their sets."""
    g = lambda rows: rows.select("id", curation.grams(T.normalized(F.col("text")), 4).alias("grams"))
    train = g(table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text"))
    test = g(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    p = curation.shared_gram_pairs(train, test)
    return p.agg(F.count("*").alias("pairs"), F.max("shared").alias("most"), *[F.count_if(F.col("cosine") >= x / 100).alias(f"from_{x}") for x in (20, 40, 80, 90, 95)])


_N = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


def _g4(rows: str) -> str:
    return f"SELECT DISTINCT id, array_to_string(c[i:i + 3], '') AS g FROM (SELECT id, c, unnest(range(1, greatest(len(c) - 2, 2))) AS i FROM (SELECT id, string_split({_N}, '') AS c FROM ({rows})))"


ORACLE_SQL["shared_grams"] = f"""WITH a AS ({_g4("SELECT conv_id || ':' || turn AS id, text FROM conversations")}), b AS ({_g4("SELECT item_id AS id, text FROM benchmark")}), m AS (SELECT id, count(*) AS n FROM a GROUP BY 1), k AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
  p AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM a JOIN b USING (g) GROUP BY a.id, b.id HAVING count(*) >= 6), q AS (SELECT shared, round(shared / (sqrt(m.n) * sqrt(k.n)), 6) AS cosine FROM p JOIN m ON m.id = x JOIN k ON k.id = y)
  SELECT count(*) AS pairs, max(shared) AS most, {', '.join(f'count(*) FILTER (cosine >= {x / 100}) AS from_{x}' for x in (20, 40, 80, 90, 95))} FROM q"""


def dual_target(spark, d):
    """Conversation turns by ordinal zipped with a manifest (their roles), each a row of its text and a row of its
    description; rows without both lists are no training rows. Unequal lengths stop the job."""
    t = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("o"), "text", "role")
    a, b = t.select("o", "text"), t.select("o", "role")
    j = a.join(b.withColumn("_r", F.lit(True)), "o", "full_outer")
    whole = F.when(F.col("text").isNull() & F.col("_r").isNull(), F.raise_error(F.lit("rows and manifest differ"))).otherwise(F.col("role"))
    rows = j.select("o.*", "text", whole.alias("role")).where("length(text) > 0")
    pair = F.array(F.struct(F.lit("query").alias("kind"), F.col("text").alias("target")), F.struct(F.lit("description").alias("kind"), F.concat_ws(" ", "role", F.md5("text")).alias("target")))
    return rows.select("conv_id", "turn", F.explode(pair).alias("x")).select("conv_id", "turn", "x.kind", F.md5("x.target").alias("target"))


ORACLE_SQL["dual_target"] = "SELECT conv_id, turn, kind, CASE WHEN kind = 'query' THEN md5(text) ELSE md5(role || ' ' || md5(text)) END AS target FROM conversations, (SELECT unnest(['query', 'description']) AS kind) WHERE length(text) > 0"


def row_invariants(spark, d):
    """How many documents break each rule of a finished row, and the languages that have broken ones."""
    r = _docs(spark, d)
    bad = {"no_text": F.coalesce(F.length("text"), F.lit(0)) == 0, "wrong_size": F.col("n_chars") != F.length("text"), "short": F.col("n_chars") < 50}
    g = r.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in bad.items()])
    return g.where(" or ".join(f"{k} > 0" for k in bad))


ORACLE_SQL["row_invariants"] = "SELECT lang, count(*) AS n, count(*) FILTER (coalesce(length(text), 0) = 0) AS no_text, count(*) FILTER (n_chars <> length(text)) AS wrong_size, count(*) FILTER (n_chars < 50) AS short FROM documents GROUP BY 1 HAVING count(*) FILTER (coalesce(length(text), 0) = 0 OR n_chars <> length(text) OR n_chars < 50) > 0"


def embedding_backfill(spark, d):
    """Documents that have no vector yet, by language."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"))
    return _docs(spark, d).join(e.where("id % 3 > 0"), "id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.min("id").alias("first"))


ORACLE_SQL["embedding_backfill"] = "SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 > 0) GROUP BY 1"


def import_flags(spark, d):
    """Turns to flag as imported: those that an imported pair covers, but for turns flagged before; a pair all of whose
    turns are flagged is skipped."""
    from quern.operators import conversation

    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    spans = conversation.pair_spans(t).where("conv_id % 2 = 0").select("conv_id", F.explode(F.sequence("begin", F.col("end") - 1)).alias("turn"))
    flagged = t.where("turn % 3 = 0").select("conv_id", "turn")
    return t.join(spans, ["conv_id", "turn"], "left_semi").join(flagged, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


ORACLE_SQL["import_flags"] = "SELECT conv_id, turn FROM conversations c WHERE conv_id % 2 = 0 AND turn % 3 <> 0 AND turn >= (SELECT min(turn) FROM conversations u WHERE u.conv_id = c.conv_id AND role = 'user')"


def _claims(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_custkey", "o_orderstatus")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_linenumber") == 5, "unclear").otherwise("supports").alias("verdict"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return o, l


def pending_claims(spark, d):
    """Which orders as claims are to be verified again: final ones never, those without a stored fingerprint always, those
    whose gate fails, else those whose evidence changed."""
    o, l = _claims(spark, d)
    now = graph.fingerprints(l.select("claim_id", F.concat_ws("|", "item_id", "verdict").alias("item")), "claim_id", "item").withColumnRenamed("fingerprint", "current_fp")
    old = graph.fingerprints(l.where("item_id % 20 <> 0 and claim_id % 4 > 0").select("claim_id", F.concat_ws("|", "item_id", "verdict").alias("item")), "claim_id", "item").withColumnRenamed("fingerprint", "stored_fp")
    gate = l.groupBy("claim_id").agg((F.count_if(F.col("verdict") == "supports") > 0).alias("gate_ok"))
    j = o.join(now, "claim_id", "left").join(old, "claim_id", "left").join(gate, "claim_id", "left").withColumn("terminal", F.col("o_orderstatus") == "P")
    return graph.pending_rule(j)


ORACLE_SQL["pending_claims"] = """WITH l AS (SELECT l_orderkey AS c, l_partkey AS i, CASE WHEN l_returnflag = 'R' THEN 'contradicts' WHEN l_linenumber = 5 THEN 'unclear' ELSE 'supports' END AS v FROM lineitem),
  n AS (SELECT c, string_agg(DISTINCT i || '|' || v, ',' ORDER BY i || '|' || v) AS f, count(*) FILTER (v = 'supports') > 0 AS ok FROM l GROUP BY 1), s AS (SELECT c, string_agg(DISTINCT i || '|' || v, ',' ORDER BY i || '|' || v) AS f FROM l WHERE i % 20 <> 0 AND c % 4 > 0 GROUP BY 1)
  SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'P' THEN false WHEN s.f IS NULL THEN true WHEN NOT coalesce(ok, false) THEN true ELSE s.f <> n.f END AS pending FROM orders LEFT JOIN n ON n.c = o_orderkey LEFT JOIN s ON s.c = o_orderkey"""


def packed_claims(spark, d):
    """A customer's orders as claims packed by their lines' quantities into chunks of 200 and at most four claims."""
    o, _ = _claims(spark, d)
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.sum("l_quantity").cast("long").alias("tokens"))
    c = o.join(n, "claim_id").select(F.col("o_custkey").alias("project"), "claim_id", "tokens")
    return graph.packed_claims(c, 200, 4)


ORACLE_SQL["packed_claims"] = """WITH RECURSIVE c AS (SELECT o_custkey AS project, o_orderkey AS claim_id, q AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
  r AS (SELECT project, claim_id, n, 0 AS chunk, tokens AS used, 1 AS k FROM c WHERE n = 1
    UNION ALL SELECT c.project, c.claim_id, c.n, r.chunk + (r.used + c.tokens > 200 OR r.k >= 4)::INT, CASE WHEN r.used + c.tokens > 200 OR r.k >= 4 THEN c.tokens ELSE r.used + c.tokens END, CASE WHEN r.used + c.tokens > 200 OR r.k >= 4 THEN 1 ELSE r.k + 1 END FROM r JOIN c ON c.project = r.project AND c.n = r.n + 1)
  SELECT project, claim_id, chunk FROM r"""


def usable_evidence(spark, d):
    """Order lines as findings of suppliers; only usable sources, texts of 20 characters and clear verdicts are stored."""
    _, l = _claims(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("usable"))
    return graph.usable_evidence(l, s, 20).select("claim_id", "item_id", "source_id", "verdict", F.length("text").alias("n"))


_EV = """ev AS (SELECT l_orderkey AS claim_id, l_partkey AS item_id, l_suppkey AS source_id, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS verdict, l_quantity::INT AS n FROM lineitem WHERE (l_returnflag = 'R' OR l_linenumber <> 5) AND l_quantity::INT >= 20 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY n DESC, l_suppkey) = 1)"""
ORACLE_SQL["usable_evidence"] = f"WITH {_EV} SELECT * FROM ev"


def known_gaps(spark, d):
    """How many claims have stored evidence, and the first twenty that have and have not."""
    o, l = _claims(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("usable"))
    g = graph.known_gaps(o, graph.usable_evidence(l, s, 20))
    return g.select("claims", "anchored", F.array_join("anchored_ids", ",").alias("anchored_ids"), F.array_join("gap_ids", ",").alias("gap_ids"))


ORACLE_SQL["known_gaps"] = f"""WITH {_EV}, o AS (SELECT o_orderkey AS c, o_orderkey IN (SELECT claim_id FROM ev) AS e FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY c) AS n FROM o)
  SELECT count(*) AS claims, count(*) FILTER (e) AS anchored, string_agg(c, ',' ORDER BY c) FILTER (e AND n <= 20) AS anchored_ids, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT e AND n <= 20), '') AS gap_ids FROM f"""


def source_map(spark, d):
    """Each source with the claims and items that rest on it, over distinct edges whose ends exist."""
    _, l = _claims(spark, d)
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    claims = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    e = graph.edges_between(l.select(F.col("source_id").alias("src"), F.col("claim_id").alias("dst"), F.col("item_id").alias("kind")), sources, claims)
    m = graph.source_map(e.select(F.col("src").alias("source_id"), F.col("dst").alias("claim_id"), F.col("kind").alias("item_id")))
    return m.withColumn("source_id", F.concat(F.lit("s"), "source_id"))  # numbers are a third of the names' size in a shuffle


ORACLE_SQL["source_map"] = "SELECT 's' || l_suppkey AS source_id, count(DISTINCT l_orderkey) AS claims, count(DISTINCT l_partkey) AS items FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1"


def label_redundancy(spark, d):
    """Distinct targets, and mean and most rows of a target."""
    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    return t.groupBy("l_returnflag").agg(F.count("*").alias("targets"), F.round(F.avg("n"), 4).alias("mean_rows"), F.max("n").alias("most_rows"))


ORACLE_SQL["label_redundancy"] = "SELECT l_returnflag, count(*) AS targets, round(avg(n), 4) AS mean_rows, max(n) AS most_rows FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1"


def next_versions(spark, d):
    """The next version of each (part, supplier) and what a new corpus row of it updates or inserts."""
    have = table(spark, d, "lineitem").where("l_linenumber < 4").groupBy("l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("version"))
    new = table(spark, d, "lineitem").where("l_linenumber >= 4").groupBy("l_partkey", "l_suppkey").agg(F.max("l_orderkey").alias("row"))
    j = new.join(have, ["l_partkey", "l_suppkey"], "left")
    return j.select("l_partkey", "l_suppkey", "row", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.when(F.col("version").isNull(), "insert").otherwise("update").alias("action"))


ORACLE_SQL["next_versions"] = "WITH h AS (SELECT l_partkey, l_suppkey, max(l_linenumber) AS v FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, max(l_orderkey) AS row FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL) SELECT l_partkey, l_suppkey, row, coalesce(v, 0) + 1 AS version, CASE WHEN v IS NULL THEN 'insert' ELSE 'update' END AS action FROM n LEFT JOIN h USING (l_partkey, l_suppkey)"


def merge_paragraphs(spark, d):
    """Paragraphs, here lines, merged with blank lines into chunks of 700 with windows that overlap by 100 (greedy: no SQL
    beside it; a test compares brute force)."""
    t = _docs(spark, d).select("id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.merged_paragraphs(t, 700, 100).select("id", "seq", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def section_pieces(spark, d):
    """Sections of texts whose lines that begin with T are made headings, cut and prefixed (greedy: no SQL beside it)."""
    t = _docs(spark, d).withColumn("text", F.regexp_replace("text", r"(?m)^T", "## T"))
    return chunking.section_pieces(t, "manual").select("id", "seq", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def subtitle_chunks(spark, d):
    """Lines of documents as cues of two seconds, grouped in chunks of 300 characters with their times (greedy: no SQL
    beside it; a test compares brute force)."""
    c = _docs(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("index", "text")).select("id", "index", (F.col("index") * 2000).alias("start_ms"), (F.col("index") * 2000 + 1500).alias("end_ms"), "text")
    return chunking.subtitle_chunks(c, 300).select("id", "seq", "start_ms", "end_ms", "start_ts", "end_ts", F.md5("chunk").alias("digest"))

for _f in (term_sentences, argument_scores, argument_report, grades, threshold_pairs, quota_split, coverage_sample, unique_batches, shared_grams, dual_target, row_invariants, embedding_backfill, import_flags, pending_claims, packed_claims, usable_evidence, known_gaps, source_map, label_redundancy, next_versions, merge_paragraphs, section_pieces, subtitle_chunks):
    QUERIES[_f.__name__] = _f
