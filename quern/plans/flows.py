"""Queries that expand, migrate, verify and price: scenarios, phrase corpora, evidence batches, subtitles, histories, scoped search,
with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunking, conversation, curation, graph, migration, recall, scenarios, tables
from quern.plans.tables import table
from quern.sources import subtitles

QUERIES, ORACLE_SQL = {}, {}


def _cases(spark, d):
    """Order priorities and states as templates, as many cases of each as it has orders; brands, segments and types of parts fill the
    slots."""
    o = table(spark, d, "orders").withColumn("template", F.lower(F.regexp_replace(F.concat_ws(".", "o_orderpriority", "o_orderstatus"), "[^A-Za-z0-9]+", ".")))
    t = o.groupBy("template").agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("status"), F.min("o_orderpriority").alias("capability"))
    t = t.withColumn("text", F.concat(F.lit("find {type} of {brand} for {segment} in "), "template"))
    values = lambda name, column, slot: table(spark, d, name).agg(F.array_sort(F.collect_set(column)).alias("values")).select(F.lit(slot).alias("slot"), "values")
    s = values("part", "p_brand", "brand").union(values("customer", "c_mktsegment", "segment")).union(values("part", "p_type", "type"))
    slots = t.select("template").join(F.broadcast(s), F.lit(True))  # three rows
    return scenarios.case_ids(scenarios.expanded(t, slots, F.col("n"), "s6"))


_VALUES = """(SELECT list_sort(list(DISTINCT p_brand)) FROM part) AS bs, (SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer) AS ss, (SELECT list_sort(list(DISTINCT p_type)) FROM part) AS ts"""
_TURN = "('0x' || sha256('s6|' || template || '|{}')[1:7])::BIGINT"
_CASES = f"""tp AS (SELECT template, count(*) AS n, min(o_orderstatus) AS status, min(o_orderpriority) AS capability FROM (SELECT *, lower(regexp_replace(o_orderpriority || '.' || o_orderstatus, '[^A-Za-z0-9]+', '.', 'g')) AS template FROM orders) GROUP BY 1),
  dg AS (SELECT *, k % len(bs) AS d1, k // len(bs) % len(ss) AS d2, k // len(bs) // len(ss) % len(ts) AS d3 FROM (SELECT *, unnest(range(least(n, len(bs) * len(ss) * len(ts)))) AS k FROM (SELECT *, {_VALUES} FROM tp))),
  cs AS (SELECT template, status, capability, k + 1 AS case_no, bs[1 + (d1 + {_TURN.format('brand')}) % len(bs)] AS brand, ss[1 + (d2 + d1 + {_TURN.format('segment')}) % len(ss)] AS segment, ts[1 + (d3 + d1 + d2 + {_TURN.format('type')}) % len(ts)] AS type FROM dg),
  cq AS (SELECT *, 'find ' || type || ' of ' || brand || ' for ' || segment || ' in ' || template AS query FROM cs)"""


def scenario_cases(spark, d):
    """Cases of templates, each another combination of slot values."""
    return _cases(spark, d).select("case_id", "case_no", F.element_at("args", "brand").alias("brand"), F.element_at("args", "segment").alias("segment"), F.element_at("args", "type").alias("type"), F.md5("query").alias("digest"))


ORACLE_SQL["scenario_cases"] = f"WITH {_CASES} SELECT template || '-' || CASE WHEN case_no < 10 THEN '0' ELSE '' END || case_no AS case_id, case_no, brand, segment, type, md5(query) AS digest FROM cq"


def _chains(spark, d):
    c = _cases(spark, d).withColumn("chain", F.concat_ws(".", "template", F.element_at("args", "brand")))
    return scenarios.sessions(c, "chain", 3)


def scenario_sessions(spark, d):
    """Those cases chained into sessions of three turns, by template and brand."""
    return _chains(spark, d).select("session_id", "turn_id", "case_id", "history", "template", "case_no")


_CHAINS = f"""{_CASES}, ch AS (SELECT *, 'sess-' || lower(regexp_replace(template || '.' || brand, '[^A-Za-z0-9]+', '.', 'g')) || '-' || (p // 3) AS session_id, (p % 3 + 1)::INT AS turn_id FROM (SELECT *, row_number() OVER (PARTITION BY template || '.' || brand ORDER BY case_no, template) - 1 AS p FROM cq))"""
ORACLE_SQL["scenario_sessions"] = f"WITH {_CHAINS} SELECT session_id, turn_id, session_id || '-t' || turn_id AS case_id, turn_id - 1 AS history, template, case_no FROM ch"


def scenario_violations(spark, d):
    """Rules that those turns break when finished orders are tool calls of three published capabilities that know no types."""
    c = _chains(spark, d).where("turn_id <> 2 or case_no % 7 > 0").withColumn("route", F.when(F.col("status") == "F", "TOOL").when(F.col("status") == "O", "AGENT").otherwise("MAYBE"))
    c = c.withColumn("capability", F.when(F.col("status") != "P", F.col("capability")))
    known = c.select("capability").where("capability < '4'").distinct().withColumn("slots", F.array(F.lit("brand"), F.lit("segment")))
    v = scenarios.violations(c, known)
    return v.groupBy("problem").agg(F.count("*").alias("n"), F.min("case_id").alias("first"))


ORACLE_SQL["scenario_violations"] = f"""WITH {_CHAINS}, v AS (SELECT *, session_id || '-t' || turn_id AS case_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS place FROM ch WHERE turn_id <> 2 OR case_no % 7 > 0),
  r AS (SELECT case_id, unnest([CASE WHEN turn_id <> place THEN 'broken chain' END, CASE WHEN status = 'P' THEN 'unknown route' END, CASE WHEN status = 'O' THEN 'capability without tool' END, CASE WHEN status = 'F' AND capability >= '4' THEN 'unknown capability' END, CASE WHEN status = 'F' AND capability < '4' THEN 'stray argument' END]) AS problem FROM v)
  SELECT problem, count(*) AS n, min(case_id) AS first FROM r WHERE problem IS NOT NULL GROUP BY 1"""


def _phrases(spark, d):
    """Conversations as drafts (users' turns similar phrases, assistants' standard ones, two turns in a place) and benchmark items as a
    registry: their first three words the standard phrase, the next five the similar ones."""
    t = table(spark, d, "conversations")
    drafts = t.select(F.concat(F.lit("c"), "conv_id").alias("capability"), F.when(F.col("role") == "user", "similar").when(F.col("role") == "assistant", "standard").otherwise("note").alias("kind"), F.floor(F.col("turn") / 2).cast("int").alias("position"), F.col("turn").alias("item_id"), F.col("text").alias("phrase"), (F.length("text") > 99).alias("enabled"))
    w = F.split("text", " ")
    registry = table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("capability"), F.array_join(F.slice(w, 1, 3), " ").alias("standard"), F.slice(w, 4, 5).alias("similar"))
    return migration.promoted(migration.source_phrases(drafts, registry), F.when(F.col("phrase").rlike("[äöüßéèêçñóí]"), "other").otherwise("en"))


_PH = """s0 AS (SELECT 'c' || conv_id AS capability, text AS phrase, CASE role WHEN 'user' THEN 'similar' ELSE 'standard' END AS kind, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn // 2, turn) - 1)::INT AS position, length(text) > 99 AS enabled, 'draft' AS lane FROM conversations WHERE role IN ('user', 'assistant')
    UNION ALL SELECT 'b' || item_id, array_to_string(string_split(text, ' ')[1:3], ' '), 'standard', 0, true, 'registry' FROM benchmark WHERE array_to_string(string_split(text, ' ')[1:3], ' ') <> ''
    UNION ALL SELECT 'b' || item_id, unnest(string_split(text, ' ')[4:8]), 'similar', generate_subscripts(string_split(text, ' ')[4:8], 1)::INT - 1, true, 'registry' FROM benchmark),
  s1 AS (SELECT *, CASE WHEN kind = 'similar' AND position = 0 THEN 'en' WHEN regexp_matches(phrase, '[äöüßéèêçñóí]') THEN 'other' ELSE 'en' END AS language, CASE WHEN kind = 'standard' OR position = 0 THEN 'standard' ELSE 'similar' END AS target FROM s0),
  st AS (SELECT sha256(capability || chr(31) || language)[1:16] AS standard_id, capability, language, phrase, position FROM s1 WHERE target = 'standard'),
  si AS (SELECT h.standard_id, s1.capability, s1.language, phrase, position, enabled FROM s1 LEFT JOIN (SELECT DISTINCT capability, language, standard_id FROM st) h USING (capability, language) WHERE target = 'similar')"""


def phrase_migration(spark, d):
    """Phrases of both lanes as standard phrases and similar ones under them; the first similar phrase of a capability is
    promoted."""
    p = _phrases(spark, d)
    std, sim = migration.migrated(p)
    one = std.select(F.lit("standard").alias("target"), "standard_id", "capability", "language", "position", F.md5("phrase").alias("digest"), F.lit(True).alias("enabled"))
    return one.unionByName(sim.select(F.lit("similar").alias("target"), "standard_id", "capability", "language", "position", F.md5("phrase").alias("digest"), "enabled"))


ORACLE_SQL["phrase_migration"] = f"WITH {_PH} SELECT 'standard' AS target, standard_id, capability, language, position, md5(phrase) AS digest, true AS enabled FROM st UNION ALL SELECT 'similar', standard_id, capability, language, position, md5(phrase), enabled FROM si"


def migration_violations(spark, d):
    """What forbids publishing that migration, counted by rule: wrong numbers of standards, similar phrases without
    one; none lost or added."""
    p = _phrases(spark, d)
    v = migration.conservation(p, *migration.migrated(p), ("en", "other"))
    return v.groupBy("rule").agg(F.count("*").alias("subjects"), F.sum("n").alias("n"))


ORACLE_SQL["migration_violations"] = f"""WITH {_PH}, c AS (SELECT k.capability, x.l, count(st.phrase) AS n FROM (SELECT DISTINCT capability FROM s1) k JOIN (SELECT unnest(['en', 'other']) AS l) x ON true LEFT JOIN st ON st.capability = k.capability AND st.language = x.l GROUP BY ALL HAVING count(st.phrase) <> 1),
  o AS (SELECT phrase, count(*) AS n FROM si WHERE standard_id IS NULL GROUP BY 1)
  SELECT 'standards' AS rule, count(*) AS subjects, sum(n)::BIGINT AS n FROM c HAVING count(*) > 0 UNION ALL SELECT 'orphan', count(*), sum(n)::BIGINT FROM o HAVING count(*) > 0"""


def corpus_merge(spark, d):
    """The corpus of first order lines of each part and supplier after the later lines are merged in: updated rows with
    the next version, new rows, and rows that stay."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_orderkey")
    corpus = l.where("l_linenumber < 3").groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_orderkey", "l_quantity")).alias("x"), F.max("l_linenumber").cast("int").alias("version")).select("l_partkey", "l_suppkey", "x.l_orderkey", "x.l_quantity", "version")
    changes = l.where("l_linenumber >= 3").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")
    return migration.merged(corpus, changes, ["l_partkey", "l_suppkey"])


ORACLE_SQL["corpus_merge"] = """WITH c AS (SELECT l_partkey, l_suppkey, max({'o': l_orderkey, 'q': l_quantity}) AS x, max(l_linenumber) AS v FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, max({'o': l_orderkey, 'q': l_quantity}) AS x FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
  SELECT l_partkey, l_suppkey, coalesce(n.x, c.x).o AS l_orderkey, coalesce(n.x, c.x).q AS l_quantity, CASE WHEN n.x IS NULL THEN c.v ELSE coalesce(c.v, 0) + 1 END::INT AS version FROM c FULL JOIN n USING (l_partkey, l_suppkey)"""


def _batch(spark, d):
    """Orders as verifications of customers' claims: lines are findings. Orders of one customer and state share an id; every tenth
    customer is no claim; orders without a priority in the upper half were verified before with the findings they have."""
    f = F.struct(F.col("l_suppkey").alias("source_id"), F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_linenumber") == 5, "unclear").otherwise("supports").alias("verdict"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    l = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(f)).alias("findings"))
    o = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    items = o.select(F.concat_ws("-", "o_custkey", "o_orderstatus", F.col("o_orderkey") % 50).alias("item_id"), F.col("o_custkey").alias("claim_id"), "findings")
    claims = table(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("claim_id"), (F.col("c_acctbal") > 1000).alias("gate_ok"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("usable"))
    return items, claims, sources


def verified_items(spark, d):
    """What becomes of each item of a batch that is verified a second time: rejected by itself, skipped, or verified."""
    items, claims, sources = _batch(spark, d)
    items = graph.marked(items)
    first = graph.judged(items, claims, spark.createDataFrame([], "claim_id long, fingerprint string"))
    baseline = first.where("status = 'verified'").groupBy("claim_id").agg(F.min("fingerprint").alias("fingerprint"))
    results, _ = graph.verified_batch(items, claims, sources, baseline, 20)
    return results.groupBy("status", F.regexp_replace("reason", "[0-9]+ ", "").alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("reason").startswith("1 ")).alias("one_left_out"))


ORACLE_SQL["verified_items"] = """WITH f AS (SELECT l_orderkey, l_suppkey AS s, CASE WHEN l_returnflag = 'R' THEN 'contradicts' WHEN l_linenumber = 5 THEN 'unclear' ELSE 'supports' END AS v, l_quantity::INT AS q FROM lineitem WHERE l_linenumber > 1),
  h AS (SELECT *, sha256(concat_ws(chr(31), s, v, repeat('x', q))) AS m, coalesce(v <> 'unclear' AND q >= 20 AND (SELECT s_acctbal > 0 FROM supplier WHERE s_suppkey = s), false) AS good FROM f),
  o AS (SELECT o_custkey || '-' || o_orderstatus || '-' || (o_orderkey % 50) AS item_id, o_custkey AS claim_id, o_orderkey, (SELECT sha256(array_to_string(list_sort(list(DISTINCT m)), ',')) FROM h WHERE l_orderkey = o_orderkey) AS fp, (SELECT count(*) FROM h WHERE l_orderkey = o_orderkey) AS n, (SELECT count(*) FILTER (NOT good) FROM h WHERE l_orderkey = o_orderkey) AS bad FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY claim_id, fp NULLS FIRST) AS rn, claim_id % 10 > 0 AS known, (SELECT c_acctbal > 1000 FROM customer WHERE c_custkey = claim_id) AS gate FROM o), b AS (SELECT claim_id, min(fp) AS fp FROM k WHERE known AND rn = 1 AND n > 0 GROUP BY 1),
  r AS (SELECT k.*, CASE WHEN rn > 1 THEN 'duplicate item id' WHEN NOT known THEN 'unknown claim' WHEN n = 0 THEN 'no findings' END AS why, coalesce(gate AND b.fp = k.fp, false) AS same FROM k LEFT JOIN b USING (claim_id)),
  z AS (SELECT CASE WHEN why IS NOT NULL THEN 'rejected' WHEN same THEN 'skipped' ELSE 'verified' END AS status, coalesce(why, CASE WHEN NOT same AND bad > 0 THEN 'findings left out' END) AS reason, why IS NULL AND NOT same AND bad = 1 AS one FROM r)
  SELECT status, reason, count(*) AS n, count(*) FILTER (one) AS one_left_out FROM z GROUP BY ALL"""


def vtt_cues(spark, d):
    """Turns as WebVTT files of a header, a note, and a cue with tags, a style line and escapes."""
    t = table(spark, d, "conversations")
    body = F.concat(F.lit("WEBVTT - x\n\nNOTE\nnot said\n\n01:02.5 --> 1:00:03.25 align:start\n<v.loud>"), F.coalesce(F.replace("text", F.lit("\n"), F.lit("\nNOTE aside\n<c.x>")), F.lit("")), F.lit("</c>\\N<i>end</i><00:00:01.000>\\h <B>\n\n\n00:00:07.000 --> 00:00:08.000\n<b></b>\n"))
    return subtitles.vtt(t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), body.alias("text"))).select("id", "index", "start_ms", "end_ms", F.md5("text").alias("digest"))


ORACLE_SQL["vtt_cues"] = r"""WITH t AS (SELECT conv_id || ':' || turn AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: regexp_replace(trim(x, ' ' || chr(9) || chr(13)), '^(NOTE|STYLE|REGION).*$', CASE WHEN i = 1 THEN '\0' ELSE '' END)), lambda x: x <> '') AS l FROM conversations),
  u AS (SELECT id, trim(regexp_replace(array_to_string(list_append(l[1:-2], coalesce(l[-1], '') || ' end <B>'), ' '), '\s+', ' ', 'g')) AS s FROM t)
  SELECT id, 1 AS index, 62500 AS start_ms, 3603250 AS end_ms, md5(s) AS digest FROM u"""


def chunk_sentinels(spark, d):
    """Windows of documents with sentinels of page and paragraph put in, taken out again; images of the pages are attached."""
    c = chunking.fixed_windows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 600, 0)
    page = (F.col("seq") / 2).cast("int").cast("string")
    marked = c.select("id", "seq", F.concat(F.lit("[[PAGE:"), page, F.lit("]] "), "chunk", F.lit(" [[PARA:"), F.col("seq").cast("string"), F.lit("]] [[PAGE:"), page, F.lit("]]")).alias("chunk"))
    images = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("page")).withColumn("image_id", F.concat_ws("/", "id", "page"))
    x = chunking.with_images(chunking.with_sentinels(marked), images)
    return x.select("id", "seq", F.array_join("pages", ",").alias("pages"), F.array_join("paras", ",").alias("paras"), F.array_join("image_ids", ",").alias("images"), F.md5("chunk").alias("digest"))


ORACLE_SQL["chunk_sentinels"] = """WITH w AS (SELECT id, start // 600 AS seq, trim(substring(t, start + 1, 600)) AS c FROM (SELECT id, t, unnest(CASE WHEN len <= 600 THEN [0] ELSE range(0, len, 600) END) AS start FROM (SELECT doc_id AS id, t, length(t) AS len FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)) WHERE len > 0))
  SELECT id, seq::INT AS seq, (seq // 2)::VARCHAR AS pages, seq::VARCHAR AS paras, CASE WHEN seq // 2 IN (0, 2) THEN id || '/' || (seq // 2) ELSE '' END AS images, md5(c) AS digest FROM w""".replace("\\\\s", "\\s")


def negative_classes(spark, d):
    """Words of benchmark items as negatives of their lengths' capabilities, by who owns them: sources of documents own the words
    that begin their texts, neighbours in number are confusable."""
    owner = (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 10).alias("capability")
    corpus = table(spark, d, "documents").where("text is not null").select(owner, F.explode(F.slice(F.split("text", " "), 1, 3)).alias("phrase"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), (F.col("item_id") % 10).cast("int").alias("capability"), F.split("text", " ").alias("negatives"))
    near = spark.range(10).select(F.col("id").cast("int").alias("capability"), ((F.col("id") + 1) % 10).cast("int").alias("other"))
    n = curation.negative_quality(rows, corpus, near)
    return n.groupBy("row_id", "class").agg(F.count("*").alias("n"))


ORACLE_SQL["negative_classes"] = """WITH c AS (SELECT DISTINCT regexp_extract(source, '([0-9]+)$', 1)::INT % 10 AS k, trim(unnest(string_split(text, ' ')[1:3])) AS p FROM documents WHERE text IS NOT NULL),
  n AS (SELECT item_id, item_id % 10 AS k, trim(unnest(string_split(text, ' '))) AS p, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
  j AS (SELECT n.item_id, n.i, bool_or(c.k = n.k) AS own, bool_or(c.k = (n.k + 1) % 10) AS near, count(c.k) AS owners FROM n LEFT JOIN c USING (p) GROUP BY ALL)
  SELECT item_id AS row_id, CASE WHEN own THEN 'wrong' WHEN near THEN 'hard' WHEN owners > 0 THEN 'valid' ELSE 'unknown' END AS class, count(*) AS n FROM j GROUP BY ALL"""


def history_pages(spark, d):
    """The second page of the transcript of all turns, of which ten share a time; the first page ends inside such a group."""
    t = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).alias("created_at"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 2).otherwise(3).alias("turn_rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    first = conversation.history_page(t, 25)
    at = first.select("cursor").where("cursor is not null").first()
    return conversation.history_page(t, 40, tuple(at[0]) if at else None).select("created_at", "turn_rank", "id", "place", "has_more")


ORACLE_SQL["history_pages"] = """SELECT created_at, turn_rank, id, (n - 25)::INT AS place, t > 65 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, turn_rank DESC, id DESC) AS n, count(*) OVER () AS t FROM (SELECT conv_id // 10 AS created_at, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 2 ELSE 3 END AS turn_rank, conv_id * 1000 + turn AS id FROM conversations)) WHERE n BETWEEN 26 AND 65"""


def first_matches(spark, d):
    """The first turn of each conversation that holds a word."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "text")
    return conversation.first_match(t, "The").select("session_id", "id", F.md5("snippet").alias("digest"))


ORACLE_SQL["first_matches"] = "SELECT conv_id AS session_id, turn AS id, md5(substring(text, greatest(instr(lower(text), 'the') - 20, 1), 43)) AS digest FROM conversations WHERE contains(lower(text), 'the') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"


def usage_costs(spark, d):
    """What events cost by prices given for their types, else built-in ones; unknown prices are null."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (F.col("value") * 100).cast("long").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    injected = spark.createDataFrame([("click", 0.5, 1.5)], "model string, prompt double, completion double")
    builtin = spark.createDataFrame([("click", 9.0, 9.0), ("view", 3.0, 15.0), ("error", 0.0, 0.0)], "model string, prompt double, completion double")
    c = tables.known_prices(e, injected, builtin)
    return c.groupBy("model", "source").agg(F.count("*").alias("n"), F.count("cost").alias("known"), F.round(F.sum("cost"), 3).alias("cost"))


ORACLE_SQL["usage_costs"] = """WITH c AS (SELECT event_type AS model, CASE event_type WHEN 'click' THEN 'injected' WHEN 'view' THEN 'builtin' WHEN 'error' THEN 'builtin' ELSE 'unknown' END AS source, round(CASE event_type WHEN 'click' THEN (p * 0.5::DOUBLE + u * 1.5::DOUBLE) / 1000 WHEN 'view' THEN (p * 3.0::DOUBLE + u * 15.0::DOUBLE) / 1000000 WHEN 'error' THEN 0 END, 6) AS cost FROM (SELECT event_type, trunc(value * 100)::BIGINT AS p, user_id AS u FROM events))
  SELECT model, source, count(*) AS n, count(cost) AS known, round(sum(cost), 3) AS cost FROM c GROUP BY ALL"""


def sentence_search(spark, d):
    """Vectors as sentences of a domain (their label), every third public, the others of three owners: the five nearest to each
    query among those it may see in its domain; every fourth query asks in all domains."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 7 % 3).alias("user_id"))
    q = e.where("vec_id % 50 = 0").withColumn("label", F.when(F.col("vec_id") % 200 > 0, F.col("label"))).withColumn("user_id", F.col("vec_id") % 4)
    return recall.masked_top_k(e, q, 5, ["label"], "user_id", decimals=4)


ORACLE_SQL["sentence_search"] = """WITH e AS (SELECT vec_id, embedding, label, CASE WHEN vec_id % 3 > 0 THEN vec_id % 7 % 3 END AS u FROM embeddings WHERE embedding IS NOT NULL),
  p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id AND (e.u IS NULL OR e.u = q.vec_id % 4) AND (q.vec_id % 200 = 0 OR e.label = q.label) WHERE q.vec_id % 50 = 0)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM p QUALIFY rank <= 5"""


def rewritten_queries(spark, d):
    """Benchmark items as queries, their words' first and second halves, a blank and themselves in capitals as rewrites, and a
    document of their number as the hypothetical answer."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    w, n = F.split("text", " "), F.size(F.split("text", " "))
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    r = b.select("query_id", F.posexplode(F.array(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  "), F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, n), " "), F.array_join(F.slice(w, F.lit(2), n), " "))).alias("place", "text"))
    drafts = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("draft"))
    return recall.rewritten(b, r, drafts, 2).select("query_id", "variant", F.md5("text").alias("digest"), F.md5("embed_text").alias("embedded"))


ORACLE_SQL["rewritten_queries"] = """WITH b AS (SELECT item_id AS query_id, text, string_split(text, ' ') AS w, greatest(len(string_split(text, ' ')) // 2, 1) AS h FROM benchmark),
  r AS (SELECT query_id, unnest([text, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '  ', array_to_string(w[1:h], ' '), array_to_string(w[h + 1:], ' '), array_to_string(w[2:], ' ')]) AS text, unnest(range(6)) AS place FROM b),
  u AS (SELECT query_id, CASE WHEN place = 0 THEN text ELSE trim(text) END AS text, place FROM r WHERE place = 0 OR trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY place) = 1),
  v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS variant FROM u QUALIFY variant <= 2), d AS (SELECT doc_id, text AS draft FROM documents WHERE doc_id % 2 = 0 AND trim(text) <> '')
  SELECT query_id, variant::INT AS variant, md5(text) AS digest, md5(CASE WHEN variant = 0 THEN coalesce(draft, text) ELSE text END) AS embedded FROM v LEFT JOIN d ON d.doc_id = query_id"""


def object_references(spark, d):
    """How many living references each stored object (a text by its hash) has: documents that are not deleted, and of chats even those
    that are; objects without one may go."""
    x = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), (F.col("n_chars") % 5 == 0).alias("deleted"), (F.col("source") == "src1").alias("chat"))
    g = x.groupBy("sha").agg(F.count("*").alias("assets"), F.count_if(~F.col("deleted") | F.col("chat")).alias("living"))
    return g.select("sha", "assets", "living", (F.col("living") == 0).alias("free"))


ORACLE_SQL["object_references"] = "SELECT sha256(text) AS sha, count(*) AS assets, count(*) FILTER (n_chars % 5 <> 0 OR source = 'src1') AS living, count(*) FILTER (n_chars % 5 <> 0 OR source = 'src1') = 0 AS free FROM documents GROUP BY 1"

for _f in (scenario_cases, scenario_sessions, scenario_violations, phrase_migration, migration_violations, corpus_merge, verified_items, vtt_cues, chunk_sentinels, negative_classes, history_pages, first_matches, usage_costs, sentence_search, rewritten_queries, object_references):
    QUERIES[_f.__name__] = _f
