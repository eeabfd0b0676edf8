"""Scenarios, migrations, evidence batches, traces, sources and streams on small tables."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, conversation, curation, graph, migration, recall, scenarios, tables
from quern.plans.pipeline import Config, Node, RetrievalUnavailable, traced
from quern.sources import files, store, subtitles
from quern.streaming import backfill, timers


def test_expansion_is_one_to_one(spark):
    t = spark.createDataFrame([("a", "x {p} {q} {r}"), ("b", "no slots"), ("c", "{e}"), ("d", "{p}{p}")], "template string, text string")
    s = spark.createDataFrame([("a", "p", ["1", "2", "3"]), ("a", "q", ["u", "v"]), ("a", "r", list("klmno")), ("c", "e", []), ("d", "p", ["y", None])], "template string, slot string, values array<string>")
    full = scenarios.expanded(t, s, F.lit(1000), "z").collect()
    by = Counter(r["template"] for r in full)
    assert by == {"a": 30, "b": 1, "d": 2}
    assert len({tuple(sorted(r["args"].items())) for r in full if r["template"] == "a"}) == 30
    assert all(r["query"] == "x {p} {q} {r}".format(**r["args"]) for r in full if r["template"] == "a")
    assert {r["query"] for r in full if r["template"] == "d"} == {"yy", ""}
    part = scenarios.expanded(t, s, F.lit(7), "z").where("template = 'a'").collect()
    assert {r["query"] for r in part} == {r["query"] for r in full if r["template"] == "a" and r["case_no"] <= 7}
    assert {r["query"] for r in part} != {r["query"] for r in scenarios.expanded(t, s, F.lit(7), "y").where("template = 'a'").collect()}
    ids = {r["case_id"] for r in scenarios.case_ids(scenarios.expanded(t, s, F.lit(100), "z")).collect()}
    assert {"a-01", "a-30", "b-01"} <= ids


def test_sessions_and_violations(spark):
    c = spark.createDataFrame([("t", i, "Topic One" if i < 5 else "two") for i in range(1, 8)], "template string, case_no long, topic string")
    got = {r["case_no"]: (r["session_id"], r["turn_id"], r["case_id"], r["history"]) for r in scenarios.sessions(c, "topic", 3).collect()}
    assert got[1] == ("sess-topic.one-0", 1, "sess-topic.one-0-t1", 0) and got[4] == ("sess-topic.one-1", 1, "sess-topic.one-1-t1", 0) and got[7][1] == 3
    rows = [
        ("ok", "q", "TOOL", "c", {"s": "1"}, None, None), ("Bad Id", "q", "AGENT", None, None, None, None), (None, "q", "AGENT", None, None, None, None),
        ("dup", "q", "AGENT", None, None, None, None), ("dup", " ", "ABSTAIN", None, None, None, None), ("open", "x {slot}", "AGENT", None, None, None, None),
        ("r", "q", "ELSE", None, None, None, None), ("u", "q", "TOOL", "nope", {"s": "1"}, None, None), ("s", "q", "TOOL", "c", {"s": "1", "z": "2"}, None, None),
        ("n", "q", "TOOL", "c", {}, None, None), ("cap", "q", "AGENT", "c", None, None, None), ("s1", "q", "AGENT", None, None, "k", 1), ("s3", "q", "AGENT", None, None, "k", 3),
    ]
    df = spark.createDataFrame(rows, "case_id string, query string, route string, capability string, args map<string,string>, session_id string, turn_id int")
    v = scenarios.violations(df, spark.createDataFrame([("c", ["s"])], "capability string, slots array<string>"))
    assert sorted((r["case_id"] or "", r["problem"]) for r in v.collect()) == sorted([
        ("Bad Id", "bad id"), ("", "bad id"), ("dup", "duplicate id"), ("dup", "duplicate id"), ("dup", "empty query"), ("open", "open slot"), ("r", "unknown route"),
        ("u", "unknown capability"), ("s", "stray argument"), ("n", "no arguments"), ("cap", "capability without tool"), ("s3", "broken chain")])


def _migration(spark):
    drafts = spark.createDataFrame([("c", "standard", 0, 1, "中文", True), ("c", "similar", 1, 3, "second", True), ("c", "similar", 1, 2, "first", False), ("c", "similar", 2, 4, "很多", True), ("c", "note", 0, 9, "left out", True), ("d", "standard", 0, 5, "只有", True)], "capability string, kind string, position int, item_id long, phrase string, enabled boolean")
    registry = spark.createDataFrame([("r", "标准", ["anchor", "more", "more"]), ("s", "", None)], "capability string, standard string, similar array<string>")
    return migration.promoted(migration.source_phrases(drafts, registry), F.when(F.col("phrase").rlike("[一-鿿]"), "zh").otherwise("en"))


def test_migration_promotes_and_is_proved(spark):
    p = _migration(spark)
    std, sim = migration.migrated(p)
    assert {(r["capability"], r["language"], r["phrase"]) for r in std.collect()} == {("c", "zh", "中文"), ("c", "en", "first"), ("d", "zh", "只有"), ("r", "zh", "标准"), ("r", "en", "anchor")}
    ids = {(r["capability"], r["language"]): r["standard_id"] for r in std.collect()}
    assert sorted((r["standard_id"], r["phrase"]) for r in sim.collect()) == sorted([(ids["c", "en"], "second"), (ids["c", "zh"], "很多"), (ids["r", "en"], "more"), (ids["r", "en"], "more")])
    bad = migration.conservation(p, std, sim, ("zh", "en"))
    assert [tuple(r) for r in bad.collect()] == [("standards", "d/en", 0)]
    lost = migration.conservation(p, std.where("phrase <> 'first'"), sim.withColumn("phrase", F.when(F.col("phrase") == "more", "less").otherwise(F.col("phrase"))), ("zh", "en"))
    assert sorted(tuple(r) for r in lost.collect()) == [("added", "less", 2), ("lost", "first", 1), ("lost", "more", 2), ("standards", "c/en", 0), ("standards", "d/en", 0)]


def test_a_migration_is_published_only_when_proved(spark):
    p = _migration(spark)
    s = store.Store(spark, tempfile.mkdtemp(prefix="spark-store-") + "/t", ["capability"], ["language"], 2)
    check = lambda phrases: lambda old, new: migration.conservation(phrases, new, migration.migrated(phrases)[1], ("zh", "en"))
    with pytest.raises(store.Refused):
        s.replace(migration.migrated(p)[0], check=check(p))
    assert s.manifest()["version"] == 0
    good = p.where("capability <> 'd'")
    s.replace(migration.migrated(good)[0], check=check(good))
    assert s.read().count() == 4


def test_merged_corpus(spark):
    c = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "k int, v string, version int")
    n = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in migration.merged(c, n, ["k"]).collect()) == [(1, "y", 4), (2, "b", 1), (3, "z", 1)]


def test_verified_batch(spark):
    f = "array<struct<source_id: long, verdict: string, text: string>>"
    long = "x" * 30
    items = spark.createDataFrame([("i1", 1, [(1, "supports", long), (2, "supports", long), (1, "unclear", long), (1, "supports", "short")]), ("i1", 9, [(1, "supports", long)]), (None, 1, [(1, "supports", long)]), ("i2", None, []), ("i3", 7, [(1, "supports", long)]), ("i4", 2, None), ("i5", 3, [(1, "contradicts", long)]), (" ", 1, [])], f"item_id string, claim_id long, findings {f}")
    claims = spark.createDataFrame([(1, True), (2, True), (3, False), (9, True)], "claim_id long, gate_ok boolean")
    sources = spark.createDataFrame([(1, True), (2, False)], "source_id long, usable boolean")
    none = spark.createDataFrame([], "claim_id long, fingerprint string")
    results, stored = graph.verified_batch(items, claims, sources, none, 20)
    got = sorted(((r["item_id"] or "-"), r["claim_id"] or 0, r["status"], r["reason"]) for r in results.collect())
    assert got == sorted([("i1", 1, "verified", "3 findings left out"), ("i1", 9, "rejected", "duplicate item id"), ("-", 1, "rejected", "no item id"), (" ", 1, "rejected", "no item id"), ("i2", 0, "rejected", "no claim"), ("i3", 7, "rejected", "unknown claim"), ("i4", 2, "rejected", "no findings"), ("i5", 3, "verified", None)])
    assert sorted((r["claim_id"], r["source_id"], r["verdict"], r["item_id"]) for r in stored.collect()) == [(1, 1, "supports", "i1"), (3, 1, "contradicts", "i5")]
    base = results.where("status = 'verified'").select("claim_id", "fingerprint")
    again = {r["item_id"]: r["status"] for r in graph.verified_batch(items.where("item_id in ('i1', 'i5') and claim_id <> 9"), claims, sources, base, 20)[0].collect()}
    assert again == {"i1": "skipped", "i5": "verified"}  # the third claim's gate still fails
    s = store.Store(spark, tempfile.mkdtemp(prefix="spark-store-") + "/t", ["claim_id"], ["source_id", "verdict"], 2)
    s.replace(stored, batch=("verify", 5))
    assert s.replace(stored.where("claim_id = 3").withColumn("verdict", F.lit("supports")), batch=("verify", 5))["version"] == 1 and s.read().where("verdict = 'contradicts'").count() == 1


def test_history_pages_cut_groups_in_display_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3]), rng.randint(0, 3), i) for i in range(40)]
    df = spark.createDataFrame(rows, "created_at long, turn_rank int, id long")
    seen, at = [], None
    while True:
        page = sorted(conversation.history_page(df, 7, at).collect(), key=lambda r: r["place"])
        seen += [(r["created_at"], r["turn_rank"], r["id"]) for r in page]
        if not page[0]["has_more"]:
            assert page[0]["cursor"] is None
            break
        at = tuple(page[0]["cursor"])
        assert at == seen[-1]
    assert seen == sorted(rows, reverse=True)
    assert conversation.history_page(df.where("id > 99"), 7).count() == 0


def test_small_text_functions(spark):
    x = spark.createDataFrame([(1, 0, "[[PAGE:2]] a [[PARA:10]]b[[PAGE:2]] [[PAGE:1]]"), (1, 1, "none"), (1, 2, None)], "id long, seq int, chunk string")
    s = chunking.with_sentinels(x)
    got = {r["seq"]: (r["chunk"], r["pages"], r["paras"]) for r in s.collect()}
    assert got[0] == ("a b", [1, 2], [10]) and got[1] == ("none", [], [])
    im = spark.createDataFrame([(1, 2, "z"), (1, 1, "y"), (1, 9, "w"), (2, 1, "q")], "id long, page int, image_id string")
    assert {r["seq"]: r["image_ids"] for r in chunking.with_images(s.where("chunk is not null"), im).collect()} == {0: ["y", "z"], 1: []}
    v = spark.createDataFrame([("f", "WEBVTT\n\nSTYLE\n::cue{}\n\n00:01.5 --> 00:02.000\nNOTE hush\n<c.a.b>one</c> <v Ann>two\\Nthree\\h\nSTYLE x\n<00:00:01.100>four <i>five</i>\n\n00:03.000 --> 00:04.000\n<b></b>")], "id string, text string")
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in subtitles.vtt(v).collect()] == [(1500, 2000, "one <v Ann>two three four five")]
    u = spark.createDataFrame([("m", 1000, 0), ("n", 10, 10), ("o", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    p = tables.known_prices(u, spark.createDataFrame([("m", 2.0, 1.0)], "model string, prompt double, completion double"), spark.createDataFrame([("m", 9.0, 9.0), ("n", 5.0, 7.0)], "model string, prompt double, completion double"))
    assert {r["model"]: (r["cost"], r["source"]) for r in p.collect()} == {"m": (2.0, "injected"), "n": (0.00012, "builtin"), "o": (None, "unknown")}
    n = curation.negative_quality(spark.createDataFrame([(1, "a", ["x", "y ", "z", "w", "x"])], "row_id long, capability string, negatives array<string>"), spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("b", " z")], "capability string, phrase string"), spark.createDataFrame([("a", "c")], "capability string, other string"))
    assert sorted((r["negative"], r["class"]) for r in n.collect()) == [("w", "unknown"), ("x", "wrong"), ("x", "wrong"), ("y ", "valid"), ("z", "hard")]
    f = conversation.first_match(spark.createDataFrame([(1, 2, 1, "say Hello there"), (1, 1, 5, "hello"), (2, 1, 1, "no")], "session_id long, created_at long, id long, text string"), "HELLO")
    assert [(r["session_id"], r["id"], r["snippet"]) for r in f.collect()] == [(1, 5, "hello")]


def test_masked_search_and_rewrites(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)], rng.choice([None, "d", "e"]), rng.choice([None, 1, 2])) for i in range(120)]
    schema = "vec_id long, embedding array<double>, domain string, user_id long"
    q = [(1000 + i, [rng.random() for _ in range(4)], rng.choice([None, "d", "e", "f"]), rng.choice([None, 1, 2, 3])) for i in range(20)]
    got = Counter((r["query_id"], r["id"]) for r in recall.masked_top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(q, schema), 4, ["domain"], "user_id").collect())

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    want = Counter()
    for i, v, dom, user in q:
        fit = [(-cos(v, w), j) for j, w, e, u in rows if (dom is None or e == dom) and (u is None or u == user)]
        want.update((i, j) for _, j in sorted(fit)[:4])
    assert got == want
    r = recall.rewritten(spark.createDataFrame([(1, "A b"), (2, "")], "query_id long, text string"), spark.createDataFrame([(1, 0, "a B "), (1, 1, " "), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (9, 0, "x")], "query_id long, place int, text string"), spark.createDataFrame([(1, "hypothesis"), (2, " ")], "query_id long, draft string"), 2)
    assert sorted(tuple(x) for x in r.collect()) == [(1, 0, "A b", "hypothesis"), (1, 1, "c", "c"), (1, 2, "d", "d"), (2, 0, "", "")]


def test_trace_degrades_and_counts(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    docs = spark.createDataFrame([(2, "red fox"), (3, "blue fox"), (9, "red")], "id long, text string")
    frames = {"corpus_vectors": vec, "query_vectors": vec.where("vec_id = 1"), "documents": docs, "queries": spark.createDataFrame([(1, "red")], "query_id long, text string"), "verdicts": spark.createDataFrame([(1, "irrelevant")], "query_id long, verdict string")}
    nodes = (Node("vector_recall", params={"top_k": 2}), Node("keyword_recall"), Node("rrf_fusion"), Node("parent_expand"), Node("verdict_gate"))
    hits, trace = traced(Config(nodes), frames)  # there is no frame of parents
    assert [(t.node, t.status) for t in trace] == [("vector_recall", "ok"), ("keyword_recall", "ok"), ("rrf_fusion", "ok"), ("parent_expand", "failed"), ("verdict_gate", "ok")]
    assert hits.count() == 0 and trace[0].rows == 2 and trace[0].queries == 1 and "parents" in trace[3].error
    fast, trace = traced(Config(nodes), frames, fast=True)
    assert trace[4].status == "skipped" and {r["id"] for r in fast.collect()} == {2, 3, 9}
    bad = frames | {"corpus_vectors": spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<double>")}
    some, trace = traced(Config(nodes[:3]), bad)
    assert [t.status for t in trace] == ["failed", "ok", "ok"] and {r["id"] for r in some.collect()} == {2, 9}
    with pytest.raises(RetrievalUnavailable):
        traced(Config((nodes[0], nodes[2])), bad)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\n\"x\"", None), (2, None, [1, 2])], "a int, b string, c array<int>")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(repr, files.jsonl(spark, str(tmp_path / "j"), rows.schema).collect())) == sorted(map(repr, rows.collect()))
    xml = "<rss><item><title><![CDATA[a <item>b</item> & c]]></title><link>u</link></item><item><title>t</title><description><![CDATA[<p>x</p>]]></description></item></rss>"
    got = files.rss_items(spark.createDataFrame([(1, xml), (2, "<rss/>")], "id long, xml string")).orderBy("pos").collect()
    assert [(r["title"], r["link"], r["description"]) for r in got] == [("a <item>b</item> & c", "u", ""), ("t", "", "<p>x</p>")]


def _stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:03d}"))
    paths = str(tmp_path / "in" / "*")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(paths)


def _at(df):
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000))


def test_timers_end_silent_leases_and_full_buckets(spark, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.with_rocksdb(spark)
    try:
        parts = [[(1, 7, 0, "a", "acquire", 0), (2, 7, 1, "b", "acquire", 0)], [(3, 8, 300, "x", "acquire", 0)], [(4, 7, 400, "a", "beat", 1), (5, 7, 401, "b", "acquire", 0), (6, 7, 402, "b", "done", 2)], [(7, 7, 403, "c", "acquire", 0), (8, 9, 2000, "y", "acquire", 0)]]
        s = _at(_stream(spark, tmp_path / "a", parts, "event_id long, job_id long, s long, worker string, kind string, attempt long"))
        q = timers.leases(s, 10.0, lateness="1 second").writeStream.format("memory").queryName("timed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
        q.awaitTermination(200)
        rows = spark.table("timed").collect()
        got = {r["event_id"]: (r["action"], r["attempt"]) for r in rows if r["event_id"]}
        assert got[1] == ("granted", 1) and got[2] == ("held", 1) and got[3] == ("granted", 1)
        assert got[4][0] == "fenced" and got[5] == ("reclaimed", 2) and got[6] == ("done", 2) and got[7][0] == "closed"
        assert {(r["job_id"], r["attempt"]) for r in rows if r["action"] == "expired"} == {(8, 1)}
        parts = [[(1, 7, 0), (2, 7, 1)], [(3, 8, 50)], [(4, 7, 60), (5, 7, 61)]]
        s = _at(_stream(spark, tmp_path / "b", parts, "event_id long, user_id long, s long"))
        q = timers.token_bucket(s, 0.1, lateness="1 second").writeStream.format("memory").queryName("timed2").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
        q.awaitTermination(200)
        assert {r["event_id"]: r["allowed"] for r in spark.table("timed2").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_backfill_stores_each_batch_once(spark, tmp_path):
    schema = "id long, role string, text string, v int"
    parts = [[(1, "user", "a", 1), (1, "user", "b", 2), (2, "tool", "c", 1)], [(1, "assistant", "d", 3), (3, "user", "e", 1)]]
    s = store.Store(spark, str(tmp_path / "store"), ["id"], ["id"], 3)
    made = lambda rows: backfill.pending(rows, None, ["id"], "size").select("id", F.length("text").alias("size"), "text")
    stream = _stream(spark, tmp_path, parts, schema)
    backfill.upsert(stream, s, made, "fill", str(tmp_path / "c"), ["v"]).awaitTermination(120)
    assert sorted((r["id"], r["text"]) for r in s.read().collect()) == [(1, "d"), (3, "e")]
    before = s.manifest()
    backfill.upsert(stream, s, made, "fill", str(tmp_path / "other"), ["v"]).awaitTermination(120)  # all batches come again
    assert s.manifest() == before
    left = backfill.pending(spark.createDataFrame([(1, "user", "a", 1), (4, "user", "f", 1), (5, "system", "g", 1)], schema), s.read(), ["id"], "size")
    assert [r["id"] for r in left.collect()] == [4]
