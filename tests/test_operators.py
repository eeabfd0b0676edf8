"""Operators on small fixtures: edge cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking, conversation, curation, graph, ranking, recall, tables
from quern.sources import subtitles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rrf_keeps_first_seen_order_on_ties(spark):
    r = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 7), (1, 0, 1, 7), (1, 1, 1, 5)], "query_id int, ranking_id int, rank int, id int")
    got = rows(ranking.rrf(r).select("fused_rank", "id"), "fused_rank")
    assert got == [(1, 5), (2, 7)]
    assert ranking.rrf(r.limit(0)).count() == 0


def test_cosine_of_zero_and_unequal_vectors(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(recall.cosine("a", "b")).collect()] == [0.0, 0.707107]
    bad = spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal"):
        bad.select(recall.cosine("a", "b")).collect()


def merged(units, size, joiner, overlap):
    """Greedy merge, one unit at a time."""
    out, cur = [], ""
    for u in units:
        if len(u) > size:
            out += [cur] if cur else []
            wins = [u[i : i + size] for i in range(0, len(u), max(1, size - overlap))]
            out += wins[:-1]
            cur = wins[-1]
        elif not cur:
            cur = u
        elif len(cur) + len(joiner) + len(u) <= size:
            cur += joiner + u
        else:
            out.append(cur)
            cur = u
    return out + ([cur] if cur else [])


def test_merge_units_against_brute_force(spark):
    cases = [["a" * n for n in ns] for ns in ([3, 4, 5], [25], [9, 1, 10, 11], [], [10, 10], [1] * 30, [4, 25, 3], [31, 2, 2])]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u array<string>")
    for overlap in (0, 3):
        got = {r[0]: r[1] for r in df.select("i", chunking.merged_units(F.col("u"), 10, " ", overlap)).collect()}
        assert got == {i: merged(c, 10, " ", overlap) for i, c in enumerate(cases)}


def test_paragraphs_and_sections(spark):
    text = "# Guide\n\nintro\n## One\nFirst sentence. Second one!\n## Two\n" + "Long words here. " * 100 + "\n## Empty"
    d = spark.createDataFrame([(1, text), (2, "## Only\nbody"), (3, None), (4, "")], "id int, text string")
    got = {i: [r.chunk for r in chunking.section_pieces(d, "manual").where(F.col("id") == i).orderBy("seq").collect()] for i in (1, 2, 3, 4)}
    assert got[1][0] == "【Guide】\n# Guide\n\nintro" and got[1][1] == "【Guide · One】\n## One\nFirst sentence. Second one!"
    assert all(x.startswith("【Guide · Two】\n") and len(x) <= 900 + 20 for x in got[1][2:]) and len(got[1]) == 4
    assert got[2] == ["【manual · Only】\n## Only\nbody"] and got[3] == got[4] == []
    p = spark.createDataFrame([(1, "a\n\nb\n \nccc\n\n" + "d" * 25)], "id int, text string")
    assert [r.chunk for r in chunking.merged_paragraphs(p, 10, 2).orderBy("seq").collect()] == merged(["a", "b", "ccc", "d" * 25], 10, "\n\n", 2)


def test_subtitle_chunks_against_brute_force(spark):
    import random

    rng = random.Random(2)
    cues = [(f, i, i * 1000, i * 1000 + 900, "x" * rng.choice((0, 3, 5, 9, 12, 27))) for f in range(4) for i in range(12)] + [(9, 0, 3_723_000, 3_724_000, "one")]
    want = []
    for f in (0, 1, 2, 3, 9):
        out, lines = [], []
        for _, _, s, e, t in (c for c in cues if c[0] == f and c[4]):
            if len(t) > 12:
                out += [lines] if lines else []
                lines = []
                out += [[(s, e, t[k : k + 12])] for k in range(0, len(t), 12)]
                continue
            if lines and len("\n".join(x[2] for x in [*lines, (s, e, t)])) > 12:
                out.append(lines)
                lines = []
            lines = [*lines, (s, e, t)]
        out += [lines] if lines else []
        want += [(f, k, "\n".join(x[2] for x in g), g[0][0], g[-1][1]) for k, g in enumerate(out)]
    df = spark.createDataFrame(cues, "id int, index int, start_ms int, end_ms int, text string").repartition(3)
    got = rows(chunking.subtitle_chunks(df, 12), "id", "seq")
    assert [r[:5] for r in got] == want
    assert got[-1][5:] == ("1:02:03", "1:02:04")


def test_windows_of_empty_and_null_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "ab  cd")], "id int, text string")
    assert rows(chunking.fixed_windows(d, 900, 150), "id") == [(4, 0, 0, "ab cd")]


def test_page_spec_and_model_key(spark):
    d = spark.createDataFrame([("1,3-5,8",), ("5-3,x,2",), ("",)], "s string")
    assert [r[0] for r in d.select(T.pages_of(F.col("s"))).collect()] == [[1, 3, 4, 5, 8], [2], []]
    m = spark.createDataFrame([("Big-2024-01-02-latest",), ("small",)], "s string")
    assert [r[0] for r in m.select(T.model_key(F.col("s"))).collect()] == ["big", "small"]


def test_qa_pairs_keep_unanswered_questions(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "user", "r"), (1, 3, "assistant", "a"), (1, 4, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert [tuple(r)[:4] for r in conversation.qa_pairs(t).orderBy("pair").collect()] == [(1, 1, "q", ""), (1, 2, "r", "a\nb")]


def test_similar_pairs_against_brute_force(spark):
    sets = {1: "abcd", 2: "abce", 3: "xyz", 4: "abcdef", 5: "xy"}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id int, grams array<string>")
    got = {(r.a, r.b) for r in curation.similar_pairs(df, 600).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert got == want


def test_similar_sets_of_common_grams_make_few_candidates(spark):
    """Sets over a small vocabulary, of which most pairs share some gram of any prefix, and a few near copies of several sizes; the prefix
    join made a candidate of nearly every pair."""
    import random

    rng = random.Random(3)
    sets = {i: set(rng.sample(range(400), rng.choice((40, 60, 130)))) for i in range(1200)}
    for i in range(0, 60, 2):  # 0.8 is just reached by taking away a fifth of the grams
        sets[2000 + i] = set(sorted(sets[i])[: -(-len(sets[i]) * (8 if i % 4 else 7) // 10)])
    df = spark.createDataFrame([(i, [f"g{x}" for x in s]) for i, s in sets.items()], "id int, grams array<string>")
    cand = curation.near_sketches(curation.sketches(df), 800).collect()
    ids = sorted(sets)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in cand} >= want and len(cand) < 3000 and len(cand) == len({(r.a, r.b) for r in cand})
    got = curation.similar_pairs(df, 800)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) >= 15


def test_similar_lines_against_brute_force(spark):
    """All lines of the smallest table, whatever their length: pairs at 0.8 and components of all lines."""
    from quern.plans import curated

    d = "/root/testdata/sf0.001"
    lines = {x for r in spark.read.parquet(f"{d}/documents.parquet").collect() for x in (r.text or "").split("\n") if x}
    import hashlib

    ids = {hashlib.md5(x.encode()).hexdigest(): frozenset(x[i : i + 4] for i in range(max(1, len(x) - 3))) for x in lines}
    by_set = {}
    for i in sorted(ids):
        by_set.setdefault(ids[i], []).append(i)
    reps = sorted(((v[0], k) for k, v in by_set.items()), key=lambda x: len(x[1]))
    want = set()
    for n, (a, x) in enumerate(reps):
        for b, y in reps[n + 1 :]:
            if 1000 * len(x) < 800 * len(y):
                break
            both = len(x & y)
            if both * 1000 >= (len(x) + len(y) - both) * 800:
                want.add((min(a, b), max(a, b)))
    got = {(r.a, r.b) for r in curated.near_dup_pairs(spark, d).collect()}
    assert got == want and len(want) > 20
    comp = {r.node: r.component for r in curated.dup_components(spark, d).collect()}
    assert all(comp[a] == comp[b] for a, b in want) and all(comp[i] == comp[v[0]] for v in by_set.values() if len(v) > 1 for i in v)
    assert set(comp) == {x for p in want for x in p} | {i for v in by_set.values() if len(v) > 1 for i in v}


def test_visibility_of_public_and_owned(spark):
    a = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 12, 6), (4, 12, None), (5, None, None)], "asset_id long, owner_id long, workspace_id long")
    w = spark.createDataFrame([(5, 20), (6, 11)], "workspace_id long, owner_id long")
    m = spark.createDataFrame([(5, 10), (5, 10), (6, 99)], "workspace_id long, user_id long")
    g = spark.createDataFrame([(3, None), (4, 10), (7, None)], "asset_id long, grantee_id long")
    u = spark.createDataFrame([(10,), (11,), (20,)], "user_id long")
    got = {(r.user_id, r.asset_id) for r in tables.visible(a, w, m, g, u).collect()}
    assert got == {(10, 1), (11, 2), (10, 2), (20, 1), (20, 2), (11, 3), (None, 3), (10, 4)}
    c = spark.createDataFrame([(1, 1, None), (2, None, None), (3, None, 10), (4, 5, None), (5, 3, None)], "chunk_id long, asset_id long, owner_id long")
    assert {(r.user_id, r.chunk_id) for r in tables.visible_chunks(c, tables.visible(a, w, m, g, u), u).collect()} == {(10, 1), (20, 1), (None, 2), (10, 3), (11, 5), (None, 5)}


def test_percentiles_of_few_and_equal_values(spark):
    from quern.operators import evaluation

    d = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 5.0)] + [("b", 7.0), ("c", None)], "k string, v double").repartition(3)
    assert rows(evaluation.nearest_rank(d, ["k"], "v", 0.5), "k") == [("a", 1.0), ("b", 7.0)]
    assert rows(evaluation.interpolated(d, ["k"], "v", [0.5, 0.95]), "k") == [("a", 1.0, 4.4), ("b", 7.0, 7.0)]


def test_files_and_logs(spark, tmp_path):
    from quern.sources import files

    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi\x07 \xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    assert sorted(r.text for r in files.plain_text(spark, f"{tmp_path}/*.txt").collect()) == ["café", "hi é"]
    t = spark.createDataFrame([("word,a thing,3,x",), ("other",), (",no word",)], "line string")
    assert rows(files.terms(t), "word") == [("other", "", 1, 1), ("word", "a thing", 3, 1)]
    log = [("f", i, x) for i, x in enumerate(["stack of the last file", "2024 ERROR bad", "  at x", "2024 INFO fine", "2025 ERROR again"])]
    assert [r.text for r in files.log_entries(spark.createDataFrame(log, "file string, pos int, line string"), ["ERROR"]).orderBy("entry").collect()] == ["2024 ERROR bad\n  at x", "2025 ERROR again"]
    spark.createDataFrame([(1, "é")], "i int, t string").coalesce(1).write.json(str(tmp_path / "j"))
    assert rows(files.jsonl(spark, str(tmp_path / "j"), "i int, t string"), "i") == [(1, "é")]


def test_context_carried_anchors_and_edges(spark):
    c = spark.createDataFrame([(1, 0, "raw"), (1, 1, "two")], "id int, seq int, chunk string")
    x = spark.createDataFrame([(1, 0, "about")], "id int, seq int, context string")
    assert rows(chunking.contextualized(c, x), "id", "seq") == [(1, 0, "about\nraw", "raw"), (1, 1, "two", "two")]
    e = spark.createDataFrame([("a", "b", "k"), ("a", "b", "k"), ("a", "z", "k"), (None, "b", "k")], "src string, dst string, kind string")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in graph.edges_between(e, n).select("src", "dst").collect()] == [("a", "b")]


def test_components_and_closure_survive_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9), (5, 5)], "a long, b long")
    assert rows(curation.connected(e), "node") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert rows(graph.closure(g, spark.createDataFrame([("a",)], "id string")).select("node", "depth"), "node") == [("b", 1), ("c", 2)]


def test_overlaps_across_buckets_are_found_once(spark):
    l = spark.createDataFrame([(1, 10, 0, 25)], "k int, id int, s long, e long")
    r = spark.createDataFrame([(1, 20, 5, 29), (1, 21, 25, 40), (1, 22, 26, 30)], "k int, id int, s long, e long")
    assert rows(tables.overlapping(l, r, "k", 10).select("right_id"), "right_id") == [(20,), (21,)]


def test_redaction_and_missing_parts(spark):
    d = spark.createDataFrame([({"api_key": "x", "name": "n"}, [True, False, True, False])], "m map<string,string>, b array<boolean>")
    r = d.select(tables.redacted(F.col("m")).alias("m"), tables.missing_parts(F.col("b")).alias("b")).first()
    assert r["m"] == {"api_key": "***", "name": "n"} and r["b"] == [1, 3]


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\n there\n\n2\n00:00:03,000 --> 00:00:04,000\n\n"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<b>Hi</b>\n\n01:00:00.000 --> 01:00:01.000\nyo\n"
    lrc = "[00:01.50]one\n[00:03.00]\n[00:04.00]two\n"
    d = spark.createDataFrame([(1, srt), (2, vtt), (3, lrc)], "id int, text string")
    assert rows(subtitles.srt(d.where("id = 1")).select("start_ms", "end_ms", "text"), "start_ms") == [(1000, 2500, "Hello there")]
    assert rows(subtitles.vtt(d.where("id = 2")).select("start_ms", "end_ms", "text"), "start_ms") == [(1000, 2000, "Hi"), (3600000, 3601000, "yo")]
    assert rows(subtitles.lrc(d.where("id = 3")).select("start_ms", "end_ms", "text"), "start_ms") == [(1500, 3000, "one"), (4000, 7000, "two")]


def test_unicode_functions(spark):
    from quern.functions import unicode as U

    d = spark.createDataFrame([("Ｆｕｌｌ “Quoted” 12", "x"), ("Straße  ΣΊΣΥΦΟΣ", None), ("你好，世界一二三四五六七八九", "en"), (None, "zh")], "t string, l string")
    got = d.select(U.bare("t"), U.normal("t"), U.casefolded("t"), U.resolved_language(F.col("l"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["fullquoted12", "straßeσίσυφος", "你好世界一二三四五六七八九", ""]
    assert got[0][1] == "full quoted 12" and got[1][2] == "strasse σίσυφοσ" and [r[3] for r in got] == ["en", "en", "en", "zh"]
    same = spark.createDataFrame([('Find "abc" in 12 docs now please',), ("find 'xyz' in ９９ Docs NOW quickly",)], "t string").select(U.family(F.col("t"))).distinct()
    assert same.count() == 1
    b = spark.createDataFrame([("é".encode("latin-1"), None), ("é".encode(), None), ("你".encode("gb18030"), "utf-8"), (b"\xe4", "ascii"), (None, None)], "b binary, c string")
    assert [r[0] for r in b.select(U.decoded("b", "c")).collect()] == ["é", "é", "你", "ä", None]
    a = spark.createDataFrame([(x,) for x in ("10.1.2.3", "::ffff:127.0.0.1", "8.8.8.8", "2001:4860::1", "fe80::1", "no", None)], "a string")
    assert [r[0] for r in a.select(U.blocked_address("a")).collect()] == [True, True, False, False, True, True, True]
    j = spark.createDataFrame([('{"a": {"api_key": 1, "b": [{"Token": "x"}]}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in j.select(U.redacted_json("j")).collect()] == ['{"a": {"api_key": "***", "b": [{"Token": "***"}]}}', "no json", None]


def test_extractors_feeds_and_tails(spark):
    from quern.sources import files

    d = spark.createDataFrame([("x/a.TXT", b"hi\x07"), ("b.html", b"<p>yo</p>"), ("c.exe", b"MZ")], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in files.extracted(d).collect()}
    assert got == {"x/a.TXT": ("hi", None), "b.html": ("yo", None), "c.exe": (None, "no extractor for .exe")}
    xml = "<rss><channel><item><title>One</title><link>http://a</link></item><item><title>Two</title><description>d</description></item></channel></rss>"
    f = spark.createDataFrame([(1, xml), (2, "<rss><channel/></rss>")], "id int, xml string")
    assert rows(files.rss_items(f), "id", "pos") == [(1, 0, "One", "http://a", ""), (1, 1, "Two", "", "d")]
    t = spark.createDataFrame([("f", b"first line\nsecond\nthird"), ("g", b"short")], "path string, content binary")
    assert rows(files.log_tail(t, 14).select("file", "line"), "file", "line") == [("f", "second"), ("f", "third"), ("g", "short")]


def test_redirects_and_small_functions(spark):
    d = spark.createDataFrame([("https://a.find.example/url?sa=t&q=https%3A%2F%2Fb.org%2Fx%3Fy%3D1",), ("https://a.find.example/?q=javascript:1&url=http%3A%2F%2Fc.org",), ("https://other.org/?q=http%3A%2F%2Fc.org",), ("https://a.find.example/about",)], "u string")
    assert [r[0] for r in d.select(T.redirect_target(F.col("u"), ("find.example",))).collect()] == ["https://b.org/x?y=1", "http://c.org", "https://other.org/?q=http%3A%2F%2Fc.org", "https://a.find.example/about"]
    s = spark.createDataFrame([("I do not want",), ("knot and notable",), ('{"a": 1}',), ("[note] x",), (" plain ",)], "s string")
    assert [r[0] for r in s.select(T.negated(F.col("s"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in s.select(T.pure(F.col("s"))).collect()] == [True, True, False, False, True]
