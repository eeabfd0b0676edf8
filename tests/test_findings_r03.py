"""Steps that findings of round 3 named: what is shuffled, beside the results."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quern.llm import html_extraction, substring_dedup, token_store
from quern.operators import graph, recall
from quern.plans import memory


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_made_distinct_without_a_shuffle_of_their_own(spark):
    edges = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (1, 10, 6), (2, 11, 5), (9, 10, 5), (1, 99, 5), (None, 10, 5)], "src long, dst long, kind long")
    nodes, targets = spark.createDataFrame([(1,), (2,), (99,)], "id long"), spark.createDataFrame([(10,), (11,), (9,)], "id long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = nodes.union(targets)
        assert not re.search(r"hashpartitioning\(\w+#\d+L?, \w+#\d+L?, \w+#\d+L?,", plan_of(graph.edges_between(edges, both)))
        assert sorted(tuple(r[c] for c in ("src", "dst", "kind")) for r in graph.edges_between(edges, both).collect()) == [(1, 10, 5), (1, 10, 6), (1, 99, 5), (2, 11, 5), (9, 10, 5)]
        assert sorted(tuple(r[c] for c in ("src", "dst", "kind")) for r in graph.edges_between(edges, nodes, targets).collect()) == [(1, 10, 5), (1, 10, 6), (2, 11, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_lines_of_routing_are_shuffled_as_hashes(spark):
    plan = plan_of(memory.cascade_routing(spark, "/root/testdata/sf0.001"))
    assert not re.search(r"(partitioning\(|SortMergeJoin \[|HashedRelationBroadcastMode\(List\(input\[[0-9], )(line|string)", plan)


def test_items_are_judged_without_their_findings(spark):
    """Long findings are read where they are stored only; a batch that is judged anew takes the marks of before."""
    f = "array<struct<source_id: long, verdict: string, text: string>>"
    items = spark.createDataFrame([("i1", 1, [(1, "supports", "x" * 30)]), ("i1", 2, [(1, "supports", "y" * 30)]), ("i2", 1, [])], f"item_id string, claim_id long, findings {f}")
    claims = spark.createDataFrame([(1, True), (2, True)], "claim_id long, gate_ok boolean")
    none = spark.createDataFrame([], "claim_id long, fingerprint string")
    m = graph.marked(items)
    x = graph.judged(m, claims, none)
    assert not re.search(r"Exchange[^\n]*\n[^\n]*findings", plan_of(x)) and "findings" not in x.columns
    assert sorted((r.item_id, r.claim_id, r.status, r.reason) for r in x.collect()) == [("i1", 1, "verified", None), ("i1", 2, "rejected", "duplicate item id"), ("i2", 1, "rejected", "no findings")]
    base = x.where("status = 'verified'").select("claim_id", "fingerprint")
    sources = spark.createDataFrame([(1, True)], "source_id long, usable boolean")
    results, stored = graph.verified_batch(m, claims, sources, base, 20)
    assert sorted(r.status for r in results.collect()) == ["rejected", "rejected", "skipped"] and stored.isEmpty()


def test_keyword_scores_hold_arrow_rows_only(spark):
    """Documents without a term, without a text and with ids of their own type, in two scopes."""
    docs = spark.createDataFrame([("a", "red fox red", "s"), ("b", "", "s"), ("c", None, "s"), ("d", "blue", "s"), ("e", "red", "t"), ("f", "fox", None)], "id string, text string, user string")
    queries = spark.createDataFrame([(1, "red fox", "s"), (2, "red", "t"), (3, "none", "s")], "query_id int, text string, user string")
    got = recall.bm25(docs, queries, 2, scope="user")
    assert "MapInPandas" not in plan_of(got)
    assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == [(1, "a", 1), (2, "e", 1)]
    assert sorted((r.query_id, r.id) for r in recall.bm25(docs, queries, 3).collect()) == [(1, "a"), (1, "e"), (1, "f"), (2, "a"), (2, "e")]


def test_edited_repeats_in_a_crowd(spark):
    """F8: a sentence of 43 words that many documents hold goes on alike in two of them each, one of which has a word more between."""
    rng = random.Random(21)
    common = sentence(rng, 43)
    texts = [f"{sentence(rng, 40)} {common} {sentence(rng, 40)}" for _ in range(120)]
    pairs = []
    for k in range(40):
        own, more = sentence(rng, 8), sentence(rng, 1)
        pairs.append((len(texts), len(texts) + 1))
        parts = [[common, own], [common, more, own]] if k % 2 else [[own, common], [own, more, common]]
        texts += [" ".join([sentence(rng, 30), *p, sentence(rng, 30)]) for p in parts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert all(a in got and b in got and got[a].class_id == got[b].class_id == a for a, b in pairs)
    assert set(got) == {x for p in pairs for x in p}
    assert all(51 <= r.n_repeat_words <= 53 for r in got.values())


def test_only_pages_that_read_a_template_are_shuffled(spark):
    """Check of op4: a menu that says what it is and what stands beside an article are counted, but change no page's text."""
    page = "<body><nav><ul><li>menu</ul></nav><div>beside</div><article><p>text {}</p><div>more {}</div></article></body>"
    bare = "<body><div>beside</div><p>bare {}</p></body>"
    rows = [(i, "http://a.b/x", page.format(i, i)) for i in range(12)] + [(20 + i, "http://a.b/y", bare.format(i)) for i in range(6)] + [(30, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = html_extraction.parse(page.format(1, 1))
    html_extraction.digests(root)
    names = {html_extraction._number(x): x.tag for x in html_extraction._nodes(root)}
    assert {names[x] for x in html_extraction.read_nodes(root)} == {"p", "div"} and len(html_extraction.read_nodes(root)) == 2
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert len(got) == len(rows) and got[30] == ""
    assert all(got[i] == f"text {i}\nmore {i}" for i in range(12))
    assert all(got[20 + i] == f"bare {i}" for i in range(6))  # the box beside articles is their template


def test_chunks_end_where_the_sum_over_eight_ids_says():
    """Check of op9: the window's hash by doubling is that of its eight terms, and ids of texts of known units those of new ones."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 9, 3000):
        ids = rng.integers(0, 50000, n).astype(np.uint32)
        g = token_store._mixed(ids)
        h = g.copy()
        for j in range(1, 8):
            h[j:] += g[:-j] << np.uint64(5 * j)
        h ^= h >> np.uint64(32)
        assert token_store.chunk_ends(ids) == sorted({*(np.flatnonzero(h % np.uint64(512) == 0) + 1).tolist(), n})
    e = token_store.Encoder(token_store.default_tokenizer())
    texts = ["one two  three\n", None, "", "one two", "zażółć 17%", "日本 one"]
    first = [x.tolist() for x in e.encode_many(texts)]
    assert [x.tolist() for x in e.encode_many(texts)] == first == [[*e.tk.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
