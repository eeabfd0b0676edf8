"""Findings of the third round's review, each with what failed before."""

from collections import defaultdict

from pyspark.sql import functions as F

from quern.operators import chunking, curation, evaluation, recall, segment, tables
from quern.sources import subtitles


def _drive(spark):
    """Assets in one workspace, in two, in none and without an id; members twice over, grants to members, to others and to all."""
    a = [(i, 10 + i % 4, 1 + i % 3) for i in range(40)] + [(3, 11, 2), (40, 12, None), (41, None, 3), (None, 10, 1), (None, 10, 2), (5, 10 + 5 % 4, 1 + 5 % 3)]
    w = [(1, 10), (2, 11), (3, 99)]
    m = [(1, 10), (1, 11), (2, 10), (3, 12), (3, 12), (None, 13)]
    g = [(i, 10 + i % 5) for i in range(0, 40, 3)] + [(7, None), (7, None), (77, 10), (41, 13)]
    u = list(range(10, 14))
    frames = (spark.createDataFrame(a, "asset_id long, owner_id long, workspace_id long"), spark.createDataFrame(w, "workspace_id long, owner_id long"), spark.createDataFrame(m, "workspace_id long, user_id long"), spark.createDataFrame(g, "asset_id long, grantee_id long"), spark.createDataFrame([(x,) for x in u], "user_id long"))
    rooms = {(x, y) for x, y in [(o, k) for k, o in w] + [(x, k) for k, x in m] if x in u and y is not None}
    want = {(o, i) for i, o, _ in a if o in u} | {(x, i) for i, _, k in a for x, y in rooms if y == k}
    want |= {(x, i) for i, x in g if i is not None and (x in u or x is None) and i in {i for i, _, _ in a}}
    return frames, want


def test_visible_pairs_once_without_a_shuffle_of_pairs(spark):
    frames, want = _drive(spark)
    v = tables.visible(*frames)
    got = [tuple(r) for r in v.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # members meet assets above the last shuffle: before, all pairs were shuffled for one distinct
    top = v._jdf.queryExecution().optimizedPlan().toString().lstrip().split("\n")[0]
    assert top.startswith("Union"), top


def test_visible_pairs_are_spread(spark):
    """Few assets and many members make many pairs in many tasks, though both sides are small."""
    a = spark.range(200).select(F.col("id").alias("asset_id"), (F.col("id") + 10**6).alias("owner_id"), F.lit(1).cast("long").alias("workspace_id"))
    m = spark.range(3000).select(F.lit(1).cast("long").alias("workspace_id"), F.col("id").alias("user_id"))
    v = tables.visible(a, m.where("false").toDF("workspace_id", "owner_id"), m, a.where("false").select("asset_id", F.col("owner_id").alias("grantee_id")), m.select("user_id"))
    sizes = [r["count"] for r in v.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600_000 and max(sizes) < 60_000


def test_chunk_totals_are_those_of_visible_chunks(spark):
    frames, want = _drive(spark)
    c = [(i, i % 45, None) for i in range(300)] + [(300 + i, None, 9 + i % 6) for i in range(20)] + [(400, None, None), (401, None, None), (400, None, None), (7, 7, None)]
    chunks = spark.createDataFrame(c, "chunk_id long, asset_id long, owner_id long")
    got = {tuple(r) for r in tables.visible_chunk_totals(chunks, tables.visible_classes(*frames), frames[4], {"ids": F.col("chunk_id")}).collect()}
    by = defaultdict(set)
    for r in tables.visible_chunks(chunks, tables.visible(*frames), frames[4]).collect():
        by[r.user_id].add(r.chunk_id)
    assert got == {(u, len(s), sum(s)) for u, s in by.items()} and len(got) == 5


def test_units_keep_digits_of_their_place(spark):
    """A unit's place was taken for the characters to trim."""
    d = spark.createDataFrame([(1, "\n".join(f"{i}{i} sentence {i}" for i in range(12)))], "id long, text string")
    assert [r.unit for r in chunking.sentences(d).orderBy("seq").collect()] == [f"{i}{i} sentence {i}" for i in range(12)]
    assert chunking.merged_sentences(d, 1000).first().chunk == " ".join(f"{i}{i} sentence {i}" for i in range(12))
    f = spark.createDataFrame([(1, "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n1st of 1\n2 more")], "id int, text string")
    assert [r.text for r in subtitles.vtt(f).collect()] == ["1st of 1 2 more"]


def test_shared_grams_in_blocks(spark, monkeypatch):
    """Every match was a row of a join; blocks of the index and of rows give the same pairs."""
    texts = ["the cat sat", "the cat sat on", "a\U0001f600b\nc the cat", "xyz", "", "the the the the", None]
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "id string, text string").select("id", curation.grams(F.col("text"), 4).alias("grams"))
    q = t.select(F.substring("id", 2, 1).cast("long").alias("id"), "grams")
    cut = [sorted({x[i : i + 4] for i in range(max(1, len(x) - 3))}) for x in texts if x is not None]
    assert [sorted(r.grams) for r in t.where("grams[0] is not null").orderBy("id").collect()] == cut
    want = {(f"t{i}", j, len(set(a) & set(b))) for i, a in enumerate(cut) for j, b in enumerate(cut) if len(set(a) & set(b)) >= 2}
    for size in (1 << 21, 3):
        monkeypatch.setattr(curation, "POSTINGS", size)
        monkeypatch.setattr(curation, "MATCHES", size)
        p = curation.shared_gram_pairs(t, q, 2)
        assert {(r.train_id, r.test_id, r.shared) for r in p.collect()} == want and len(want) > 5
        assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_all_tokens_without_a_join(spark):
    """A common token's documents met every query that has it."""
    d = spark.createDataFrame([(i, f"common w{i % 7} w{i % 5}") for i in range(70)] + [(70, None), (71, "")], "id long, text string")
    q = spark.createDataFrame([(1, "common w3"), (2, "w2 w4 common w2"), (3, "w6 unknown"), (4, ""), (5, None), (6, "w3"), (6, "w4")], "query_id long, text string")
    words = lambda i: {"common", f"w{i % 7}", f"w{i % 5}"}
    need = {1: {"common", "w3"}, 2: {"w2", "w4", "common"}, 6: {"w3", "w4"}}
    p = recall.all_tokens(d, q)
    assert sorted(tuple(r) for r in p.collect()) == sorted((k, i) for k, n in need.items() for i in range(70) if n <= words(i))
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_scores_at_once_are_bounded(spark, monkeypatch):
    """Rows at once fall with the number of queries and with their postings; results stay."""
    assert recall._rows(1) == recall.ROWS and recall._rows(4096) * 4096 <= recall.CELLS and recall._rows(10**7) == 1
    d = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 9))) for i in range(60)], "id long, text string")
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    far = lambda: (recall.bm25(d, d.toDF("query_id", "text"), 4).collect(), recall.cosine_top_k(e, e, 4).collect(), recall.masked_top_k(e, e, 4).collect())
    whole = [sorted(x) for x in far()]
    monkeypatch.setattr(recall, "CELLS", 100)
    assert [sorted(x) for x in far()] == whole


def test_token_counts_in_parts(spark, monkeypatch):
    texts = ["你好世界 hello Hello 世", "", None, "世界你好abc", "plain words words"] * 30
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(r.id, r.token): r.n for r in d.select("id", F.explode(segment.segmented(F.col("text"), ["你好"])).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(segment, "TEXTS", 7)
    assert {(r.id, r.token): r.tf for r in segment.token_counts(d, ["你好"]).collect()} == want


def test_class_metrics_are_ranking_metrics(spark):
    """A query met all rows of its class: as many pairs as queries times rows."""
    rows = spark.createDataFrame([(i, i // 3, None if i == 8 else i * i % 5) for i in range(30)] + [(30, 99, 77)], "id long, item long, cls int")
    q = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"))
    hits = spark.createDataFrame([(i, r, (i + r * r) % 11) for i in range(0, 31, 2) for r in range(1, 9)], "query_id long, rank int, item long")
    rel = q.join(rows.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "cls").join(rows, "cls").where("id <> query_id").select("query_id", "item")
    got = evaluation.class_metrics(hits, rows, q, 4)
    assert sorted(got.collect()) == sorted(evaluation.ranking_metrics(hits, rel, 4).collect()) and got.count() == 14
