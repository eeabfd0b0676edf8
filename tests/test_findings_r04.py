"""What findings of round 4 named, each with what failed before."""

import random
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import substring_dedup
from quern.llm.common import bucketed, released
from quern.operators import chunking, curation, tables
from quern.plans import texts


def test_sections_of_odd_texts_match_their_sql(spark, tmp_path):
    """blank and empty texts, other line ends and lines that are markdown headings already."""
    odd = ["", " ", "\n", "\nTitle\nbody", "  \nTwo", "Title\rTwo", "Title\r\nTwo\r", "a T\nT\u0085Tail", "## own\nbody\nT", "x\n## Tea\nTea\n", "Tom\n\nTim", "T", "\n\nT\n\n", "a## b\nT## c", "\\## T", None]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT id, sections, titled, title_chars FROM ({texts.ORACLE_SQL['markdown_sections']}) ORDER BY id").fetchall()
    got = [tuple(r) for r in texts.markdown_sections(spark, d).orderBy("id").collect()]
    assert got == want and len(want) == len(odd) - 1


def test_blank_beginnings_of_sections(spark):
    d = spark.createDataFrame([(1, "\n## A\nb"), (2, "")], "id long, text string")
    assert [(r.id, r.seq, r.title) for r in chunking.sections(d).collect()] == [(1, 0, "A")]
    assert [(r.id, r.seq, r.title) for r in chunking.sections(d, blank=True).orderBy("id", F.col("seq")).collect()] == [(1, 0, ""), (1, 1, "A"), (2, 0, "")]


def test_sequences_are_shuffled_once(spark):
    """texts lie in buckets of their mark, so verification shuffles pairs and regions only; what is released leaves no table and no file."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(60))) for i in range(9)], "doc_id long, text string")
    marks = docs.select(substring_dedup._mark("text").alias("mark"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = bucketed(substring_dedup.sequences(docs, marks), "sequences", "mark")
        m = sorted({r.mark for r in marks.collect()})
        pairs = spark.createDataFrame([(a, b, [(0, 55, 0, 55)]) for a in m for b in m if a < b], "a long, b long, regions array<struct<la: int, ra: int, lb: int, rb: int>>")
        found = substring_dedup.verified(pairs, texts, 50)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # of pairs by b and by a; the texts' were two more
        assert "Bucketed: true" in plan and found.isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    where, name = texts._saved_at.removeprefix("file:"), texts._saved_as
    assert Path(where).exists() and spark.catalog.tableExists(name)
    released(texts)
    assert not Path(where).exists() and not spark.catalog.tableExists(name)


def test_cells_of_like_sums_meet_only_near_ones(monkeypatch):
    """sets of two languages and several classes of sizes; no pair is lost, however small blocks, cells and tiles are, and rows of
    far cells are not compared."""
    rng = random.Random(4)
    words = [[rng.getrandbits(64) for _ in range(900)] for _ in range(2)]
    sets = [set(rng.sample(words[i % 2], rng.choice((30, 53, 54, 60, 158, 170, 290, 420)))) for i in range(240)]
    for i in range(0, 80):  # from equal but for one gram to just 0.8, over the ends of classes
        x = sorted(sets[i])
        sets.append(set(x[: len(x) - 1 - i % 4 * len(x) // 15]))
        sets.append(set(x[: -(-len(x) * 8 // 10)]))
    hashes = [np.array(sorted(x), np.uint64) for x in sets]
    most, bits = curation.size_classes(800), curation.sketch_words(800)
    rows = curation._sketched(pa.array(range(len(sets)), pa.int64()), hashes, curation.sketch_axes(hashes[:100]), most, bits)
    monkeypatch.setattr(curation, "SKETCH_TILE", 256)
    monkeypatch.setattr(curation, "SKETCH_ROWS", 32)
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, out: (compared.append(x.size), count(x, out=out))[1])
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b])}
    whole = pa.Table.from_batches([rows])
    for side in (np.zeros(len(sets), np.int32), 1 + (np.arange(len(sets)) >= 240).astype(np.int32)):
        got = curation.near_pairs(800)(whole.append_column("side", pa.array(side)))
        pairs = {tuple(sorted(p)) for p in zip(got["a"].to_pylist(), got["b"].to_pylist())}
        assert len(pairs) == got.num_rows and pairs >= {p for p in want if not side.any() or side[p[0]] != side[p[1]]} and len(pairs) < 2 * len(want)
    assert len(want) > 100 and sum(compared) < len(sets) ** 2 * 1.2  # words compared: of all pairs of like sizes half are of one language


def test_similar_texts_of_any_characters(spark):
    """sets as numbers and as strings, of short texts, of characters beyond 16 bits and of their mixtures."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde \u00e9\u65e5") for _ in range(60)) for _ in range(12)]
    texts = base + [x + "zzz" for x in base] + [x[:30] + "\U0001f600" + x[30:] for x in base[:6]] + [x[:-2] + "\U0001f600" for x in base] + ["abc", "ab", "abcd", "abcdabcd", "aaaa", "aaaaa", "\U0001f600", "x\U0001f600yz", "\uffff\uffff\uffff\uffff"]
    sets = [frozenset(t[i : i + 4] for i in range(max(1, len(t) - 3))) for t in texts]
    assert [len(curation.gram_set(t, 4)) for t in texts] == [len(x) for x in sets]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    reps, members = curation.distinct_sets(df, 4)
    least = {}
    for i, x in enumerate(sets):
        least.setdefault(x, i)
    assert {(r.id, r.rep) for r in members.collect()} == {(i, least[x]) for i, x in enumerate(sets)}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(sorted(least.values()), 2) if 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b])}
    assert {(r.a, r.b): r.jaccard for r in curation.similar_texts(reps, 4, 800).collect()} == want and len(want) > 20


def test_rooms_come_from_one_aggregation(spark):
    """assets of one workspace are found without a join of assets with themselves."""
    a = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (2, 5, 10), (2, 6, 10), (3, None, 10), (4, None, 11), (4, 6, 11), (None, 5, 10)], "asset_id long, workspace_id long, owner_id long")
    w = spark.createDataFrame([(5, 20), (6, 21)], "workspace_id long, owner_id long")
    none = spark.createDataFrame([], "workspace_id long, user_id long")
    grants = spark.createDataFrame([], "asset_id long, grantee_id long")
    u = spark.createDataFrame([(10,), (11,), (20,), (21,)], "user_id long")
    rooms, _, _ = tables.visible_classes(a, w, none, grants, u)
    assert "Join" not in rooms._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.asset_id, r.workspace_id) for r in rooms.collect()) == [(1, 5), (4, 6)]
    got = [(r.user_id, r.asset_id) for r in tables.visible(a, w, none, grants, u).collect()]
    assert sorted(got, key=str) == sorted([(10, 1), (10, 2), (10, 3), (10, None), (11, 4), (20, 1), (20, 2), (20, None), (21, 2), (21, 4)], key=str)
