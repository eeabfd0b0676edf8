"""Importance resampling, line quality and whitening against slow versions, and their edges."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import importance, line_quality, whitening

CLASH = ["digest", "copies", "words", "at", "score", "weight", "n_words", "n_features", "rank", "before", "x", "id", "text_", "y", "n"]


def slow_resampling(docs, target, percent=10, least=20, longest=1, buckets=10000, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, x in docs:
        for f in features(x)[1]:
            s[at(f)] += 1
    for x in target:
        for f in features(x)[1]:
            t[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t.size + s.sum()) / ((s[b] + 1) * (t.sum() + t.size)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[at(v)] for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, r in enumerate(rows) if r[4] >= least)
    rank = {k: n + 1 for n, (*_, k) in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "délta", "x1", "42", "Ünder", "_", "--", "naïve", "日本"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 40, 90]))) for _ in range(120)]
    return base + [base[7]] * 40 + [None, "", " \n", "A-B_C", "word " * 30000]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_a_slow_version(spark, texts, longest):
    docs = list(enumerate(texts)) + [(None, texts[7]), (None, texts[7]), (3, texts[3])]
    target = [texts[2], texts[9], None, "alpha délta x1 x1"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = slow_resampling(docs, target, percent=30, longest=longest)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(1 for r in want if r[4])))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert importance.resampled(none, one).count() == 0
    (r,) = importance.resampled(one, none).collect()
    assert r["weight"] == slow_resampling([(1, "few words")], [])[0][2] and r["rank"] is None


def slow_marginals(odds, links):
    """Marginals of good, pair expectations and log normaliser of one chain by all labellings."""
    n = len(odds)
    total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        w = math.exp(sum(o for o, v in zip(odds, y) if v) + sum(links[a][b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return good / total, pairs / total, math.log(total)


def test_chains_equal_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 3, 1, 7, 2, 7])
    odds, links = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    good, pairs, z = line_quality.chains(odds, sizes, links)
    at, want = 0, np.zeros((2, 2))
    for k, n in enumerate(sizes):
        g, p, total = slow_marginals(odds[at : at + n], links)
        assert np.allclose(good[at : at + n], g) and abs(z[k] - total) < 1e-9
        want, at = want + p, at + n
    assert np.allclose(pairs, want)
    assert len(line_quality.chains(np.zeros(0), np.zeros(0, np.int64), links)[0]) == 0
    far = line_quality.chains(np.full(50_000, 3.0), np.array([50_000]), links)[0]
    assert np.isfinite(far).all() and far.min() >= 0


def test_line_counts_do_not_depend_on_pieces(monkeypatch):
    texts = ["a B\n\n12 #! é日 -", "", "x" * 50 + "\n" + "y z" * 40, "\n\n", "one one two.\none one two."]
    whole, sizes = line_quality.line_stats(texts)
    assert sizes.tolist() == [3, 1, 2, 3, 2]
    for chunk in (1, 7, 64):
        monkeypatch.setattr(line_quality, "CHUNK", chunk)
        assert np.array_equal(line_quality.line_stats(texts)[0], whole)
    each = np.concatenate([line_quality.line_stats([t])[0] for t in texts])
    assert np.array_equal(each, whole)


def _labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_quality(spark):
    docs, labels = _labelled(spark)
    field = line_quality.fit(*line_quality.sampled(docs, labels))
    rows = line_quality.scored(docs, field).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert len(rows) > 40 and bad
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_the_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = _labelled(spark)
    stats, sizes, y = line_quality.sampled(docs, labels, max_docs=50, max_lines=200)
    assert len(sizes) <= 50 and sizes.sum() <= 200 and len(y) == len(sizes) and len(stats) == sizes.sum()
    held = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(1)))
    assert len(line_quality.sampled(docs, held)[1]) == 0


def test_scores_of_odd_texts(spark):
    docs, labels = _labelled(spark)
    field = line_quality.fit(*line_quality.sampled(docs, labels, max_docs=100))
    rows = [(1, None), (2, ""), (3, "\n" * 5000), (4, "w " * 400_000), (5, "same"), (None, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in CLASH + ["lang", "source", "quality"]})
    got = line_quality.scored(df, field).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, _ in rows}
    assert len({r["score"] for r in got if r["doc_id"] in (5, None)}) == 1 and got[0]["score"] == got[1]["score"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = line_quality.fit(*line_quality.sampled(docs, none))
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in line_quality.scored(df, flat).collect())
    assert line_quality.scored(df.where("doc_id > 99"), field).count() == 0
    only = spark.createDataFrame([(d, 1, 0) for d in range(40)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.9 for r in line_quality.scored(docs, line_quality.fit(*line_quality.sampled(docs, only))).collect())


def slow_whitening(vectors, k=4):
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    v = np.cov(u.T.astype(float), bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(0, 1, (600, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32)
    v[100:300] = v[7]  # a vector that holds a third of the rows
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(9001, None), (9002, [None] + [1.0] * 11), (9003, [float("nan")] * 12), (9004, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in [*CLASH, "vector", "dims", "component", "place", "grp"]}).repartition(23)
    got = whitening.whitened(df).collect()
    n, deviation, w, explained = slow_whitening(v)
    assert len(got) == 4 * len(v)
    for k in range(4):
        part = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        assert all(r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-9 for i, r in part.items())
        mine = np.array([part[i]["whitened"] for i in range(len(v))])
        assert min(abs(mine - w[:, k]).max(), abs(mine + w[:, k]).max()) < 1e-8


def test_merging_loses_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-2000, 2000, (500, 9))
    cuts = [0, 1, 3, 10, 200, 201, 500]
    parts = [whitening._summary(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    out = parts[0]
    for p in parts[1:]:
        out = whitening.merged(out, p)
    n, sums, mean, sv, vt = out
    assert n == 500 and sums == x.sum(0).tolist() and np.allclose(mean, x.mean(0), rtol=1e-12)
    assert np.allclose((vt.T * sv**2) @ vt / n, np.cov(x.T, bias=True), rtol=1e-9)


def test_whitening_of_few_and_of_other_vectors(spark):
    big = 3.0e38
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 5.0]), (4, [0.5] * 3), (5, []), (6, [big] * 5), (7, [-big] * 5), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 2, 2: 2, None: 2, 4: 1, 6: 2, 7: 2, 8: 1}
    one, two = sorted(by[1], key=lambda r: r["component"])
    assert abs(abs(one["whitened"]) - 1) < 1e-9 and two["whitened"] is None and abs(one["explained"] - 1) < 1e-9 and one["n"] == 2
    assert by[4][0]["whitened"] is None and by[4][0]["explained"] is None and by[4][0]["deviation"] == 0 and by[4][0]["n"] == 1
    assert by[6][0]["deviation"] is None and abs(abs(by[6][0]["whitened"]) - 1) < 1e-6
    assert whitening.whitened(df.where("vec_id > 99")).count() == 0
