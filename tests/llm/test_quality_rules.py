"""Quality rules: the contract's statistics by brute force, and verdicts on planted outliers."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    covered = set()
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e a b c d e f", "x\nx\n\n \nx", "a a a a a a a", "#$ é<>|\x85a\x1cb", "\x0bword\x0c", "a b c d e " * 40])
def test_text_stats(text):
    assert Q.text_stats(text) == brute(text)


def test_verdicts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(40, 120))), "en", f"s{i % 2}" if i % 10 else None, i) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(60)), "en", "s0", i) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "too short", "en", "s1", 0), (5, rows[5][1], "en", "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")  # n_words clashes
    got = Q.verdicts(df, ["doc_id", "lang", "source"])
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert got.count() == len(rows)
    assert all(kept[i] for i in range(400))
    assert not any(kept[1000 + i] for i in range(20)) and not kept[2000] and not kept[2001] and not kept[2002]
    odd = df.withColumn("_row", F.lit(1)).withColumn("grp", F.lit("x")).withColumn("mark", F.lit(2))
    out = Q.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == 401
    assert Q.stage(spark, df.limit(0), "").count() == 0


def test_small_groups_are_judged_by_the_estimates_of_many_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(40, 120)))
    junk = lambda: " ".join(word() + "###" for _ in range(60))
    rows = [(i, good(), "en", "large") for i in range(400)]
    rows += [(1000 + i, junk(), "en", "junk") for i in range(3)] + [(1010, junk(), "en", "one")] + [(1020 + i, junk(), "xx", "alone") for i in range(3)] + [(1030, junk(), None, None)]
    rows += [(500 + i, good(), "en", "small") for i in range(3)] + [(510, good(), "yy", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Q.verdicts(df, ["doc_id", "lang", "source"])
    assert {r.doc_id: r.kept for r in got.collect()} == {i: i < 1000 for i, *_ in rows}


def reference(rows, h=0.75, steps=10, prior=50.0, tail=0.9999999):
    """Verdicts by group, language and table, one at a time in numpy; rows: name, lang, source, statistics."""
    chi = lambda x, k: 1 - np.exp(-x / 2) * sum((x / 2) ** i / np.prod(range(1, i + 1)) for i in range(k // 2))

    def quantile(p, k):
        a, z = 0.0, 200.0
        while z - a > 1e-12:
            a, z = ((a + z) / 2, z) if chi((a + z) / 2, k) < p else (a, (a + z) / 2)
            if a + (z - a) / 2 in (a, z):
                break
        return z

    def binned(v, q):
        """The end of the bin of 0.02 that holds the q-quantile."""
        b = np.sort(np.floor(v / 0.02))
        return (b[int(np.ceil(q * len(b) - 1e-12)) - 1] + 1) * 0.02

    ok, failed = [], {}
    for name, lang, source, (n, chars, sym, dup, rep) in rows:
        if n < 10 or 100 * rep > 20 * n:
            failed[name] = False
        else:
            ok.append((name, lang, source, [np.log(chars / n), *(np.log1p(100 * x / n) for x in (sym, dup, rep))]))
    z = np.array([x[3] for x in ok])
    floor = np.diag(np.square(Q.FLOOR_SD))
    factor = h / chi(quantile(h, 4), 6)

    def mcd(x):
        mu, prec = np.array([binned(x[:, i], 0.5) for i in range(4)]), np.linalg.inv(4 * floor)
        for _ in range(steps):
            d = np.log1p(np.einsum("ij,jk,ik->i", x - mu, prec, x - mu))
            y = x[d <= binned(d, h)]
            was, mu = mu, y.mean(0)
            cov = factor * ((y.T @ y) / len(y) - np.outer(mu, mu)) + floor
            prec = np.linalg.inv(cov)
            if np.abs(was - mu).max() < 1e-9:
                break
        return mu, cov

    out, raw = dict(failed), {}
    every = mcd(z)
    for i, (name, lang, source, v) in enumerate(ok):
        mine = [k for k, x in enumerate(ok) if x[1] == lang and x[2] == source]
        tongue = [k for k, x in enumerate(ok) if x[1] == lang]
        if (lang, source) not in raw:
            own, middle = mcd(z[mine]), mcd(z[tongue])
            w, wl = len(mine) / (len(mine) + prior), len(tongue) / (len(tongue) + prior)
            raw[lang, source] = tuple(w * o + (1 - w) * (wl * m + (1 - wl) * e) for o, m, e in zip(own, middle, every))
        mu, cov = raw[lang, source]
        d = (z[i] - mu) @ np.linalg.inv(cov) @ (z[i] - mu)
        out[name] = (d, d <= quantile(tail, 4))
    return out


def test_verdicts_against_numpy(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))

    def text():
        n = rng.randint(5, 120)
        ws = [word() + ("#" * rng.randint(1, 3) if rng.random() < rng.choice((0, 0, 0.02, 0.4)) else "") for _ in range(n)]
        if rng.random() < 0.2:
            ws[3:8] = ws[-5:]
        t = " ".join(ws)
        return t if rng.random() < 0.7 else "\n".join([t, "a line again", "a line again"])

    sizes = {("en", "a"): 150, ("en", "b"): 40, ("en", "c"): 6, ("de", "a"): 30, ("de", None): 1, (None, "z"): 3}
    rows = [(lang, source, text()) for (lang, source), n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(i, t, lang, source) for i, (lang, source, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in Q.verdicts(df, ["doc_id", "lang", "source"]).collect()}
    want = reference([(i, lang, source, brute(t)) for i, (lang, source, t) in enumerate(rows)])
    assert {i: r.kept for i, r in got.items()} == {i: bool(x[1]) if x else False for i, x in want.items()}
    assert all(abs(got[i].distance - x[0]) <= 1e-9 * max(1, x[0]) for i, x in want.items() if x)
    assert 0 < sum(r.kept for r in got.values()) < sum(not r.base_failed for r in got.values())
