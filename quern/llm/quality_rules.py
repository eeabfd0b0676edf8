"""8. Quality rules: robust multivariate outliers by minimum covariance determinant.

Base statistics of every whole text are counted in Arrow batches. Each (language, source), each language and the whole table then
get a minimum-covariance-determinant estimate of location and scatter of four transformed statistics, from all of their
base-passing rows: starting from medians, concentration steps keep the h = 0.75 n rows of smallest Mahalanobis distance and
re-estimate, until no location moves or `steps` are done. Quantiles are read from histograms of bins of 0.02 (of the
logarithm of distances), so the half set holds h and up to one bin more. Every step is two aggregations that combine before
the shuffle, so a group that holds a third of the rows costs no task more than another does.

An estimate is drawn towards that of its language, and a language's towards the table's, by the weight n / (n + prior), n being
its rows: a source of few rows is judged nearly as its language is, one of many by itself, and there is no size at which
the rule changes. A row whose distance is beyond the chi-square quantile `tail` is rejected.

A null language or source is a value of its own. Null and empty texts have no words, so they fail the base rule. Rows of equal
content get equal verdicts; an empty table gives an empty table; other columns are passed over, or kept by the pipeline
stage, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WORD, salted_join, saved

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = 4
#: Least standard deviation of each transformed statistic. Most clean texts have no symbol, no repeated line and no
#: repeated window at all, so the plain scatter of a clean half is singular.
FLOOR_SD = (0.06, 0.45, 0.45, 0.6)
BIN = 0.02

_word = re.compile(WORD)


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _word.findall(text)
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if _word.search(x)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 5:
        wins = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(wins)) < len(wins):
            seen = Counter(wins)
            end = 0
            for i, w in enumerate(wins):
                if seen[w] > 1:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    return n, sum(map(len, words)), symbols, dup, repeat


def with_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of df and the five statistics of its column text; base_failed as the contract has it."""
    src = df.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)]), *(f"{c} long" for c in STATS)])

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            cols = list(zip(*(text_stats(t.as_py()) for t in texts))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *STATS])

    return src.mapInArrow(run, out).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _chi2_quantile(p: float, df: int) -> float:
    """Quantile of chi-square for even df, by bisection of its closed form."""
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return hi


def _chi2_cdf(x: float, df: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]


def _quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The least bin end with a share of at least q of each key's values; bins of equal width, counted before the shuffle."""
    bins = df.groupBy(*keys, F.floor(F.col(value) / BIN).cast("long").alias("_bin")).agg(F.count("*").alias("_n"))
    hist = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_n"))).alias("_h"), F.sum("_n").alias("_all"))
    hit = F.aggregate("_h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("b")), lambda a, x: F.struct((a["c"] + x["_n"]).alias("c"), F.when(a["b"].isNull() & (a["c"] + x["_n"] >= F.ceil(F.lit(q) * F.col("_all"))), x["_bin"]).otherwise(a["b"]).alias("b")))
    return hist.select(*keys, ((hit["b"] + 1) * BIN).alias(value))


def _distance() -> Column:
    d = [F.col(f"z{i}") - F.col("mu")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("prec")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


def _estimated(sums: DataFrame, factor: float) -> DataFrame:
    """Location, scatter and precision of each group from its half set's sums; scatter is scaled by factor and floored by
    FLOOR_SD."""
    floor = np.diag(np.square(FLOOR_SD))

    def run(frames):
        for x in frames:
            mus, covs, precs = [], [], []
            for n, s, ss in zip(x["n"], x["s"], x["ss"]):
                mu = np.asarray(s) / n
                cov = np.asarray(ss).reshape(DIMS, DIMS) / n - np.outer(mu, mu)
                cov = factor * (cov + cov.T) / 2 + floor
                mus.append(mu.tolist())
                covs.append(cov.ravel().tolist())
                precs.append(np.linalg.inv(cov).ravel().tolist())
            yield x[["grp"]].assign(mu=mus, cov=covs, prec=precs)

    return sums.mapInPandas(run, "grp string, mu array<double>, cov array<double>, prec array<double>")


def _drawn(names: DataFrame, est: DataFrame, prior: float) -> DataFrame:
    """grp, mu, prec of each (language, source) after it is drawn towards its language and that towards the whole table."""

    def run(frames):
        for x in frames:
            mus, precs = [], []
            for n, nl, *parts in zip(*(x[c] for c in ("n", "n_lang", "mu", "mu_lang", "mu_all", "cov", "cov_lang", "cov_all"))):
                w, wl = n / (n + prior), nl / (nl + prior)
                mu, cov = (w * np.asarray(own) + (1 - w) * (wl * np.asarray(lang) + (1 - wl) * np.asarray(every)) for own, lang, every in (parts[:3], parts[3:]))
                mus.append(mu.tolist())
                precs.append(np.linalg.inv(cov.reshape(DIMS, DIMS)).ravel().tolist())
            yield x[["grp"]].assign(mu=mus, prec=precs)

    part = lambda suffix: est.select(F.col("grp").alias(f"grp{suffix}"), F.col("mu").alias(f"mu{suffix}"), F.col("cov").alias(f"cov{suffix}"))
    full = names.join(part(""), "grp").join(part("_lang"), "grp_lang").join(part("_all"), "grp_all")
    return full.mapInPandas(run, "grp string, mu array<double>, prec array<double>")


def fit(stats: DataFrame, h: float = 0.75, steps: int = 10, prior: float = 50.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns stats with the columns grp and z0..z3; the estimate (mu, prec) that rows of each grp are judged by; and the
    estimates of all groups, languages and the table as fitted (grp, mu, cov, prec)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    z = stats.withColumn("grp_lang", F.concat(F.lit("lang "), part("lang"))).withColumn("grp", F.concat(F.lit("source "), part("lang"), F.lit("\x1f"), part("source")))
    zs = [f"z{i}" for i in range(DIMS)]
    z = saved(z.withColumns({f"z{i}": c for i, c in enumerate(_transformed())}).withColumn("grp_all", F.lit("all")), "stats")
    ok = z.where(~F.col("base_failed"))
    names = ok.groupBy("grp", "grp_lang", "grp_all").agg(F.count("*").alias("n"))
    names = saved(names.join(names.groupBy("grp_lang").agg(F.sum("n").alias("n_lang")), "grp_lang"), "groups")
    salt = F.xxhash64(*zs)
    ok = ok.select(F.explode(F.array("grp", "grp_lang", "grp_all")).alias("grp"), *zs)

    long = ok.select("grp", F.posexplode(F.array(*zs)).alias("dim", "z"))
    mid = _quantile(long, ["grp", "dim"], "z", 0.5).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda x: x["z"]).alias("mu"))
    start = [0.0] * (DIMS * DIMS)
    for i, sd in enumerate(FLOOR_SD):
        start[i * DIMS + i] = 1 / (2 * sd) ** 2
    est = saved(mid.withColumn("prec", F.array(*[F.lit(x) for x in start])), "estimates")

    cut = _chi2_quantile(h, DIMS)
    factor = h / _chi2_cdf(cut, DIMS + 2)
    for _ in range(steps):
        d = salted_join(ok, est.select("grp", "mu", "prec"), ["grp"], "inner", salt).withColumn("d", F.log1p(_distance()))
        limit = _quantile(d, ["grp"], "d", h).withColumnRenamed("d", "limit")
        half = salted_join(d.select("grp", "d", *zs), limit, ["grp"], "inner", salt).where("d <= limit")
        sums = half.groupBy("grp").agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(x) for x in zs]).alias("s"),
            F.array(*[F.sum(F.col(x) * F.col(y)) for x in zs for y in zs]).alias("ss"),
        )
        now = saved(_estimated(sums, factor), "estimates")
        moved = now.join(est.select("grp", F.col("mu").alias("was")), "grp").agg(F.max(F.array_max(F.zip_with("mu", "was", lambda x, y: F.abs(x - y))))).first()[0]
        est = now
        if moved is None or moved < 1e-9:
            break
    return z, saved(_drawn(names, est, prior), "drawn"), est


def verdicts(df: DataFrame, keep: list[str], tail: float = 0.9999999, **fitting) -> DataFrame:
    """keep columns of df (lang and source among them), the statistics, base_failed, distance and kept."""
    z, est, _ = fit(with_stats(df, keep), **fitting)
    out = salted_join(z, est, ["grp"], "left", F.xxhash64(*STATS)).withColumn("distance", _distance())
    ok = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= _chi2_quantile(tail, DIMS))
    return out.withColumn("kept", ok).select(*keep, *STATS, "base_failed", "distance", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every document: base statistics, base_failed and kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs, ["doc_id", "lang", "source"]).select("doc_id", *STATS, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Rows are matched by id, language, source and a 128-bit digest of
    their text, so repeated ids are safe."""
    names = ["doc_id", "lang", "source"]
    mark = F.md5(F.coalesce("text", F.lit("")))
    gone = verdicts(docs.select(*names, "text", mark.alias("mark")), [*names, "mark"]).where(~F.col("kept")).select(F.struct(*names).alias("_id"), F.col("mark").alias("_m")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), mark.alias("_mark"))
    left = rows.join(gone, (F.col("_mark") == F.col("_m")) & F.struct(*[f"_row.{c}" for c in names]).eqNullSafe(F.col("_id")), "left_anti")
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
