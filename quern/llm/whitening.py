"""13. Embedding whitening by hierarchical merging of singular value decompositions.

Every vector's entries are scaled to whole numbers; the fit list is each different vector once (a grouping that combines
copies before the shuffle). A task summarises its part of the fit list by its number of vectors, exact sums, mean, and all
singular values and right vectors of the centred part: nothing of the part's scatter is cut off. Summaries are merged FAN at a
time, level by level: the scaled right vectors of both sides and one row for the difference of their means,
sqrt(n m / (n + m)) (mean - mean'), stand above one another and are decomposed again, which loses no dimension. A level's
summaries are as many as the level before divided by FAN, each of at most d rows of d entries, and are dealt out by number, so
no task and no driver holds more than FAN of them.

The last summary is the model: its squared singular values over n are the eigenvalues of the covariance, its right vectors
the components. A second pass over the fit list measures how far the whitened vectors' covariance is from the identity.

Rows whose vector is null, or holds a null or non-finite entry, are dropped. Vectors of each length are a fit of their own, as
mixed lengths have no common covariance; vectors of no entries have no components and no rows. Components without variance
(below RANK of the largest, as of a single vector or of repeated ones) give whitened null and count in no error; explained is
null where there is no variance at all. Entries beyond a long are held at its ends; a deviation beyond a long is null. A null
or repeated vec_id is a row like others. An empty table gives no rows. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import saved

SCALE = 256
COMPONENTS = 4
#: Summaries that one task merges.
FAN = 16
#: Vectors that are decomposed at a time within a task; their summaries are merged at once.
ROWS = 4096
#: Components whose eigenvalue is less than this share of the largest have no variance but for rounding.
RANK = 1e-24
#: Numbers of all models together (mean, components and sums of each length): they go to every task.
MODEL_NUMBERS = 1 << 22

_SUMMARY = "dims int, n long, sums array<decimal(38,0)>, mean array<double>, sv array<double>, vt binary"
_LONG = 1 << 63


def whole(df: DataFrame, keep: list[str], column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The columns `keep` and x, the vector as whole numbers floor(scale * entry); rows without a vector of finite entries go."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(F.col(column).isNotNull() & ~bad).select(*keep, F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))


def _matrices(column: pa.ListArray):
    """(length, row numbers, matrix of longs) for each length of the lists of a batch."""
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, values[offsets[at][:, None] + np.arange(d)].astype(np.int64).reshape(len(at), d)


def _summary(x: np.ndarray) -> tuple:
    """n, exact sums, mean, singular values and right vectors of a matrix of longs."""
    exact = np.abs(x).max(initial=0) < _LONG // max(len(x), 1) and x.min(initial=0) > -_LONG
    sums = [int(v) for v in x.sum(0)] if exact else [sum(map(int, c)) for c in x.T]
    mean = np.array([s / len(x) for s in sums])
    _, sv, vt = np.linalg.svd(x - mean, full_matrices=False)
    return len(x), sums, mean, sv, vt


def merged(a: tuple, b: tuple) -> tuple:
    """The summary of the rows of two summaries."""
    (n, s, mu, sv, vt), (m, t, nu, tv, wt) = a, b
    rows = np.vstack([sv[:, None] * vt, tv[:, None] * wt, np.sqrt(n * m / (n + m)) * (mu - nu)[None]])
    _, sv, vt = np.linalg.svd(rows, full_matrices=False)
    sums = [p + q for p, q in zip(s, t)]
    d = len(sums)
    return n + m, sums, np.array([v / (n + m) for v in sums]), sv[:d], vt[:d]


def _row(dims: int, x: tuple) -> dict:
    n, sums, mean, sv, vt = x
    return {"dims": dims, "n": n, "sums": list(map(Decimal, sums)), "mean": mean.tolist(), "sv": sv.tolist(), "vt": np.ascontiguousarray(vt).tobytes()}


def _read(dims: int, n: int, sums, mean, sv, vt: bytes) -> tuple:
    return int(n), [int(v) for v in sums], np.asarray(mean, float), np.asarray(sv, float), np.frombuffer(vt).reshape(-1, dims)


def summaries(fit_list: DataFrame) -> DataFrame:
    """A summary of each task's part of the fit list (x), for each length of vectors in it."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            for d, _, x in _matrices(b.column("x")):
                for i in range(0, len(x) if d else 0, ROWS):
                    part = _summary(x[i : i + ROWS])
                    held[d] = merged(held[d], part) if d in held else part
        if held:
            yield pd.DataFrame([_row(d, x) for d, x in held.items()])

    def arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)

    return fit_list.mapInArrow(arrow, _SUMMARY)


_ARROW = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("sv", pa.list_(pa.float64())), ("vt", pa.binary())])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place")
    out = None
    for _, r in frame.iterrows():
        x = _read(r["dims"], r["n"], r["sums"], r["mean"], r["sv"], r["vt"])
        out = merged(out, x) if out else x
    return pd.DataFrame([_row(int(frame["dims"].iloc[0]), out)])


def merged_all(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """One summary for each length, merged `fan` at a time; each level is written to the shared folder."""
    parts = saved(parts, "svd-summaries", "uncompressed")
    while (most := parts.groupBy("dims").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        # numbers within a length, dealt by hash: sizes of groups only vary a little around fan
        groups = max(1, -(-most // fan))
        dealt = parts.withColumn("place", F.xxhash64("n", "mean", "sv")).withColumn("grp", F.pmod("place", F.lit(groups)))
        parts = saved(dealt.groupBy("dims", "grp").applyInPandas(_merge, _SUMMARY), "svd-summaries", "uncompressed")
    return parts


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """The model of each length: n, sums, eigenvalues, trace, components (rows). Its size is checked before it is read."""
    last = merged_all(summaries(fit_list))
    size = last.agg(F.sum(F.col("dims").cast("long") * (components + 2))).first()[0] or 0
    if size > MODEL_NUMBERS:
        raise ValueError(f"models of {size} numbers are too large for every task")

    def cut(frames):
        for x in frames:
            rows = []
            for r in x.itertuples():
                _, _, _, sv, vt = _read(r.dims, r.n, r.sums, r.mean, r.sv, r.vt)
                vt = vt[:components] * np.where(vt[np.arange(len(vt[:components])), np.abs(vt[:components]).argmax(1)] < 0, -1, 1)[:, None]
                rows.append({"dims": r.dims, "n": r.n, "sums": list(r.sums), "e": (sv[:components] ** 2 / r.n).tolist(), "trace": float((sv**2).sum() / r.n), "vt": vt.tobytes()})
            yield pd.DataFrame(rows, columns=["dims", "n", "sums", "e", "trace", "vt"])

    rows = last.mapInPandas(cut, "dims int, n long, sums array<decimal(38,0)>, e array<double>, trace double, vt binary").collect()
    return {r["dims"]: {"n": r["n"], "sums": [int(v) for v in r["sums"]], "e": np.array(r["e"]), "trace": r["trace"], "vt": np.frombuffer(bytes(r["vt"])).reshape(-1, r["dims"])} for r in rows}


def _projected(x: np.ndarray, model: dict) -> tuple[np.ndarray, list]:
    """Whitened values (rows by components, NaN where there is no variance) and exact deviations (null beyond a long)."""
    n, sums, d = model["n"], model["sums"], x.shape[1]
    largest = max(n * (int(np.abs(x.astype(float)).max(initial=0)) + 1) + max(map(abs, sums), default=0), 1)
    if largest * largest * max(d, 1) < _LONG:
        y = n * x - np.array(sums, np.int64)
        deviation = (y * y).sum(1).tolist()
        centred = y / n
    else:
        y = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
        deviation = [v if (v := sum(a * a for a in r)) < _LONG else None for r in y]
        centred = np.array([[a / n for a in r] for r in y], float).reshape(len(x), d)
    e = model["e"]
    sd = np.sqrt(np.where(e > RANK * e.max(initial=0), e, np.nan))
    return centred @ model["vt"].T / sd, deviation


def identity_errors(fit_list: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """Of each length, the largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = max((len(m["e"]) for m in models.values()), default=0)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b.column("x")):
                if d in models:
                    w = np.zeros((len(x), k + 1))
                    got = _projected(x, models[d])[0]
                    w[:, : got.shape[1]] = got
                    w[:, k] = 1
                    sums[d] = sums.get(d, 0) + w.T @ w
        if sums:
            yield pa.RecordBatch.from_pydict({"dims": pa.array(list(sums), pa.int32()), "part": [v.ravel().tolist() for v in sums.values()]})

    size = (k + 1) ** 2
    parts = fit_list.mapInArrow(run, "dims int, part array<double>")
    out = {}
    for r in parts.groupBy("dims").agg(F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(size)]).alias("s")).collect():
        s = np.array(r["s"], float).reshape(k + 1, k + 1)
        n, c = models[r["dims"]]["n"], len(models[r["dims"]]["e"])
        mean = s[k, :c] / n
        off = np.abs(s[:c, :c] / n - np.outer(mean, mean) - np.eye(c))
        out[r["dims"]] = float(np.nanmax(off)) if c and not np.isnan(off).all() else 0.0
    return out


def whitened(df: DataFrame, keep: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each row with a vector and each component: keep, component, n, deviation, whitened, explained, identity_error."""
    rows = df.select(F.col(keep).alias("id"), F.col(column).alias("vector"))
    fit_list = saved(whole(rows, [], "vector", scale).distinct(), "fit-list")
    models = fitted(fit_list, components)
    errors = identity_errors(fit_list, models)

    def run(batches):
        for b in batches:
            for d, at, x in _matrices(b.column("x")):
                if d not in models:
                    continue
                m = models[d]
                w, deviation = _projected(x, m)
                k = w.shape[1]
                explained = m["e"] / m["trace"] if m["trace"] > 0 else np.full(k, np.nan)
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(flat), m["n"], np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))),
                    pa.array(np.full(len(flat), errors[d])),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    out = whole(rows, ["id"], "vector", scale).mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", keep)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its first four whitened components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
