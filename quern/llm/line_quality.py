"""12. Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is a position of a chain of two labels, good and bad. Its features are the bins of its own shape statistics and of
those of the line before and the line after; a transition has a weight for each pair of labels. A document's score is the mean
of its lines' marginal probabilities of good by forward and backward sums, weighted by their lengths.

The field is fitted on lines that carry their document's label, by regularised maximum likelihood (L-BFGS), on a bounded
sample: of the labelled rows outside the held-out fold, in the order of a hash of the id, as many as fit in MAX_DOCS documents
and MAX_LINES lines (a text of more lines than are left is passed over). Statistics of the sampled lines, 14 numbers each, are
all that reaches the driver. Scoring reads every row and whole texts, in pieces of CHUNK characters, within one pass that needs no
shuffle; a task holds one Arrow batch and the counts of its lines.

Labels, languages, sources and ids are no features. Null texts are empty texts: one empty line, which has a score too. A null id
counts as an empty one for the fold. Of several labels of an id the least counts; null labels count for nothing. Without labels
the score is 0.5, with one label only it is that label's smoothed share. Equal texts have equal scores; extra columns are passed
over, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DOCS, MAX_LINES = 6000, 150_000
FOLDS = 5
CUT = 0.3
#: Shares of the sampled lines at which a statistic's bins end: evenly, and finer at both ends.
CUTS = (0.005, 0.02, *(k / 12 for k in range(1, 12)), 0.98, 0.995)
BINS = len(CUTS) + 1
#: Strength of the penalty on squared weights, in units of one line.
PENALTY = 3.0
CHUNK = 1 << 20

#: Classes of characters, of which a line's counts are taken.
LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, MARK, SYMBOL, FAR, OTHER, END = range(11)
CLASSES = 11
#: Characters of the classes that are not letters or digits.
STOPS, SHOUTS, MARKS, SYMBOLS = ".,;:?", "!", "'\"()-", "#*$%&|<>=+_~^@/\\{}[]"
#: Code points from here on are counted as far from Latin script, up to LIMIT of them looked up by their kind.
LIMIT = 0x250
STATS = 14


def _table() -> np.ndarray:
    out = np.full(LIMIT + 1, OTHER, np.int64)
    for c in range(LIMIT):
        x = chr(c)
        out[c] = SPACE if x.isspace() else UPPER if x.isupper() else LOWER if x.isalpha() else DIGIT if x.isdigit() else OTHER
    for kind, chars in ((STOP, STOPS), (SHOUT, SHOUTS), (MARK, MARKS), (SYMBOL, SYMBOLS)):
        out[[ord(c) for c in chars]] = kind
    out[LIMIT], out[10] = FAR, END
    return out


_KIND = _table()


def class_counts(text: str) -> np.ndarray:
    """Of each line of a text, how many characters of each class it has, its end apart."""
    out = np.zeros((text.count("\n") + 1, CLASSES), np.int64)
    row = 0
    for i in range(0, len(text), CHUNK):
        points = np.frombuffer(text[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = points == 10
        line = np.cumsum(ends)
        last = int(line[-1])
        at = (line - ends) * CLASSES + _KIND[np.minimum(points, LIMIT)]
        out[row : row + last + 1] += np.bincount(at, minlength=(last + 1) * CLASSES).reshape(-1, CLASSES)
        row += last
    return out


def line_stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of every line of the texts, one text after the other, and each text's number of lines."""
    counts, words, different, again, known, ends, sizes = [], [], [], [], [], [], []
    group: list[str] = []
    held = 0
    for k, text in enumerate(texts):
        lines = text.split("\n")
        sizes.append(len(lines))
        seen: dict[str, int] = {}
        for x in lines:
            w = x.split()
            words.append(len(w))
            different.append(len(set(w)))
            again.append(sum(map(eq, w, w[1:])))
            n = seen.get(x, 0)
            known.append(n)
            if w:
                seen[x] = n + 1
                ends.append(w[-1][-1] in ".!?")
            else:
                ends.append(False)
        group.append(text)
        held += len(text)
        if held >= CHUNK or k + 1 == len(texts):
            counts.append(class_counts("\n".join(group)))
            group, held = [], 0
    if not counts:
        return np.zeros((0, STATS)), np.zeros(0, np.int64)
    c = np.concatenate(counts).astype(float)
    size = c.sum(1) - c[:, END]
    solid = np.maximum(size - c[:, SPACE], 1)
    letters = c[:, LOWER] + c[:, UPPER] + c[:, FAR]
    words = np.array(words, float)
    out = np.column_stack([
        np.log2(1 + size), np.log2(1 + words), (size - c[:, SPACE]) / np.maximum(words, 1), c[:, UPPER] / np.maximum(letters, 1), c[:, DIGIT] / solid,
        c[:, SYMBOL] / solid, c[:, SHOUT] / solid, c[:, STOP] / solid, (c[:, MARK] + c[:, OTHER]) / solid, c[:, FAR] / solid,
        np.array(different) / np.maximum(words, 1), np.array(again) / np.maximum(words, 1), np.log2(1 + np.array(known, float)), np.array(ends, float),
    ])
    return out.astype(np.float32), np.array(sizes, np.int64)


@dataclass
class Field:
    """edges: of each statistic the bounds of its bins; tables: log-odds of good by place (own, before, after), statistic and
    bin, the last bin standing for no line; links: weights of the label pairs; base: log-odds of any line."""

    edges: list[np.ndarray]
    tables: np.ndarray
    links: np.ndarray
    base: float

    def odds(self, stats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of good of each line by its features alone."""
        bins = binned(stats, self.edges)
        return self.base + sum(self.tables[p, k][b] for p, at in enumerate(places(bins, sizes)) for k, b in enumerate(at.T))


def binned(stats: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, stats[:, k], side="right") for k, e in enumerate(edges)])


def places(bins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Bins of the line itself, of the line before and of the line after it in its text."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[starts], after[ends - 1] = BINS, BINS
    return [bins, before, after]


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chains(odds: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good of each line, expected pairs of neighbouring labels (2 by 2, over all chains) and the logarithm of each
    chain's normaliser. All chains go forward and back together, those that have ended left out."""
    order = np.argsort(-sizes, kind="stable")
    n, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # chains of more lines than the place
    # forward messages: logarithms of the shares of bad and good at each line; emission of bad is 0, c is what was divided by
    f0, f1, c = np.empty(len(odds)), np.empty(len(odds)), np.empty(len(odds))
    z = np.zeros(len(n))
    a0 = a1 = np.zeros(0)
    for t in range(longest):
        k = alive[t]
        at = starts[:k] + t
        if t == 0:
            a0, a1 = np.zeros(k), odds[at]
        else:
            p0, p1 = a0[:k], a1[:k]
            a0, a1 = _log_add(p0 + links[0, 0], p1 + links[1, 0]), _log_add(p0 + links[0, 1], p1 + links[1, 1]) + odds[at]
        c[at] = _log_add(a0, a1)
        a0, a1 = a0 - c[at], a1 - c[at]
        z[:k] += c[at]
        f0[at], f1[at] = a0, a1
    good, pairs = np.empty(len(odds)), np.zeros((2, 2))
    b0, b1 = np.zeros(0), np.zeros(0)
    for t in range(longest - 1, -1, -1):
        k, was = alive[t], len(b0)
        at = starts[:k] + t
        n0, n1 = np.zeros(k), np.zeros(k)
        if was:
            nxt = starts[:was] + t + 1
            tail0, tail1 = b0 - c[nxt], b1 + odds[nxt] - c[nxt]
            for i, f in ((0, f0), (1, f1)):
                for j, tail in ((0, tail0), (1, tail1)):
                    pairs[i, j] += np.exp(f[starts[:was] + t] + links[i, j] + tail).sum()
            n0[:was] = _log_add(links[0, 0] + tail0, links[0, 1] + tail1)
            n1[:was] = _log_add(links[1, 0] + tail0, links[1, 1] + tail1)
        b0, b1 = n0, n1
        good[at] = np.exp(np.minimum(f1[at] + b1, 0))
    out = np.empty(len(n))
    out[order] = z
    return good, pairs, out


def fit(stats: np.ndarray, sizes: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, rounds: int = 150) -> Field:
    """The field of lines whose labels are those of their texts."""
    edges = []
    for k in range(STATS):
        cuts = np.unique(np.quantile(stats[:, k], CUTS)) if len(stats) else np.zeros(0)
        edges.append(cuts.astype(np.float32))
    tables, links = np.zeros((3, STATS, BINS + 1)), np.zeros((2, 2))
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Field(edges, tables, links, math.log(share / (1 - share)))
    y = np.repeat(labels, sizes).astype(float)
    ids = np.stack([at + (p * STATS + np.arange(STATS)) * (BINS + 1) for p, at in enumerate(places(binned(stats, edges), sizes))], axis=1).reshape(len(y), -1)
    n_tab = tables.size
    inside = np.ones(len(y), bool)
    inside[np.cumsum(sizes) - sizes] = False  # every line but a text's first has a link to the line before
    both = y[inside]  # neighbours share their text's label
    seen = np.array([[(1 - both).sum(), 0.0], [0.0, both.sum()]])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        lk = w[n_tab : n_tab + 4].reshape(2, 2)
        odds = w[-1] + w[:n_tab][ids].sum(1)
        good, pairs, z = chains(odds, sizes, lk)
        value = z.sum() - (odds * y).sum() - (seen * lk).sum() + penalty / 2 * (w[:-1] ** 2).sum()
        d = good - y
        g = np.concatenate([np.bincount(ids.ravel(), np.repeat(d, ids.shape[1]), n_tab), (pairs - seen).ravel(), [d.sum()]])
        g[:-1] += penalty * w[:-1]
        return value, g

    w = minimised(loss, np.zeros(n_tab + 5), rounds)
    return Field(edges, w[:n_tab].reshape(tables.shape), w[n_tab : n_tab + 4].reshape(2, 2), float(w[-1]))


def minimised(loss, w: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.linalg.norm(g), 1e-12)
        for (s, y, r), a in zip(steps, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        slope, t = -(g @ q), 1.0
        while True:
            new = w - t * q
            now, h = loss(new)
            if now <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - w, h - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        settled = abs(value - now) < 1e-7 * max(abs(value), 1)
        w, value, g = new, now, h
        if settled:
            break
    return w


def text_scores(texts: list[str], field: Field) -> np.ndarray:
    """Of each text the mean of its lines' marginals of good, weighted by their lengths (at least one)."""
    if not texts:
        return np.zeros(0)
    stats, sizes = line_stats(texts)
    good, _, _ = chains(field.odds(stats, sizes), sizes, field.links)
    weight = np.maximum(np.exp2(stats[:, 0].astype(float)) - 1, 1)
    starts = np.cumsum(sizes) - sizes
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def fold(doc_id: str | Column) -> Column:
    """The fold of an id: crc32 of its text modulo FOLDS; fold 0 is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sampled(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of lines, lines of each text and labels of the sample that a field is fitted on."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where((fold("id") != 0) & F.col("y").isNotNull() & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n"))
    order = F.xxhash64("id")
    first = known.join(rows, "id").groupBy("id", "y").agg(F.max("n").alias("n")).orderBy(order, "id").limit(max_docs).collect()
    left, take = max_lines, []
    for r in first:
        if r["n"] <= left:
            left -= r["n"]
            take.append((r["id"], r["y"]))
    if not take:
        return np.zeros((0, STATS), np.float32), np.zeros(0, np.int64), np.zeros(0)
    chosen = spark.createDataFrame(take, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int")  # at most max_docs rows
    texts = docs.select(F.col("doc_id").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            stats, sizes = line_stats(b.column("text").to_pylist())
            cuts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([stats[a : a + n].tobytes() for a, n in zip(cuts, sizes)], pa.binary())], names=["id", "y", "stats"])

    got = sorted(texts.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int, stats binary").collect(), key=lambda r: r["id"])
    parts = [np.frombuffer(bytes(r["stats"]), np.float32).reshape(-1, STATS) for r in got]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64), np.array([float(r["y"] > 0) for r in got])


def scored(docs: DataFrame, field: Field, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(text_scores([x or "" for x in b.column("text").to_pylist()], field))], names=["id", "score"])

    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    out = rows.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a field fitted on the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(*sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
