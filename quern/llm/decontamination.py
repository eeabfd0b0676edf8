"""2. Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a benchmark item is a seed, however common it is; an item of fewer words than n is one seed of its own
length. Every place of a document where a seed occurs is aligned: the item's words against the window of the document that
could hold a copy, by Smith-Waterman over words (match +2, mismatch -1, gap -1). A document is linked to an item when the
best local score is at least `min_score` of the score of a whole copy, and the aligned part has at least min(8, item) words; so
edited, partial and paraphrased copies are found as long as one n-gram survives.

What keeps common seeds cheap is a bound, not a choice of seeds: a window in which too few of the item's words occur at all
cannot reach the score, and is not aligned. So no link depends on how often an n-gram occurs in the corpus, and it is not counted.

Words are lower-cased runs between ASCII white space, trimmed of signs at both ends, and compared by 64-bit hashes. Items are
taken in blocks of bounded size, which a broadcast carries; so what a task holds does not grow with the benchmark: each
block is one more pass over the corpus. A block's seeds are one sorted array of hashes.

Rows of the benchmark are items of their own, also where item_id repeats or is null: a document has a link for each row that
it matches. Null and empty texts and items link with nothing; rows of documents repeat as they do in the input, null ids among
them; other columns are passed over. Long texts are searched whole, their windows one at a time.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import saved

NGRAM = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of benchmark text that one pass holds in memory.
BLOCK_BYTES = 16 << 20

_split = re.compile(r"[^\x20\x09-\x0D]+")
_signs = ".,;:!?\"'()[]{}<>|*#%&$«»„“”…"


def words(text: str | None) -> list[str]:
    """Lower-cased words trimmed of signs; words of signs alone are left out."""
    return [w for w in (x.strip(_signs) for x in _split.findall((text or "").lower())) if w]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two sequences of word numbers, and the window positions [begin, end) of that alignment."""
    m = len(window)
    j = np.arange(m + 1)
    h = np.zeros(m + 1, np.int64)
    start = j.copy()  # where in the window the best path to each cell began
    best = (0, 0, 0)
    for w in item:
        step = np.where(window == w, MATCH, MISMATCH)
        diag = np.concatenate(([0], h[:-1] + step))
        up = h + GAP
        take_diag = diag >= up
        here = np.where(take_diag, diag, up)
        begin = np.where(take_diag, np.concatenate(([0], start[:-1])), start)
        fresh = here <= 0
        here[fresh], begin[fresh] = 0, j[fresh]
        # gaps along the window: the best earlier cell less its distance
        lifted = here - GAP * j
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, j, 0))
        h = np.maximum(top + GAP * j, 0)
        start = np.where(h > 0, begin[source], j)
        k = int(h.argmax())
        if h[k] > best[0]:
            best = int(h[k]), int(start[k]), k
    return best


def hashes(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return out


class Seeds:
    """The items of one block and, by length, the sorted hashes of their seeds with item and place."""

    def __init__(self, texts: list[str], n: int):
        self.codes = [hashes(words(t)) for t in texts]
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(self.codes):
            if len(c):
                by_size.setdefault(min(n, len(c)), []).append(i)
        self.tables = []
        for size, mine in by_size.items():
            grams = [gram_hashes(self.codes[i], size) for i in mine]
            h = np.concatenate(grams)
            item = np.repeat(np.array(mine), [len(g) for g in grams])
            at = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            self.tables.append((size, h[order], item[order], at[order]))

    def hits(self, line: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each item with a seed in the text the places, in order, where a copy would begin."""
        items, starts = [], []
        for size, keys, item, at in self.tables:
            g = gram_hashes(line, size)
            lo = np.searchsorted(keys, g, "left")
            where = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == g))
            if not len(where):
                continue
            lo, n = lo[where], np.searchsorted(keys, g[where], "right") - lo[where]
            k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(item[k])
            starts.append(np.repeat(where, n) - at[k])
        if not items:
            return []
        items, starts = np.concatenate(items), np.concatenate(starts)
        order = np.lexsort((starts, items))
        items, starts = items[order], starts[order]
        cut = np.flatnonzero(np.diff(items)) + 1
        return list(zip(items[np.concatenate(([0], cut))].tolist(), np.split(starts, cut)))


_blocks: dict[str, Seeds] = {}


def _aligned(docs: DataFrame, texts: list[str], ids: list[int | None], n: int, min_score: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, texts, ids))

    def seeds() -> Seeds:
        """One index a worker process, of the block in hand."""
        name, block, _ = sent.value
        if name not in _blocks:
            _blocks.clear()
            _blocks[name] = Seeds(block, n)
        return _blocks[name]

    def links(index: Seeds, text: str | None):
        line = hashes(words(text))
        for item, places in index.hits(line):
            code, starts = index.codes[item], places.tolist()
            need = min_score * MATCH * len(code)
            slack = max(4, math.ceil(MATCH * len(code) - need))  # more gaps than this cost more than the score may lack
            best = (0, 0, 0)
            k = 0
            while k < len(starts):  # windows that overlap are one window
                lo = max(0, starts[k] - slack)
                hi = starts[k] + len(code) + slack
                while k + 1 < len(starts) and starts[k + 1] - slack <= hi and hi - lo < 8 * (len(code) + slack):
                    k += 1
                    hi = starts[k] + len(code) + slack
                k += 1
                window = line[lo : max(hi, 0)]
                most = MATCH * int(np.isin(code, window).sum())  # no more of the item's words can match than occur in the window
                if most < need or most <= best[0]:
                    continue
                s, a, z = align(code, window)
                if s > best[0]:
                    best = s, lo + a, lo + z
            if best[0] >= need and best[2] - best[1] >= min(8, len(code)):
                yield item, best[0], best[0] / (MATCH * len(code)), best[1], best[2]

    def run(batches):
        index, names = seeds(), sent.value[2]
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in links(index, t)]
            if rows:
                doc, item, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(0).type), pa.array([names[i] for i in item], pa.int64()), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "score", "share", "begin_word", "end_word"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, score long, share double, begin_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links of documents to benchmark items: doc_id, item_id, score, share of a whole copy's score, begin_word, end_word."""
    items = saved(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    out = None
    for k in range(blocks):
        # about block_bytes of text, or one item: the bound that makes this fit the driver and a broadcast
        rows = list(items.where(F.col("block") == k).toLocalIterator())
        part = _aligned(docs, [r["text"] for r in rows], [r["item_id"] for r in rows], n, min_score)
        out = part if out is None else out.union(part)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy or an edited copy of a benchmark item, with the item and the score."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents linked to a benchmark item go. Rows of a null doc_id stay or go together."""
    gone = saved(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)
