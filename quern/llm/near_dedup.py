"""5. Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with equal shingle sets are one class from the start; a class is known by a 128-bit digest of its whole set. Each class
has a signature of TREES x DEPTH min-hashes, cut into TREES keys. The keys of every tree are sorted over the whole corpus (a
range exchange, so a region that holds a third of all rows is dealt over many tasks), equal keys in an order of the
tree's own. Neighbours in an order that share at least MIN_DEPTH leading hashes are candidates; in dense regions a
neighbour shares a longer prefix than in sparse ones, so depth adapts to the region. No row is a candidate of more than
2 x REACH x TREES others. Candidates whose sketches agree are verified on the full shingle sets, the most alike first, and
linked. Later rounds only take candidates whose classes are in different components.

A region that still holds several components is then searched whole (blocks.py): its members outside the largest component
against all its members, on their full sets. So every pair that shares a region of any tree is verified or already in one
component; the chance that a pair at the threshold shares none of 24 regions is (1 - 0.8**5)**24 = 7e-5.

Null, empty and wordless texts have the empty set and link with nothing. A text with fewer words than a shingle is one
shingle. Rows of equal doc_id each have their own text's component; a null doc_id links with nothing and is kept. Rows
repeat as in the input; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import LONG, crowded_links
from quern.llm.common import WORD, components, joined, min_hashes, numbered, released, salted_join, saved

TREES, DEPTH, MIN_DEPTH = 24, 6, 5
SKETCH = 64
#: Sketches of four-bit hashes may be this far below the threshold by chance (five deviations); what they rule out among
#: neighbours is still met in the whole search.
SKETCH_SLACK = 0.25
REACH = 2

_word = re.compile(WORD)
_lower = {i: i + 32 for i in range(65, 91)}
_mult = (np.random.default_rng(20240607).integers(1, 2**63, TREES * DEPTH, np.uint64) << np.uint64(1)) | np.uint64(1)
_mult32 = (_mult >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `size` words, A-Z lower-cased: the words' hashes, mixed in turn."""
    import xxhash

    words = _word.findall((text or "").translate(_lower))
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    h = np.full(n, min(size, len(words)), np.uint64)
    for i in range(min(size, len(words))):
        h = (h ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature_rows(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH min-hashes of each set (none is empty) as uint32."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    k = 0
    while k < len(sets):  # sets are hashed together up to about 16,384 elements, a large one alone
        j, size = k, 0
        while j < len(sets) and (j == k or size + len(sets[j]) <= 16384):
            size += len(sets[j])
            j += 1
        h = (np.concatenate(sets[k:j]) >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(x) for x in sets[k:j]])
        out[k:j] = min_hashes(h, np.cumsum(sizes) - sizes, _mult32)
        k = j
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    return signature_rows([hashes])[0]


def digest(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a hash of the whole set), sig; set_id and sig are null for empty sets."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                hs = [shingle_hashes(t, size) for t in part.column(1).to_pylist()]
                n = [len(h) for h in hs]
                ids = [digest(h.tobytes()) if len(h) else None for h in hs]
                made = iter(signature_rows([h for h in hs if len(h)]))
                sigs = [next(made).tobytes() if len(h) else None for h in hs]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def _matrix(col: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), width)


def forest(classes: DataFrame) -> DataFrame:
    """One row for each tree: tree, key (DEPTH hashes, big-endian), node, sketch; sorted within range partitions."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                m = _matrix(part.column("sig"), "<u4", TREES * DEPTH)
                low = (m[:, :SKETCH] & 15).astype(np.uint8)
                sketch = pa.array([x.tobytes() for x in (low[:, ::2] << 4 | low[:, 1::2])], pa.binary())
                for t in range(TREES):
                    # after the tree's own hashes come those of the next tree: equal keys meet different neighbours in each
                    keys = m[:, [(t * DEPTH + i) % (TREES * DEPTH) for i in range(DEPTH + 2)]].astype(">u4")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), part.column("node"), sketch], names=["tree", "key", "node", "sketch"])

    rows = classes.select("node", "sig").mapInArrow(run, "tree int, key binary, node long, sketch binary").withColumn("turn", F.xxhash64("node", "tree"))
    return rows.repartitionByRange("tree", "key", "turn").sortWithinPartitions("tree", "key", "turn").drop("turn")


def neighbours(ordered: DataFrame, least: float, reach: int = REACH) -> DataFrame:
    """a, b, alike of rows at most `reach` apart in one region, alike being their sketches' estimate of at least `least`; and
    region, a with b null for the members of regions of more than one row, or that may run over two partitions."""
    agree = np.array([[(int(x >> 4 == y >> 4)) + int(x & 15 == y & 15) for y in range(256)] for x in range(256)], np.uint8)

    def members(region, ids):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["region", "a", "b", "alike"])

    def run(batches):
        tail = head = None  # the open region's last rows; the partition's first region, which may have begun in another
        given = True  # whether the last row is given as a member
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column("tree").to_numpy()
            key = _matrix(b.column("key"), ">u4", DEPTH + 2)
            ids = b.column("node").to_numpy()
            sk = _matrix(b.column("sketch"), "u1", SKETCH // 2)
            if tail is not None:
                tree, key, ids, sk = (np.concatenate((x, y)) for x, y in zip(tail, (tree, key, ids, sk)))
            old = 0 if tail is None else len(tail[0])
            n = len(tree)
            new = np.ones(n, bool)
            new[1:] = (tree[1:] != tree[:-1]) | (key[1:, :MIN_DEPTH] != key[:-1, :MIN_DEPTH]).any(1)
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            here = np.arange(old, n)
            pairs = [(x - d, x) for d in range(1, reach + 1) for x in (here[here - d >= first[here]],)]
            a, z = (np.concatenate(v) for v in zip(*pairs))
            if len(a):
                same = agree[sk[a], sk[z]].sum(1) / SKETCH
                good = (same - 1 / 16) / (1 - 1 / 16) >= least
                a, z, same = a[good], z[good], same[good]
                lo, hi = np.minimum(ids[a], ids[z]), np.maximum(ids[a], ids[z])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(lo), pa.int64()), pa.array(lo), pa.array(hi), pa.array(same)], names=["region", "a", "b", "alike"])
            region = (key[:, :MIN_DEPTH].astype(np.uint64) * _mult[:MIN_DEPTH]).sum(1, dtype=np.uint64) ^ (tree.astype(np.uint64) * _mult[MIN_DEPTH])
            head = region[0] if head is None else head
            member = ~new | (region == head)
            member[:-1] |= ~new[1:]
            member[:old] &= not given and np.arange(old) == old - 1
            if member.any():
                yield members(region[member], ids[member])
            given = bool(member[-1])
            keep = np.arange(max(first[-1], n - reach), n)
            tail = tree[keep], key[keep], ids[keep], sk[keep]
            last = region[-1:], ids[-1:]
        if tail is not None and not given:
            yield members(*last)

    return ordered.mapInArrow(run, "region long, a long, b long, alike double")


def shingle_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node and the sorted shingle hashes, as bytes, of the classes (node, set_id, rep)."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                hs = [shingle_hashes(t, size).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in hs], pa.binary()), pa.array(hs, pa.binary())], names=["set_id", "hashes"])

    rows = docs.select("doc_id", "text").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = rows.select("text").mapInArrow(run, "set_id binary, hashes binary")
    return sets.join(classes.select("node", "set_id"), "set_id").select("node", "hashes").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union of their full sets."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                good = np.zeros(part.num_rows, bool)
                for i, (p, q) in enumerate(zip(as_sets(part.column("x")), as_sets(part.column("y")))):
                    if 100 * min(len(p), len(q)) < threshold * max(len(p), len(q)):
                        continue
                    common = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                    good[i] = 100 * common >= threshold * (len(p) + len(q) - common)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    full = pairs.select("a", "b").distinct().join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def as_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    ca = comp.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    cb = comp.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).drop("_ca", "_cb")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    sigs = saved(signatures(docs, size), "signatures")
    some = sigs.where("set_id is not null and doc_id is not null")
    classes = some.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    classes = numbered(classes, "node", "classes")
    near = saved(neighbours(forest(classes), threshold / 100 - SKETCH_SLACK), "neighbours")
    pairs = near.where("b is not null").groupBy("a", "b").agg(F.max("alike").alias("alike"))
    pairs = saved(pairs, "candidates")
    members = near.where("b is null").select(F.col("region").alias("key"), F.col("a").alias("node"))
    wanted = classes.select("node", "set_id", "rep", "n_shingles").join(members.select("node").distinct(), "node", "left_semi")
    sets = saved(shingle_sets(docs, wanted, size), "sets")

    # first each class's most alike candidate, then what still links different components
    best = lambda c: F.max_by(c, F.struct("alike", c))
    top = pairs.groupBy("a").agg(best("b").alias("b")).union(pairs.groupBy("b").agg(best("a").alias("a")).select("a", "b"))
    comp = components(verified(top, sets, threshold))
    comp = joined(comp, verified(apart(pairs.select("a", "b"), comp), sets, threshold))
    # what regions with several components still hide
    items = sets.join(wanted.select("node", F.ceil(F.col("n_shingles") / LONG).cast("int").alias("weight")), "node").withColumnRenamed("hashes", "item")
    comp = joined(comp, crowded_links(members, comp, items, as_sets, threshold))
    released(near, pairs, sets)

    of_class = classes.select("node", "set_id", "rep", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    of_class = salted_join(of_class, least, ["component"], "inner", F.col("node")).select("set_id", "component_id")
    out = salted_join(sigs.select("doc_id", "n_shingles", "set_id"), of_class, ["set_id"], "left", F.coalesce("doc_id", F.lit(0)))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a Jaccard similarity of at least 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, on the two-word shingles of op5's contract."""
    gone = saved(near_duplicates(docs, size=2).where("not kept").select("doc_id"), "duplicates")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
