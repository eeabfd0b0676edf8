"""Whole search of crowded keys: the links between components that share a key.

Banding and sorted orders propose each row's neighbours only. A key that still holds several components afterwards is searched
whole: its members outside the largest component against all its members. Members are packed in blocks of bounded weight,
each pair of blocks is one row of a join that is dealt over all tasks, and full sets are intersected inside it. Of the links
of two blocks only those that join components are given, a forest, so the result grows with the members and not with their
pairs, while every pair that shares a key is either verified or already in one component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import released, salted_join, saved

#: Weight of a block. A member weighs one for every LONG elements of its set, begun ones counted.
BLOCK, LONG = 256, 256
#: Elements that two blocks have in common are counted in slices of so many.
SLICE = 4096

Sets = Callable[[pa.Array], list[np.ndarray]]


def intersections(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes of two lists of sorted distinct uint64 sets."""
    px, qx = np.concatenate(p), np.concatenate(q)
    pi, qi = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (p, q))
    shared = np.intersect1d(px, qx)
    both = np.zeros((len(p), len(q)), np.float32)

    def placed(values, rows):
        at = np.searchsorted(shared, values)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == values[hit]
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    if len(shared):
        (pa_, pr), (qa_, qr) = placed(px, pi), placed(qx, qi)
        for k in range(0, len(shared), SLICE):
            x, y = (np.zeros((len(s), min(SLICE, len(shared) - k)), np.float32) for s in (p, q))
            for m, at, rows in ((x, pa_, pr), (y, qa_, qr)):
                a, z = np.searchsorted(at, (k, k + SLICE))
                m[rows[a:z], at[a:z] - k] = 1
            both += x @ y.T
    return both.astype(np.int64)


def forest_links(xs, ys, threshold: int) -> list[tuple[int, int]]:
    """Pairs of members of two blocks (nodes, components, sets) at the threshold, as many as join their components."""
    (xi, xc, p), (yi, yc, q) = xs, ys
    both = intersections(p, q)
    n, m = (np.array([len(v) for v in s], np.int64) for s in (p, q))
    union = n[:, None] + m[None, :] - both
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (d := root.get(c, c)) != c:
            root[c] = root.get(d, d)
            c = d
        return c

    out = []
    for i, j in zip(*np.nonzero((100 * both >= threshold * union) & (xc[:, None] != yc[None, :]))):
        c, d = find(int(xc[i])), find(int(yc[j]))
        if c != d:
            root[max(c, d)] = min(c, d)
            out.append((int(xi[i]), int(yi[j])))
    return out


def _block_pairs(members: DataFrame, comp: DataFrame, items: DataFrame, what: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """key, left, right: every pair of a block of a key's members and one of its members outside the largest component, as
    arrays of node, component and the columns `what` of items (node, weight, ...); and the saved table that they are read from."""
    rows = members.distinct().join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = saved(rows.join(items.select("node", "weight"), "node"), "key-members", "zstd")
    counts = rows.groupBy("key", "component").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("w", "component")).alias("m"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.count("*").alias("k")).where("k > 1")
    mixed = mixed.groupBy("n", "x").agg(F.min(F.struct("key", "m", "w")).alias("s"))
    cuts = lambda w: F.greatest(F.ceil(w / block), F.lit(1)).cast("int")
    mixed = mixed.select("s.key", F.col("s.m.component").alias("main"), cuts(F.col("s.w")).alias("cuts"), cuts(F.col("s.w") - F.col("s.m.w")).alias("rcuts"))
    full = salted_join(rows, mixed, ["key"], "inner", F.col("node")).join(items.select("node", *what), "node")
    pack = F.collect_list(F.struct("node", "component", *what))
    left = full.groupBy("key", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("_i"), "rcuts").agg(pack.alias("left"))
    left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("rcuts") - 1)))
    right = full.where("component <> main").groupBy("key", F.pmod(F.xxhash64("node"), F.col("rcuts")).cast("int").alias("_j")).agg(pack.alias("right"))
    return left.join(right, ["key", "_j"]).select("key", "left", "right"), rows


def promising(members: DataFrame, comp: DataFrame, items: DataFrame, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 4 * BLOCK) -> DataFrame:
    """The members (key, node) of keys of several components that have a partner of another component under their key whose
    short signature does not rule them out. items: node, weight, short (bytes of one length); alike gives, of two matrices of
    such bytes, the matrix of what is not ruled out. The result grows with the members; texts are only needed of these."""

    def run(batches):
        for b in batches:
            keys, nodes = [], []
            for key, xs, ys in zip(b.column("key").to_pylist(), b.column("left"), b.column("right")):
                x, y = ((v.field("node").to_numpy(), v.field("component").to_numpy(), v.field("short")) for v in (xs.values, ys.values))
                p, q = (np.frombuffer(b"".join(v[2].to_pylist()), np.uint8).reshape(len(v[0]), -1) for v in (x, y))
                hit = alike(p, q) & (x[1][:, None] != y[1][None, :])
                got = np.concatenate((x[0][hit.any(1)], y[0][hit.any(0)]))
                keys.append(np.full(len(got), key, np.int64))
                nodes.append(got)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    pairs, rows = _block_pairs(members, comp, items, ["short"], block)
    out = saved(pairs.mapInArrow(run, "key long, node long").distinct(), "promising")
    released(rows)
    return out


def crowded_links(members: DataFrame, comp: DataFrame, items: DataFrame, sets: Sets, threshold: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) with 100 * intersection >= threshold * union between the components that share a key.

    members: key, node (repeats are allowed); comp: node, component; items: node, weight, item, of which `sets` makes the
    sorted sets of a batch. Keys of the same members are searched once.
    """

    def run(batches):
        for b in batches:
            links = []
            for xs, ys in zip(b.column("left"), b.column("right")):
                sides = [(v.field("node").to_numpy(), v.field("component").to_numpy(), sets(v.field("item"))) for v in (xs.values, ys.values)]
                links += forest_links(*sides, threshold)
            if links:
                a, z = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    pairs, rows = _block_pairs(members, comp, items, ["item"], block)
    out = saved(pairs.mapInArrow(run, "a long, b long"), "crowded-links")
    released(rows)
    return out
