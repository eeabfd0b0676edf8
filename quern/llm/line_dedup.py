"""6. Fuzzy line deduplication by MinHash.

Lines are lower-cased with white space collapsed; every line with at least `min_chars` characters left counts. Equal lines are
one class, known by a 128-bit hash (its first 64 bits name it in the search; should two classes share them, neither is compared
with others). Each class's set of five-character shingles has a MinHash signature cut into BANDS keys
of ROWS hashes (a pair at Jaccard 0.8 shares a key with probability 1 - (1 - 0.8**5)**12 = 0.991, at 0.85 with 0.9991).
Keys are sorted over the whole corpus by a range exchange, which deals a hot key over several tasks, the lines of a key in an
order of its own; neighbours of one key are candidates. Those whose signatures agree, as two bits of each min-hash tell
(five deviations below the threshold), are verified on exact Jaccard similarity, those that share the most keys first. A key that
still holds several components is then searched whole (blocks.py): its lines outside the largest
component against all its lines, by short signatures first and then, of those that these leave, on exact similarity. So every
pair that shares a key is verified, ruled out by five deviations or already in one component; a distributed
union-find joins them. One line of each component stays: the first by doc_id, text and place.

Null and empty texts have no lines. Rows of equal doc_id and text are one document: the same lines go from each. A null
doc_id comes first. Other columns are passed over, or kept by the pipeline stage, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import LONG, crowded_links, promising
from quern.llm.common import components, joined, may_hold, membership, min_hashes, released, salted_join, saved
from quern.llm.near_dedup import apart

SHINGLE, BANDS, ROWS = 5, 12, 5
MIN_CHARS = 1
REACH = 2
#: Share of equal two-bit min-hashes of a pair at the threshold, by which it may fall short of the expected (five deviations).
SLACK = 0.23
#: Shingles whose signatures are made at once.
AT_ONCE = 16384

_rng = np.random.default_rng(6061)
_mult = (_rng.integers(1, 2**31, BANDS * ROWS, np.uint32) << np.uint32(1)) | np.uint32(1)
_fold = (_rng.integers(1, 2**62, (BANDS, ROWS), np.uint64) << np.uint64(1)) | np.uint64(1)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingled(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lines' shingles one after the other, and where each line's begin. A short line is one shingle."""
    c = np.frombuffer("".join(x.ljust(SHINGLE) for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([max(len(x), SHINGLE) for x in lines], np.int64)
    n = len(c) - SHINGLE + 1
    head = c[:n] << np.uint64(42) | c[1 : n + 1] << np.uint64(21) | c[2 : n + 2]
    h = _mixed(_mixed(head + np.uint64(1)) + (c[3 : n + 3] << np.uint64(21) | c[4 : n + 4]))
    inside = np.ones(n, bool)  # not over the end of a line
    for end in range(1, SHINGLE):
        inside[np.cumsum(sizes)[:-1] - end] = False
    counts = sizes - SHINGLE + 1
    return h[inside], np.cumsum(counts) - counts


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    lines, out, k = column.to_pylist(), [], 0
    while k < len(lines):
        j, size = k, 0
        while j < len(lines) and (j == k or size + len(lines[j]) <= AT_ONCE):
            size += len(lines[j])
            j += 1
        h, at = _shingled(lines[k:j])
        out += [np.unique(x) for x in np.split(h, at[1:])]
        k = j
    return out


def signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of BANDS 64-bit keys and one of BANDS * ROWS / 4 bytes, two bits of each min-hash, for each line (each of at
    least one character)."""
    out, short = np.empty((len(lines), BANDS), np.uint64), np.empty((len(lines), BANDS * ROWS // 4), np.uint8)
    k = 0
    while k < len(lines):  # lines are hashed together up to about AT_ONCE shingles, a long line alone
        j, size = k, 0
        while j < len(lines) and (j == k or size + len(lines[j]) <= AT_ONCE):
            size += len(lines[j])
            j += 1
        h, at = _shingled(lines[k:j])
        sig = min_hashes((h >> np.uint64(32)).astype(np.uint32), at, _mult)
        bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8)
        short[k:j] = bits[:, ::4] << 6 | bits[:, 1::4] << 4 | bits[:, 2::4] << 2 | bits[:, 3::4]
        keys = (sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * _fold).sum(2, dtype=np.uint64)
        keys ^= keys >> np.uint64(31)
        out[k:j] = keys * np.uint64(0x94D049BB133111EB) + np.arange(BANDS, dtype=np.uint64)
        k = j
    return out, short


def band_keys(lines: list[str]) -> np.ndarray:
    return signed(lines)[0]


def text_mark(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark (of the text), pos, h (of the normal line), node (its first half) of every line that counts; its keys and
    short signature where the line is the first of its class in its task."""

    def run(batches):
        import xxhash

        h128 = xxhash.xxh3_128_digest
        seen: set[bytes] = set()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows, pos, hs, fresh, new = [], [], [], [], []
                for r, t in enumerate(part.column(2).to_pylist()):
                    for p, line in enumerate((t or "").split("\n")):
                        if len(line) >= min_chars and len(x := normal(line)) >= min_chars:
                            h = h128(x.encode("utf-8", "surrogatepass"))
                            rows.append(r)
                            pos.append(p)
                            hs.append(h)
                            fresh.append(h not in seen)
                            if fresh[-1]:
                                seen.add(h)
                                new.append(x)
                if not rows:
                    continue
                at = pa.array(rows, pa.int32())
                keys, short = signed(new)
                keys = iter(keys.astype("<i8"))
                short = iter(short)
                packed = [pa.array([next(x).tobytes() if f else None for f in fresh], pa.binary()) for x in (keys, short)]
                node = np.frombuffer(b"".join(hs), "<i8")[::2]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(pos, pa.int32()), pa.array(hs, pa.binary()), pa.array(np.ascontiguousarray(node)), *packed], names=["doc_id", "mark", "pos", "h", "node", "keys", "short"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_mark("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark binary, pos int, h binary, node long, keys binary, short binary")


def candidates(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs (a, b) of lines' classes (node, keys) that are neighbours under a key, with key null; and the lines a of each key
    of more lines than neighbours reach, or that may run over two partitions, with b null (repeats are possible)."""

    def exploded(batches):
        for b in batches:
            m = np.frombuffer(b"".join(b.column("keys").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["key", "node"])

    rows = lines.where("keys is not null").select("keys", "node").mapInArrow(exploded, "key long, node long")
    turn = F.xxhash64("key", "node")
    ordered = rows.repartitionByRange("key", turn).sortWithinPartitions("key", turn)

    def packed(a, b, key):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], names=["a", "b", "key"])

    def run(batches):
        tail = head = None  # the open key's last rows and their places; the partition's first key
        for b in batches:
            key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            fresh = np.ones(len(key), bool)  # a line comes once for each task that saw it
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if tail is not None and len(key):
                fresh[0] = key[0] != tail[0][-1] or node[0] != tail[1][-1]
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            head = key[0] if head is None else head
            old = 0 if tail is None else len(tail[0])
            if old:
                key, node = np.concatenate((tail[0], key)), np.concatenate((tail[1], node))
            n = len(key)
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place = np.arange(n) - first
            if old:
                place[first == 0] += tail[2]
            here = np.arange(old, n)
            pairs = [(x - d, x) for d in range(1, reach + 1) for x in (here[place[here] >= d],)]
            a, z = (np.concatenate(v) for v in zip(*pairs))
            if len(a):
                yield packed(np.minimum(node[a], node[z]), np.maximum(node[a], node[z]), None)
            full = here[place[here] == reach + 1]  # with this line a key has one that not all others reach
            m = np.concatenate([here[(place[here] > reach) | (key[here] == head)], *(full - d for d in range(1, reach + 2))])
            if len(m):
                yield packed(node[m], None, key[m])
            last = np.arange(max(first[-1], n - reach - 1), n)
            tail = key[last], node[last], int(place[last[0]])
        if tail is not None:  # the last key may go on in the next partition
            yield packed(tail[1], None, tail[0])

    return ordered.mapInArrow(run, "a long, b long, key long")


def verified(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose shingle sets have 100 * intersection >= threshold * union."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                good = []
                for p, q in zip(shingle_sets(part.column("x")), shingle_sets(part.column("y"))):
                    both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                    good.append(100 * both >= threshold * (len(p) + len(q) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    full = pairs.select("a", "b").distinct().join(items.select(F.col("node").alias("a"), F.col("item").alias("x")), "a")
    full = full.join(items.select(F.col("node").alias("b"), F.col("item").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _least(threshold: int) -> float:
    """Equal two-bit min-hashes of a pair at the threshold, less the slack."""
    return (threshold / 100 + (1 - threshold / 100) / 4 - SLACK) * BANDS * ROWS


_agree = np.array([sum((x >> k & 3) == 0 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def plausible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """a, b, shared of the distinct pairs whose short signatures do not rule out the threshold."""
    least = _least(threshold)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("x", "y"))
            keep = pa.array(_agree[x ^ y].sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("a", "b", "shared")], names=["a", "b", "shared"])

    full = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).join(classes.select(F.col("node").alias("a"), F.col("short").alias("x")), "a")
    full = full.join(classes.select(F.col("node").alias("b"), F.col("short").alias("y")), "b")
    return full.select("a", "b", "shared", "x", "y").mapInArrow(run, "a long, b long, shared long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, item (the normal line), weight of the classes wanted (node, first: where the line stands)."""
    at = wanted.select("node", F.col("first.mark").alias("mark"), F.col("first.pos").alias("pos"))
    bits = docs.sparkSession.sparkContext.broadcast(membership(at.select(F.xxhash64("mark")).distinct()))

    def maybe(batches):
        for b in batches:
            yield b.filter(pa.array(may_hold(bits.value, b.column("x").to_numpy()))).select(["mark", "text"])

    rows = docs.where("text is not null").select(text_mark("text").alias("mark"), "text").withColumn("x", F.xxhash64("mark")).mapInArrow(maybe, "mark binary, text string")
    of_text = salted_join(rows, at.groupBy("mark").agg(F.collect_list(F.struct("pos", "node")).alias("at")), ["mark"], "inner", F.length("text"), 4)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                nodes, lines = [], []
                for t, places in zip(b.column("text").slice(k, 500).to_pylist(), b.column("at").slice(k, 500).to_pylist()):
                    if places[0]["node"] in seen:  # a copy of a text
                        continue
                    seen.add(places[0]["node"])
                    parts = t.split("\n")
                    nodes += [x["node"] for x in places]
                    lines += [normal(parts[x["pos"]]) for x in places]
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=["node", "item"])

    lines = of_text.select("text", "at").mapInArrow(run, "node long, item string").dropDuplicates(["node"])
    return lines.withColumn("weight", F.ceil(F.length("item") / LONG).cast("int"))


def removed_lines(docs: DataFrame, threshold: int = 80, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark and the line numbers (from 0) to remove, for each document that loses lines."""
    lines = saved(lines_of(docs, min_chars), "lines", "zstd")
    occ = F.struct("doc_id", "mark", "pos")
    classes = lines.groupBy("node").agg(F.min(occ).alias("first"), F.count("*").alias("n"), F.max("short").alias("short"), F.min("h").alias("h"), F.max("h").alias("_h"))
    classes = saved(classes.where("h = _h").drop("h", "_h"), "line-classes", "zstd")
    found = saved(candidates(lines), "line-pairs", "zstd")
    pairs = saved(plausible(found.where("b is not null"), classes, threshold), "plausible-pairs", "zstd")
    members = found.where("b is null").select("key", F.col("a").alias("node")).distinct()

    def items(nodes: DataFrame) -> DataFrame:
        return saved(texts_of(docs, classes.select("node", "first").join(nodes.distinct(), "node", "left_semi")), "line-texts", "zstd")

    best = lambda c: F.max_by(c, F.struct("shared", c))
    top = pairs.groupBy("a").agg(best("b").alias("b")).union(pairs.groupBy("b").agg(best("a").alias("a")).select("a", "b"))
    texts = items(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    comp = components(verified(top, texts, threshold))
    rest = saved(verified(apart(pairs.select("a", "b"), comp), texts, threshold), "links")

    least = _least(threshold)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = np.zeros((len(x), len(y)), np.uint16)
        for k in range(x.shape[1]):
            same += _agree[x[:, k, None] ^ y[None, :, k]]
        return same >= least

    short = classes.select("node", "short", F.lit(1).alias("weight")).join(members.select("node").distinct(), "node", "left_semi")
    left = promising(members, comp, short, alike)
    released(found, pairs, texts)
    crowd = items(left.select("node"))
    links = crowded_links(left, comp, crowd, shingle_sets, threshold)
    released(left, crowd)
    comp = joined(comp, rest.union(links))
    released(rest, links)

    known = classes.select("node", "first", "n").join(comp, "node", "left").where("n > 1 or component is not null")
    known = saved(known.select("node", "first", F.coalesce("component", "node").alias("component")), "line-components")
    keeper = known.groupBy("component").agg(F.min("first").alias("keep"))
    of_class = salted_join(known, keeper, ["component"], "inner", F.col("node")).select("node", "keep")
    gone = salted_join(lines.select("doc_id", "mark", "pos", "node"), of_class, ["node"], "inner", F.xxhash64("mark", "pos"), 4).where(~occ.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def _with_removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """_row: a row of docs as a struct; _removed: the numbers of its lines that go, or null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_mark("text").alias("_mark"))
    g = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"), F.col("removed").alias("_removed"))
    return rows.join(g, (F.col("_mark") == F.col("_m")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left").select("_row", "_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, the numbers of the lines removed from it (from 0) and how many stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = saved(removed_lines(docs), "removed")
    text = F.col("_row.text")
    n_lines = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.length(F.regexp_replace(text, r"[^\n]+", "")) + 1).cast("long")
    out = _with_removed(docs, gone).select("_row.doc_id", n_lines.alias("n_lines"), F.coalesce("_removed", F.array().cast("array<int>")).alias("removed_lines"))
    return out.withColumn("n_kept", F.col("n_lines") - F.size("removed_lines"))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the lines in gone (as removed_lines gives) cut from text, n_chars set anew where it is a column.

    A document all of whose words stood in removed lines goes.
    """
    rows = _with_removed(docs, gone)
    rows = rows.withColumn("_lines", F.when(F.col("_removed").isNotNull(), F.split("_row.text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    cut = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    rows = rows.withColumn("_text", F.when(F.col("_removed").isNull(), F.col("_row.text")).otherwise(cut)).where(F.col("_removed").isNull() | F.col("_text").rlike(r"[^\s]"))
    out = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near-equal lines one stays."""
    return without_lines(docs, saved(removed_lines(docs.select("doc_id", "text")), "removed"))
