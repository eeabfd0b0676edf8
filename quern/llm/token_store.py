"""9. Token ids in a content-addressed store.

Each text's ids (an end id last) are cut into chunks where a rolling hash over the last eight ids has its low bits zero, so
equal passages give equal chunks wherever they stand. A store is a folder of three Parquet tables:

    chunks/   digest (SHA-256 of data), n, data: ids as little-endian unsigned integers of `width` bytes; each chunk once
    recipes/  seq, doc_id, start, n_tokens, chunks (digest, n), root: the document's Merkle root; files ascend by doc_id
    manifest/ one row: width, documents, ids and the root of the Merkle tree over all recipes in seq order

The tree's leaves are hashes of each recipe's seq, doc_id, start, n_tokens and root. Its nodes hold up to FAN children, those of
one stretch of seq, so every level is one grouping with groups of bounded size and no task sees more than FAN hashes at once.
Reading checks every chunk against its digest, every recipe against its root and the recipes against the manifest's root, and
raises on a mismatch, a changed order, a lost or shortened file or a missing chunk. Sizes and checksums of documents come from the chunks' own checksums, which
combine, so no document's bytes are gathered; read_ids gathers them.

Null and empty texts are the end id alone. Null ids come first; rows of equal doc_id are ordered by their root. Hot chunks of
large groups of copies are combined before the shuffle. Chunk length is bounded by its text, and not otherwise.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, saved

#: Texts of these characters only are cut by the pattern below exactly as the library cuts them.
_plain = re.compile("[\t\n\r\x20-\x7e¡-©«¬®-±´-¸»¿-ſ]*")
#: The byte-level tokenizer's published split pattern, for the characters above.
_unit = re.compile(r" ?[A-Za-zµÀ-ÖØ-öø-ſ]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\sA-Za-zµÀ-ÖØ-öø-ſ0-9]+|\s+(?!\S)|\s+")
CACHE_CHARS = 10_000_000
WINDOW = 8
MEAN_CHUNK = 512
#: A node of the manifest's tree covers 2**FAN_BITS places of the level below.
FAN_BITS = 12
FAN = 1 << FAN_BITS


class Encoder:
    """The library's ids; runs of letters, digits and signs seen before come from a bounded table."""

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.end = end_id
        self.width = 2 if self.tk.get_vocab_size() <= 65536 else 4
        pre = str(self.tk.pre_tokenizer)
        self.by_unit = self.tk.normalizer is None and pre == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.specials = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}
        self.room = CACHE_CHARS
        line = self.tk.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def _units(self, t: str | None) -> list[str] | None:
        if not t or not self.by_unit or not _plain.fullmatch(t) or any(s in t for s in self.specials):
            return None
        return _unit.findall(t)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_units(self, new: list[str], kind: str) -> dict[str, bytes]:
        """Ids of units. Those without white space but a first space are encoded as lines of one text, since a line feed
        is a token of its own before and after them."""
        joined = [u for u in new if self.line is not None and not u[1:].isspace() and u.strip() and "\n" not in u and "\r" not in u and "\t" not in u]
        out = {}
        if joined:
            ids = np.array(self._batch(["\n".join(joined)])[0], kind)
            at = 0
            for u, end in zip(joined, [*np.flatnonzero(ids == self.line).tolist(), len(ids)], strict=True):
                out[u] = ids[at:end].tobytes()
                at = end + 1
        rest = [u for u in new if u not in out]
        return out | {u: np.array(ids, kind).tobytes() for u, ids in zip(rest, self._batch(rest))}

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id last, as uint32."""
        kind = "<u2" if self.width == 2 else "<u4"
        known, units, found = [], [], []
        for t in texts:
            x = self._units(t)
            got = x and list(map(self.table.get, x))
            try:  # most texts hold no new unit: their parts are joined at once, and not kept
                known.append(b"".join(got) if got else None)
                x = got = None if known[-1] is not None else got
            except TypeError:
                known.append(None)
            units.append(x)
            found.append(got)
        holes = [_nones(got) if got else () for got in found]
        new = list({x[i] for x, at in zip(units, holes) for i in at})
        fresh = self._new_units(new, kind) if new else {}
        if self.room > 0:
            self.table.update(fresh)
            self.room -= sum(map(len, new))
        end = np.array([self.end], kind).tobytes()
        out = []
        for t, whole, x, got, at in zip(texts, known, units, found, holes):
            if whole is not None:
                data = whole + end
            elif got:
                for i in at:
                    got[i] = fresh[x[i]]
                data = b"".join(got) + end
            else:
                data = np.array([*(self._batch([t])[0] if t else []), self.end], kind).tobytes()
            out.append(np.frombuffer(data, kind).astype(np.uint32))
        return out


def _nones(values: list) -> list[int]:
    out, i = [], -1
    try:
        while True:
            i = values.index(None, i + 1)
            out.append(i)
    except ValueError:
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of ids (the finaliser of splitmix64)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_mixes: np.ndarray | None = None


def chunk_ends(ids: np.ndarray, mean: int = MEAN_CHUNK) -> list[int]:
    """Ends of the chunks of one id stream: after each id where the hash of the last WINDOW ids is 0 modulo mean."""
    global _mixes
    if _mixes is None:
        _mixes = _mixed(np.arange(65536, dtype=np.uint32))
    g = _mixes[ids] if not len(ids) or ids.max() < 65536 else _mixed(ids)
    h = g.copy()
    for j in (1, 2, 4):  # sums of 2, 4 and 8 ids, by doubling: WINDOW is 8
        h[j:] += h[:-j] << np.uint64(j * 5)
    h ^= h >> np.uint64(32)
    cut = np.flatnonzero((h & np.uint64(mean - 1) if mean & (mean - 1) == 0 else h % np.uint64(mean)) == 0) + 1
    ends = cut.tolist()
    if not ends or ends[-1] != len(ids):
        ends.append(len(ids))
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd last node moves up as it is; none: the hash of nothing."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, mean: int) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        enc = encoder(tokenizer, end_id)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                digests, counts, datas, roots, sizes, first = [], [], [], [], [], [0]
                for ids in enc.encode_many(part.column(1).to_pylist()):
                    at, raw = 0, ids.astype(f"<u{enc.width}").tobytes()
                    for end in chunk_ends(ids, mean):
                        data = raw[at * enc.width : end * enc.width]
                        digests.append(hashlib.sha256(data).digest())
                        counts.append(end - at)
                        datas.append(data)
                        at = end
                    roots.append(merkle_root(digests[first[-1] :]))
                    first.append(len(digests))
                    sizes.append(len(ids))
                chunks = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(datas, pa.binary())], ["digest", "n", "data"])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(roots, pa.binary()), lists], names=["doc_id", "n_tokens", "root", "chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, root binary, chunks array<struct<digest: binary, n: int, data: binary>>")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, mean: int = MEAN_CHUNK) -> None:
    """Writes the store of docs (doc_id, text) into the empty folder path."""
    spark = docs.sparkSession
    enc = saved(_encoded(docs, tokenizer, end_id, mean), "encoded", "zstd")
    pieces = enc.select(F.explode("chunks").alias("c")).select("c.*")
    pieces.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    lean = enc.select("doc_id", "n_tokens", "root", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))).alias("chunks"))
    rows = lean.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")

    def running(batches):
        total, k = 0, 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n, pa.int64()), pa.array(np.arange(k, k + len(n)), pa.int64())], names=[*b.schema.names, "rel", "k"])
            total, k = int(ends[-1]) if len(n) else total, k + len(n)

    kind = dict(lean.dtypes)["doc_id"]
    made = rows.withColumn("part", F.spark_partition_id()).mapInArrow(running, f"doc_id {kind}, n_tokens long, root binary, chunks array<struct<digest: binary, n: int>>, part int, rel long, k long")
    ordered = saved(made, "ordered")
    # one row a partition: their number is the session's shuffle partitions, whatever the input
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    recipes = ordered.join(totals.select("part", "base"), "part").select((F.col("part").cast("long") * F.lit(1 << 40) + F.col("k")).alias("seq"), "doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "chunks", "root")
    recipes.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{path}/recipes")
    wrote = _totals(spark.read.parquet(f"{path}/recipes"))
    wrote.withColumn("width", F.lit(encoder(tokenizer, end_id).width)).coalesce(1).write.parquet(f"{path}/manifest")


def _totals(recipes: DataFrame) -> DataFrame:
    """One row: documents, ids and root, of all recipes."""
    hashed = lambda *cols: F.unhex(F.sha2(F.concat(*cols), 256))
    text = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit("\x1f")).cast("binary")
    level = recipes.select("seq", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("ids"), hashed(*map(text, ("seq", "doc_id", "start", "n_tokens")), F.col("root")).alias("root"))
    for _ in range(math.ceil(63 / FAN_BITS)):  # up to the one node over all of seq
        kids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "root"))), lambda x: F.hex(x["root"]))
        level = level.groupBy(F.shiftright("seq", FAN_BITS).alias("seq")).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.unhex(F.sha2(F.array_join(kids, "").cast("binary"), 256)).alias("root"))
    return level.agg(F.coalesce(F.max("documents"), F.lit(0)).alias("documents"), F.coalesce(F.max("ids"), F.lit(0)).alias("ids"), F.max("root").alias("root"))


def _shift_tables() -> list[np.ndarray]:
    """tables[k][j][b]: the crc32 register byte b (at byte place j) carried over 2**k zero bytes."""
    poly = np.uint32(0xEDB88320)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)

    def over(mat: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint32(i)) & np.uint32(1), mat[i], np.uint32(0))
        return out

    one = np.where(bits & np.uint32(1), poly ^ (bits >> np.uint32(1)), bits >> np.uint32(1))  # one zero bit
    mat = one
    for _ in range(3):
        mat = over(mat, mat)  # 2, 4, 8 bits
    tables = []
    for _ in range(48):
        byte = np.arange(256, dtype=np.uint32)
        tables.append(np.stack([over(mat, byte << np.uint32(8 * j)) for j in range(4)]))
        mat = over(mat, mat)
    return tables


_tables: list[np.ndarray] = []


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What parts of checksum crc add to the crc32 of a whole in which `after` bytes follow them; the whole's crc32 is
    the exclusive or of what its parts add."""
    if not _tables:
        _tables.extend(_shift_tables())
    v, after = crc.astype(np.uint32), after.astype(np.int64)
    k = 0
    while (after >> k).any():
        t = _tables[k]
        moved = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        v = np.where((after >> k) & 1, moved, v).astype(np.uint32)
        k += 1
    return v


def _checked(recipes: DataFrame) -> DataFrame:
    """Each recipe's seq, doc_id, start, n_tokens and, after its root and total are verified, one row for each chunk: pos,
    digest and how many ids follow the chunk in its document."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                lists = []
                for seq, n, root, cs in zip(*(part.column(c).to_pylist() for c in ("seq", "n_tokens", "root", "chunks"))):
                    ends = np.cumsum([c["n"] for c in cs], dtype=np.int64)
                    if merkle_root([c["digest"] for c in cs]) != root or ends[-1] != n:
                        raise ValueError(f"recipe {seq} does not match its root")
                    lists.append((n - ends).tolist())
                at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                cs = part.column("chunks").flatten()
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in ("seq", "doc_id", "start", "n_tokens")), pa.array([i for x in lists for i in range(len(x))], pa.int32()), cs.field("digest"), pa.array(list(chain.from_iterable(lists)), pa.int64())], names=["seq", "doc_id", "start", "n_tokens", "pos", "digest", "after"])

    kind = dict(recipes.dtypes)["doc_id"]
    return recipes.select("seq", "doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(run, f"seq long, doc_id {kind}, start long, n_tokens long, pos int, digest binary, after long")


def _manifest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes, after they are compared with the manifest, and the width of ids."""
    head = spark.read.parquet(f"{path}/manifest").first()
    recipes = spark.read.parquet(f"{path}/recipes")
    if any(head[k] != v for k, v in _totals(recipes).first().asDict().items()):
        raise ValueError(f"the recipes in {path} do not match the manifest")
    return recipes, head["width"]


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) of every document, from the files."""
    recipes, width = _manifest(spark, path)

    def sums(batches):
        for b in batches:
            crcs, digests = [], b.column("digest").to_pylist()
            for digest, n, data in zip(digests, b.column("n").to_pylist(), b.column("data").to_pylist()):
                if hashlib.sha256(data).digest() != digest or len(data) != n * width:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(crcs, pa.int64())], names=["digest", "crc"])

    crcs = saved(spark.read.parquet(f"{path}/chunks").mapInArrow(sums, "digest binary, crc long"), "chunk-sums")
    refs = _checked(recipes)

    def placed(batches):
        for b in batches:
            if b.column("crc").null_count:
                raise ValueError(f"{path} lacks a chunk")
            v = crc_before(b.column("crc").to_numpy(), b.column("after").to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("seq", "doc_id", "start", "n_tokens")], pa.array(v.astype(np.int64))], names=["seq", "doc_id", "start", "n_tokens", "part"])

    kind = dict(recipes.dtypes)["doc_id"]
    parts = refs.join(crcs, "digest", "left").mapInArrow(placed, f"seq long, doc_id {kind}, start long, n_tokens long, part long")
    return parts.groupBy("seq", "doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32")).drop("seq")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """seq, doc_id, ids array<int> of every document, put together from its chunks."""
    recipes, width = _manifest(spark, path)
    refs = _checked(recipes).select("seq", "doc_id", "pos", "digest")
    whole = refs.join(spark.read.parquet(f"{path}/chunks").select("digest", "data"), "digest").groupBy("seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("x"))

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(c["data"] for c in x), f"<u{width}").astype(np.int32) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["seq", "doc_id", "ids"])

    return whole.mapInArrow(run, f"seq long, doc_id {dict(refs.dtypes)['doc_id']}, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids into a store and reads the store back."""
    path = fresh_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer())
    return read_summary(spark, path)
