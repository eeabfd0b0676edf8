"""7. SentencePiece encoding and decoding with byte spans of the original text.

The ids are the library's own. Beside them the operator normalises each text itself: at each place the longest key
of the model's compiled character map that is a prefix of the rest is replaced (one character passes unchanged where
no key fits), and the alignment of every normalised byte to the original is recorded. Walking the pieces over the normalised
bytes gives each piece's span of original UTF-8 bytes.

Every row's spans come from that alignment, also where the map is empty; an empty map takes each character as it is, so its
alignment is made for a whole text at once.

Where the model's map is empty and its vocabulary has no piece with a space mark after another character, no merge crosses
the start of a run of spaces; such texts are encoded by those units, and a bounded table keeps the units seen first.
Otherwise the library encodes whole texts. Null and empty texts give only the end id. Other columns pass unchanged, but one named as a column made here gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK = "▁"
#: Characters of units that a worker's table takes before it is full.
CACHE_CHARS = 4_000_000
_unit = re.compile(" +[^ ]*")


def _fields(buf: bytes):
    """(field number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = buf[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, buf[i : i + n]
            i += n


class CharacterMap:
    """A model's normaliser: the compiled map of prefixes and the white-space flags."""

    def __init__(self, spec: bytes, user_symbols: tuple[str, ...] = ()):
        f = dict(_fields(spec))
        self.dummy_prefix, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        blob = f.get(2, b"")
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]
        self.symbols = sorted((s.encode() for s in user_symbols), key=len, reverse=True)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a position, or None."""
        units, best = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        start = best[1]
        return best[0], self.strings[start : self.strings.index(b"\0", start)]

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte offset."""
        space = MARK.encode() if self.escape else b" "
        if not (self.units or self.symbols or self.squeeze):
            return self.as_it_is(text.encode(), space)
        return self.by_prefix(text.encode(), space)

    def by_prefix(self, data: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[int, int, bytes]] = []
        i = 0
        while i < len(data):
            sym = next((s for s in self.symbols if data.startswith(s, i)), None)
            hit = (len(sym), sym) if sym else self.longest(data, i)
            if hit is None:
                c = data[i]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                hit = n, data[i : i + n]
            parts.append((i, i + hit[0], hit[1]))
            i += hit[0]
        if self.squeeze:
            while parts and parts[0][2] in (b" ", b""):
                parts.pop(0)
        out, where = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            where.extend([at] * len(piece))

        if not parts:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            put(space, parts[0][0])
        after_space, end = self.squeeze, parts[0][0]
        for at, end, piece in parts:
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            for b in piece:
                put(space if b == 32 else bytes([b]), at)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = where[-1]
                del where[-len(space) :]
        return bytes(out), np.asarray([*where, end], np.int64)


    def as_it_is(self, data: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """What by_prefix gives with an empty map that keeps all spaces."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        begin = (raw & 0xC0) != 0x80  # the first byte of a character
        at = np.maximum.accumulate(np.where(begin, np.arange(len(raw)), 0))
        where = np.repeat(at, np.where(raw == 32, len(space), 1))
        out = data.replace(b" ", space)
        if self.dummy_prefix:
            out, where = space + out, np.concatenate((np.zeros(len(space), np.int64), where))
        return out, np.concatenate((where, [len(raw)]))


class Codec:
    """Encodes with ids, original byte spans and the ids' decimal text; decodes with the library."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.eos = self.sp.eos_id()
        pieces, norm, suffix = [], b"", False
        for k, v in _fields(model):
            if k == 1:
                pieces.append(dict(_fields(v)))
            elif k == 2:
                suffix = bool(dict(_fields(v)).get(24, 0))
            elif k == 3:
                norm = v
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.map = CharacterMap(norm, tuple(n for n, k in zip(names, kinds) if k == 4))
        #: bytes of each piece in the normalised text; a byte piece stands for one byte, an unknown piece for what it covers
        self.size = np.array([1 if k == 6 else 0 if k in (2, 3) else len(n.encode()) for n, k in zip(names, kinds)], np.int64)
        inner = re.compile(f"[^{MARK}]{MARK}")
        m = self.map
        self.by_unit = not (m.units or m.squeeze or m.symbols or suffix) and m.dummy_prefix and m.escape and MARK in names and not any(k == 1 and inner.search(n) for n, k in zip(names, kinds)) and 6 in kinds
        self.cache: dict[str, tuple[int, ...]] = {" ": (self.sp.piece_to_id(MARK),)}
        self.room = CACHE_CHARS
        self.said = [str(i) for i in range(self.sp.get_piece_size())].__getitem__

    def encode(self, text: str | None) -> tuple[list[int], str, np.ndarray]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray]]:
        """For each text its ids with the end id, their decimals joined by spaces, and the len(ids) + 1 byte offsets at
        which pieces begin. Units that the table lacks go to the library in one call."""
        units = [_unit.findall(" " + t) if t and self.by_unit and MARK not in t else None for t in texts]
        table = self.cache
        if new := list({u for x in units if x for u in x if u not in table}):
            fresh = dict(zip(new, map(tuple, self.sp.encode([u[1:] for u in new], num_threads=1))))
            if self.room > 0:
                table.update(fresh)
                self.room -= sum(map(len, new))
            else:
                table = {u: table[u] for x in units if x for u in x if u in table} | fresh
        return [self._one(t, u, table) for t, u in zip(texts, units)]

    def _one(self, text: str | None, units: list[str] | None, table) -> tuple[list[int], str, np.ndarray]:
        if not text:
            return [self.eos], str(self.eos), np.zeros(2, np.int64)
        ids = list(chain.from_iterable(map(table.__getitem__, units))) if units else self.sp.encode(text)
        _, where = self.map.normalize(text)
        spans = where[np.minimum(np.concatenate(([0], self._ends(text, ids))), len(where) - 1)]
        spans = np.concatenate((spans, spans[-1:]))
        ids.append(self.eos)
        return ids, " ".join(map(self.said, ids)), spans

    def _ends(self, text: str, ids: list[int]) -> np.ndarray:
        sizes = self.size[ids]
        if (sizes == 0).any():  # unknown pieces: the library knows how much normalised text each covers
            surface = self.sp.encode(text, out_type=str)
            sizes = np.array([1 if self.sp.is_byte(i) else len(s.encode()) for i, s in zip(ids, surface)], np.int64)
        return np.cumsum(sizes)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process and model."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, model: str, keep: list[str], made: str, row) -> DataFrame:
    """keep columns of df, but those named as one that is made, then the columns that row(codec, text) gives, with the
    schema `made`."""
    kinds = StructType.fromDDL(made)
    keep = [c for c in keep if c.lower() not in kinds.names]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_".join(["text", *keep])))  # a name that none has
    out = StructType([*src.schema[: len(keep)], *kinds])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        c = codec(model)
        types = to_arrow_schema(kinds)
        for b in batches:
            step = 100  # rows of a result, so that long texts do not meet in one batch
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts = part.column(part.num_columns - 1).to_pylist()
                cols = list(zip(*(row(c, t, *got) for t, got in zip(texts, c.encode_many(texts)))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(list(x), t.type) for x, t in zip(cols, types))], names=[*keep, *types.names])

    return src.mapInArrow(run, out)


def encode(df: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """ids array<int> (end id last), begins and ends array<int> (original UTF-8 byte spans), decoded string."""

    def row(c: Codec, text: str | None, ids, said, spans):
        return ids, spans[:-1].tolist(), spans[1:].tolist(), c.decode(ids)

    return _mapped(df, model, keep, "ids array<int>, begins array<int>, ends array<int>, decoded string", row)


def digests(df: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """What encode gives, as digests made in the same pass: counts, hashes of the ids and of the decoded text, crc32 of
    the piece offsets as little-endian 64-bit integers, and whether the text came back unchanged."""

    def row(c: Codec, text: str | None, ids, said, spans):
        decoded = c.decode(ids)
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(spans.astype("<i8").tobytes()), decoded == (text or "")

    return _mapped(df, model, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, round_trip boolean", row)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids, decoded text and spans of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with all its columns and the digests of its encoding."""
    return digests(docs, default_model(), docs.columns)
