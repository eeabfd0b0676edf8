"""The codec against the library: ids, round trips and byte spans; the compiled character map against its own rules."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from quern.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.default_model())


def texts():
    rng = random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "<s>", "</s>", "\x00", "𝔘", " of", "\t", "　", ".", " ,", "ß"]
    return ["", " ", "   ", "\n", "x" * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def test_ids_and_spans(codec):
    for t, (ids, said, spans) in zip(texts(), codec.encode_many(texts())):
        assert ids == codec.sp.encode(t, add_eos=True)
        assert said == " ".join(map(str, ids))
        assert len(spans) == len(ids) + 1 and (spans[1:] >= spans[:-1]).all() and spans[-1] == len(t.encode())
        data = t.encode()
        for i, a, z in zip(ids[:-1], spans[:-2].tolist(), spans[1:-1].tolist()):
            if not codec.sp.is_byte(i):
                assert data[a:z].decode().replace(" ", "▁") in (codec.sp.id_to_piece(i), codec.sp.id_to_piece(i)[1:])


def test_empty_map_is_aligned_as_by_prefix(codec):
    """The whole-text alignment of an empty map is that of taking prefixes one at a time."""
    space = S.MARK.encode()
    for t in texts():
        a, b = codec.map.as_it_is(t.encode(), space), codec.map.by_prefix(t.encode(), space)
        assert a[0] == b[0] and (a[1] == b[1]).all()


def mapped_model():
    """The model with a compiled map in place of its empty one, and white space squeezed."""
    with open(S.default_model(), "rb") as f:
        model = f.read()
    blob, offsets = b"", {}
    for k, v in {"ａ": "a", "ﬁ": "fi", "x": "y", "xz": "", "　": " ", "…": "...", "é": "e\u0301"}.items():
        offsets[k.encode()] = len(blob)
        blob += v.encode() + b"\0"
    t = trie(offsets)
    spec = field(2, struct.pack("<I", len(t)) + t + blob) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
    return b"".join(field(k, v) if isinstance(v, bytes) else bytes([k << 3, v]) for k, v in S._fields(model) if k != 3) + field(3, spec)


def test_model_with_a_map(spark, tmp_path):
    """Ids are the library's, the normalised text is the library's, and every piece's span is text that normalises to it."""
    import sentencepiece

    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(mapped_model())
    c, norm = S.Codec(path), sentencepiece.SentencePieceNormalizer(model_file=path)
    rng = random.Random(3)
    parts = ["ａ", "ﬁ", "x", "xz", "　", "…", "é", " ", "  ", "word", "of", "\n", "𝔘", "xx"]
    made = ["", " ", "xz"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for t, (ids, _, spans) in zip(made, c.encode_many(made)):
        assert ids == c.sp.encode(t, add_eos=True)
        assert c.map.normalize(t)[0].decode() == norm.normalize(t)
        assert (spans[1:] >= spans[:-1]).all() and spans[0] >= 0 and spans[-1] <= len(t.encode())
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.encode(df, path, ["doc_id"]).collect()}
    whole = got[next(i for i, t in enumerate(made) if "ﬁ" in t)]
    assert len(whole.ids) == len(whole.begins) == len(whole.ends)
    assert all(list(got[i].ids) == c.sp.encode(t, add_eos=True) for i, t in enumerate(made))


def test_full_table_changes_nothing(codec):
    c = S.Codec(S.default_model())
    c.room = 0
    assert [x[0] for x in c.encode_many(texts())] == [x[0] for x in codec.encode_many(texts())]


def trie(keys):
    """A double array over keys (bytes -> offset of its replacement), built by first fit: a reader's independent counterpart."""
    units, used = {0: 0}, {0}

    def place(node, group, depth):
        kids = sorted({k[depth] for k in group if len(k) > depth})
        leaf = [k for k in group if len(k) == depth]
        base = 1
        while any((base ^ c) in used for c in [*kids, *([0] if leaf else [])]) or base in used:
            base += 1
        units[node] |= (base ^ node) << 10
        for c in [*kids, *([0] if leaf else [])]:
            used.add(base ^ c)
        if leaf:
            units[node] |= 1 << 8
            units[base] = keys[leaf[0]] | 1 << 31
        for c in kids:
            units[base ^ c] = c
        for c in kids:
            place(base ^ c, [k for k in group if len(k) > depth and k[depth] == c], depth + 1)

    place(0, list(keys), 0)
    n = -(-(max(units) + 257) // 256) * 256  # the library reads whole kilobytes
    return b"".join(struct.pack("<I", units.get(i, 0)) for i in range(n))


def field(n, data):
    out, size = bytes([n << 3 | 2]), len(data)
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + data


def test_character_map_takes_the_longest_prefix():
    blob, offsets = b"", {}
    for k, v in {"ａ": b"a", "ﬁ": b"fi", "x": b"y", "xz": b"", "　": b" "}.items():
        offsets[k.encode()] = len(blob)
        blob += v + b"\0"
    t = trie(offsets)
    body = struct.pack("<I", len(t)) + t + blob

    m = S.CharacterMap(field(2, body) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1]))
    norm, where = m.normalize("  ａxz　ﬁx ")
    assert norm.decode() == "▁a▁fiy"
    assert where.tolist() == [2, 2, 2, 2, 7, 7, 7, 10, 10, 13, 14]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hi there", None), (3, "Hi there", None)], "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in S.digests(df, S.default_model(), ["doc_id"]).select("doc_id", "n_tokens", "round_trip").collect())
    assert [g[1] for g in got][:2] == [1, 1] and all(g[2] for g in got) and len(got) == 4
    enc = S.encode(df.select("doc_id", "text"), S.default_model(), ["doc_id"]).where("doc_id = 3").first()
    assert enc.decoded == "Hi there" and len(enc.ids) == len(enc.begins) == len(enc.ends)
    assert S.digests(df.limit(0), S.default_model(), ["doc_id"]).count() == 0
    odd = df.withColumn("n_tokens", F.lit("x")).withColumn("_text", F.lit(1))
    out = S.stage(spark, odd, "")
    assert len(set(out.columns)) == len(out.columns) == 9 and dict(out.dtypes)["n_tokens"] == "bigint" and out.count() == 4
