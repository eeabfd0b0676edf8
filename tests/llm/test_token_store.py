"""The store: exact ids, exact round trip, checksums, detected damage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import token_store as K


def test_ids_equal_the_library():
    e = K.Encoder(K.default_tokenizer())
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "ª", "²", "<|endoftext|>", "'s", "'ll", "'", "\x00", "the", " of", "\t", "_", "12", "!", "?!", "ß", "\xad", "\xa0", "\r", "Ā", "字"]
    texts = ["", "x" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for room in (10**7, 0):
        e.room, e.table = room, {}
        assert [x.tolist() for x in e.encode_many(texts)] == [e.tk.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_combined_checksums():
    parts = [bytes([i]) * n for i, n in enumerate((1, 700, 0, 3, 70000))]
    after = np.cumsum([len(p) for p in parts][::-1])[::-1] - [len(p) for p in parts]
    v = K.crc_before(np.array([zlib.crc32(p) for p in parts]), after)
    assert int(np.bitwise_xor.reduce(v)) == zlib.crc32(b"".join(parts))


def test_chunks_follow_content():
    ids = np.random.default_rng(0).integers(0, 50000, 20000).astype(np.uint32)
    cut = lambda x: {tuple(x[a:z]) for a, z in zip([0, *K.chunk_ends(x)[:-1]], K.chunk_ends(x))}
    assert len(cut(ids) & cut(np.concatenate((ids[:50], ids)))) > 0.8 * len(cut(ids))


def test_store_round_trip(spark, tmp_path):
    rows = [(3, "one two three " * 400, "x"), (1, None, "x"), (2, "", None), (7, "one two three " * 400, "x"), (None, "null id", "x"), (3, "other", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    path = str(tmp_path / "store")
    K.write_store(df, path, K.default_tokenizer())
    got = K.read_summary(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 7]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    tk = K.Encoder(K.default_tokenizer()).tk
    want = sorted((tk.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, _ in rows)
    ids = [list(r.ids) for r in K.read_ids(spark, path).collect()]
    assert sorted(ids) == want
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    bad = chunks.withColumn("data", F.concat(F.unhex(F.lit("ffff")), F.expr("substring(data, 3)")))
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}2/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}2/manifest")
    bad.write.parquet(f"{path}2/chunks")
    with pytest.raises(Exception, match="does not match its digest"):
        K.read_summary(spark, f"{path}2").collect()


def test_changed_recipes_are_noticed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(40)], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "store")
    K.write_store(df, path, K.default_tokenizer())
    recipes = spark.read.parquet(f"{path}/recipes")
    assert K.read_summary(spark, path).count() == 40
    first = recipes.agg(F.min("seq")).first()[0]
    last = recipes.agg(F.max("seq")).first()[0]
    swapped = F.when(F.col("seq") == first, last).when(F.col("seq") == last, first).otherwise(F.col("seq"))
    renamed = F.when(F.col("doc_id") == 3, 4).otherwise(F.col("doc_id")).cast("long")
    for i, bad in enumerate([recipes.withColumn("seq", swapped), recipes.withColumn("doc_id", renamed), recipes.where(F.col("seq") != last), recipes.where(F.col("seq") % 2 == 0), recipes.limit(0), recipes.union(recipes.where(F.col("seq") == first))]):
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{path}-{i}/chunks")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-{i}/manifest")
        bad.write.parquet(f"{path}-{i}/recipes")
        with pytest.raises(Exception, match="do not match the manifest"):
            K.read_summary(spark, f"{path}-{i}")
        with pytest.raises(Exception, match="do not match the manifest"):
            K.read_ids(spark, f"{path}-{i}")
    chunks = spark.read.parquet(f"{path}/chunks")
    gone = chunks.agg(F.min("digest")).first()[0]
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{path}-lost/{part}")
    chunks.where(F.col("digest") != F.lit(gone)).write.parquet(f"{path}-lost/chunks")
    with pytest.raises(Exception, match="lacks a chunk"):
        K.read_summary(spark, f"{path}-lost").collect()


def test_empty_table(spark, tmp_path):
    K.write_store(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "s"), K.default_tokenizer())
    assert K.read_summary(spark, str(tmp_path / "s")).count() == 0
