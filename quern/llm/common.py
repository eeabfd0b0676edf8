"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the
    whole session is one machine's (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-quern-")
        sc.setCheckpointDir(where)
    # a path without a scheme is of the default file system, for Spark and for what tasks open by themselves alike
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application's operators have left in the shared folder; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, compression: str = "zstd") -> DataFrame:
    """saved, in as many buckets of key as there are shuffle partitions: joins on key shuffle their other side only. It is an external
    table of the session's catalog until it is released."""
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"quern_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out._saved_at, out._saved_as = path, table
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing will read any more, as what was made of them is written itself: the successor is in the
    shared folder too, so a lost executor costs nothing. Other frames are passed over. Spark deletes shuffle files once the driver's JVM has
    collected the plans that wrote them, which may be long after they are read; here it is asked to."""
    for df in tables:
        if name := getattr(df, "_saved_as", None):
            df.sparkSession.sql(f"DROP TABLE {name}")
        if where := getattr(df, "_saved_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def min_hashes(hashes: np.ndarray, starts: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """A row of len(mult) min-hashes for each set of mixed 32-bit hashes; sets stand one after the other, none is empty,
    and begin at starts. mult: odd 32-bit multipliers."""
    out = np.empty((len(mult), len(starts)), np.uint32)
    for k, m in enumerate(mult):
        np.minimum.reduceat(hashes * m, starts, out=out[k])
    return out.T.copy()


#: Bits of a filter; the driver sees one row for each 64 of them at most.
FILTER_BITS = 1 << 26


def membership(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over the only column of keys, a long of evenly spread hashes: FILTER_BITS bits whatever their number,
    so it may be broadcast. Beyond some tens of millions of keys it lets most rows pass, and saves nothing."""
    name = keys.columns[0]
    at = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(name, k), F.lit(FILTER_BITS)) for k in (0, 32)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    got = words.toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be in the filter; a key that is in it always is."""
    out = np.ones(len(keys), bool)
    for k in (0, 32):
        at = (keys.view(np.uint64) >> np.uint64(k)) % np.uint64(FILTER_BITS)
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def numbered(df: DataFrame, name: str, table: str) -> DataFrame:
    """df saved with a column of unique numbers: they are fixed once a task's rows are written."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()), table)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt: Column, n: int = 16) -> DataFrame:
    """Join with a right side of few rows per key; a key that holds a large share of left is dealt over n partitions.

    right is copied n times, so it must be the small side; salt is an integer column of left.
    """
    left = left.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star contraction.

    edges: columns a, b (long). Returns node, component (the smallest node reachable). Self-links, repeats and nulls
    are allowed. Each round is written to the shared folder; the driver reads one sum a round, to see whether links still
    change, and the round before is deleted. A star's centre with very many leaves is a minimum over a key, which is combined before
    the shuffle, and its leaves are dealt out when they learn it.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = saved(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above u is linked to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        big = salted_join(both.where("v > u"), least, ["u"], "inner", F.col("v"), 8).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every neighbour below u, and u, are linked to the least neighbour
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        last, e = e, saved(small.where("u <> v").distinct(), "edges")
        released(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = nodes.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    out = saved(nodes.union(roots), "components")
    released(e)
    return out


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b): stars of the components so far and the links. Without a link they stay."""
    links = saved(links.select("a", "b"), "links")
    if links.isEmpty():
        return comp
    out = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    released(links)
    return out
