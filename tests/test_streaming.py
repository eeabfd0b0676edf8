"""Streams run to their end give what batches give."""

from pyspark.sql import functions as F

from quern.streaming import usage


def test_daily_counters_match_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = usage.daily_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.day): r.n for r in spark.table("counters").collect()}
    want = {(r.user_id, r.day): r.n for r in e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_token_bucket(spark, tmp_path):
    rows = [(1, 7, 0), (2, 7, 1), (3, 7, 10), (4, 8, 0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = usage.token_bucket(stream, rate=0.1).writeStream.outputMode("append").format("memory").queryName("bucket").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("bucket").collect()} == {1: True, 2: False, 3: True, 4: True}


def run_to_end(spark, tmp_path, e, made, name, mode="append"):
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = made(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_leases(spark, tmp_path):
    rows = [  # event, job, second, worker, kind, attempt
        (1, 1, 0, "a", "acquire", 0), (2, 1, 5, "b", "acquire", 0), (3, 1, 8, "a", "beat", 1), (4, 1, 30, "b", "acquire", 0), (5, 1, 31, "a", "done", 1),
        (6, 1, 32, "b", "done", 2), (7, 1, 90, "c", "acquire", 0), (8, 2, 4, "x", "beat", 0), (9, 2, 5, "x", "acquire", 0), (10, 2, 6, "x", "done", 7), (11, 2, 7, "x", "done", 1),
    ]
    e = spark.createDataFrame(rows, "event_id long, job_id long, s long, worker string, kind string, attempt long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.accepted, r.attempt) for r in run_to_end(spark, tmp_path, e, lambda s: usage.leases(s, 10.0), "leases")}
    assert {i for i, (ok, _) in got.items() if ok} == {1, 3, 4, 6, 9, 11} and got[4][1] == 2 and got[11][1] == 1


def test_repeated_events_and_rolling_latency(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", 1.0, 0), (1, "a", 1.0, 0), (2, "a", 3.0, 60), (3, "b", 9.0, 120)], "event_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000))
    assert sorted(r.event_id for r in run_to_end(spark, tmp_path / "x", e, lambda s: usage.unrepeated(s), "once")) == [1, 2, 3]
    got = run_to_end(spark, tmp_path / "y", e, lambda s: usage.rolling_latency(s, "1 hour", "1 hour"), "rolling", "complete")
    assert {r.event_type: list(r.p) for r in got} == {"a": [1.0, 3.0, 3.0], "b": [9.0] * 3}
