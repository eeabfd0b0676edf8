"""Backfills and upserts of streams into a bucketed store, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.store import Store


def pending(rows: DataFrame, stored: DataFrame | None, keys: list[str], column: str) -> DataFrame:
    """M9. The rows of users and assistants whose stored row has no value in `column` yet; notes and tool rows never are."""
    talk = rows.where("role in ('user', 'assistant')")
    return talk if stored is None else talk.join(stored.where(F.col(column).isNotNull()).select(*keys), keys, "left_anti")


def upsert(stream: DataFrame, store: Store, made: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """M9/M3. Runs the stream to its end through `foreachBatch`: of each unit of the store the last row of a batch by `order` is
    made into what is stored and takes the unit's place. The batch's number goes into the manifest with its rows, so a batch that Spark
    runs again after a failure, before or after publishing, is stored once."""

    def run(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*store.keys).orderBy(*[F.desc(c) for c in order])
        last = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        store.replace(made(last), batch=(name, number))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
