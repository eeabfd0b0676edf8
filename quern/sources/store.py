"""A bucketed table whose units (sources, say) are replaced whole, with one publishing step.

Rows live in Parquet folders, one for each bucket of units and version; a manifest names the folder of every bucket. A replacement
reads the buckets of its units only, stages their rows anew beside the old ones, and publishes by one rename of a new manifest. A run that
fails before leaves the old state; one that comes second with the same rows leaves the files as they are, as a bucket whose
fingerprint has not changed keeps its folder; a batch that is replayed under its number changes nothing. Two writers cannot both
publish one version: the rename of the later one fails.

The driver reads one row for each bucket, of which there is a fixed number. Rows are dealt out by range of bucket, unit and order,
so that a unit of very many rows is written by several tasks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published the version meanwhile."""


class Refused(RuntimeError):
    """A check found rows that must not be published."""


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 32):
        """keys: the columns that name a unit; order: the columns that order its rows."""
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        f = fs.open(p)
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def manifest(self) -> dict:
        """The published state: version, schema, buckets (number -> folder and fingerprint) and the last batch of each writer."""
        names = [n for n in self._names(f"{self.path}/manifests") if re.fullmatch(r"[0-9]+\.json", n)]
        return json.loads(self._text(f"{self.path}/manifests/{names[-1]}")) if names else {"version": 0, "schema": None, "buckets": {}, "batches": {}}

    def _publish(self, state: dict) -> None:
        draft = f"{self.path}/manifests/draft-{uuid.uuid4().hex}"
        fs, p = self._fs(draft)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        to = self._fs(f"{self.path}/manifests/{state['version']:010d}.json")[1]
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise Conflict(f"version {state['version']} is published already")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if not state["schema"]:
            return None
        schema = StructType.fromJson(json.loads(state["schema"]))
        dirs = [f"{self.path}/{b['folder']}" for k, b in state["buckets"].items() if b["rows"] and (buckets is None or int(k) in buckets)]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The published rows."""
        got = self._rows(self.manifest())
        if got is None:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        return got

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def replace(self, rows: DataFrame, units: DataFrame | None = None, batch: tuple[str, int] | None = None, check: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> dict:
        """Publishes rows in place of all rows of their units and of `units` (which may have no new rows); gives the manifest.

        batch: writer and number; a number not above the writer's last is a replay and changes nothing. check: gives, of the old and
        new rows of the buckets concerned, those that forbid publishing.
        """
        state = self.manifest()
        if batch and batch[1] <= state["batches"].get(batch[0], -1):
            return state
        mine = rows.select(*self.keys)
        gone = (mine.unionByName(units.select(*self.keys)) if units is not None else mine).distinct()
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())
        old = self._rows(state, touched)
        new = rows if old is None else self._kept(old, gone).unionByName(rows.select(*old.columns))
        version, schema = state["version"] + 1, rows.schema.json() if old is None else state["schema"]
        folder = f"data/v{version:010d}-{uuid.uuid4().hex}"
        at = ["_bucket", *self.keys, *self.order]
        dealt = new.withColumn("_bucket", self._bucket()).repartitionByRange(*at).sortWithinPartitions(*at)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        parts = [int(n.removeprefix("_bucket=")) for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")]
        read = StructType.fromJson(json.loads(schema))
        staged = self.spark.read.schema(read).option("basePath", f"{self.path}/{folder}").parquet(*[f"{self.path}/{folder}/_bucket={b}" for b in parts]) if parts else self.spark.createDataFrame([], read)
        if check is not None:
            bad = check(self.spark.createDataFrame([], read) if old is None else old, staged).limit(5).collect()
            if bad:
                self._drop(folder)
                raise Refused(f"not published: {bad}")
        prints = {r["b"]: (r["n"], str(r["h"])) for r in staged.groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*read.names).cast("decimal(38,0)")).alias("h")).collect()}
        buckets = dict(state["buckets"])
        for b in touched:
            n, h = prints.get(b, (0, "0"))
            was = buckets.get(str(b))
            if was and (was["rows"], was["hash"]) == (n, h):
                self._drop(f"{folder}/_bucket={b}")
            else:
                buckets[str(b)] = {"folder": f"{folder}/_bucket={b}", "rows": n, "hash": h}
        if buckets == state["buckets"] and not batch and state["schema"]:
            self._drop(folder)
            return state
        after = {"version": version, "schema": schema, "buckets": buckets, "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})}
        self._publish(after)
        return after

    def _kept(self, old: DataFrame, gone: DataFrame) -> DataFrame:
        same = [old[k].eqNullSafe(gone[k]) for k in self.keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return old.join(gone, on, "left_anti")

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(f"{self.path}/{folder}")
        fs.delete(p, True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes folders that none of the last `keep` manifests names, and older manifests; gives what went. No writer may be at
        work meanwhile."""
        names = [n for n in self._names(f"{self.path}/manifests") if n.endswith(".json")]
        live = {b["folder"] for n in names[-keep:] for b in json.loads(self._text(f"{self.path}/manifests/{n}"))["buckets"].values()}
        out = []
        for v in self._names(f"{self.path}/data"):
            for part in self._names(f"{self.path}/data/{v}"):
                if part.startswith("_bucket=") and f"data/{v}/{part}" not in live:
                    out.append(f"data/{v}/{part}")
            if not any(f.startswith(f"data/{v}/") for f in live):
                out.append(f"data/{v}")
        for f in [*out, *(f"manifests/{n}" for n in names[:-keep])]:
            self._drop(f)
        return out


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """S23. Chunks (source_type, source_id, position, content, kind, parent: the position of the chunk above, or null, ...) with a
    running seq in each source and ids made of the source and seq, so that a rebuild gives the same ids; parent_id for parent."""
    w = Window.partitionBy("source_type", "source_id").orderBy("position")
    named = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.concat_ws("\x1f", "source_type", F.col("source_id").cast("string"), F.col(c).cast("string")), 256), 1, 32))
    x = chunks.withColumn("seq", (F.row_number().over(w) - 1).cast("int"))
    return x.withColumn("chunk_id", named("position")).withColumn("parent_id", named("parent")).drop("parent", "position")


def chunk_store(spark: SparkSession, path: str, buckets: int = 32) -> Store:
    """S23. Chunks by source: replacing a source's chunks removes what it had, and a source without new chunks goes."""
    return Store(spark, path, ["source_type", "source_id"], ["seq"], buckets)
