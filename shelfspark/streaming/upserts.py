"""Resumable upserts from a stream (an extension: the batch form is in operators.upsert)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.upsert import upsert


class StreamState:
    """A keyed table kept in versions of parquet files in a shared folder, spread over ``parts``
    folders by a hash of the key. A micro-batch merges only the parts its keys fall into; its
    version lists, for every part, the version that holds it. The batch's number names a version,
    so a batch that runs again writes the same version again, and a new object (after a restart)
    goes on from the newest version before its batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], overwrite: list[str], keep: list[str], parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path, parts
        self.keys, self.order, self.overwrite, self.keep = keys, order, overwrite, keep
        self.columns = [*keys, *dict.fromkeys([*order, *overwrite, *keep])]

    def _names(self, folder: str) -> list[str]:
        """The names of what lies in a folder of the shared file system."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _held(self, before: int | None = None) -> dict[int, int]:
        """The version that holds each part, as the newest finished version (before a number) says."""
        numbers = sorted((int(n[1:]) for n in self._names(f"{self.path}/held") if n[1:].isdigit()), reverse=True)
        done = [n for n in numbers if (before is None or n < before) and "_SUCCESS" in self._names(f"{self.path}/held/v{n}")]
        if not done:
            return {}
        return {r["part"]: r["version"] for r in self.spark.read.schema("part int, version long").json(f"{self.path}/held/v{done[0]}").collect()}  # one row a part

    def merge(self, batch: DataFrame, number: int) -> None:
        held = self._held(number)
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias("_part")
        touched = [r["_part"] for r in batch.select(part).distinct().collect()]  # at most ``parts``
        rows = batch.select(*self.columns, part)
        known = [f"{self.path}/v{held[p]}/_part={p}" for p in touched if p in held]
        if known:
            rows = rows.unionByName(self.spark.read.parquet(*known).select(*self.columns, part))
        over = [c for c in dict.fromkeys([*self.order, *self.overwrite]) if c not in self.keys]
        if touched:
            upsert(rows, [*self.keys, "_part"], self.order, over, self.keep).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/v{number}")
        now = held | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").json(f"{self.path}/held/v{number}")

    def read(self) -> DataFrame:
        """The state of the newest version."""
        held = self._held()
        if not held:
            raise ValueError("nothing was merged yet")
        folders = [f"{self.path}/v{v}/_part={p}" for p, v in sorted(held.items())]
        return self.spark.read.parquet(*folders).select(*self.columns)


def stream_upsert(source: DataFrame, state: StreamState, checkpoint: str) -> DataFrame:
    """Applies all that ``source`` (a streaming DataFrame) holds now and returns the state."""
    run = source.writeStream.foreachBatch(lambda b, n: state.merge(b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return state.read()


def tumbling_counts(source: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and window of event time; rows later than ``late`` behind the newest seen
    are dropped once their window is closed."""
    return source.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def fresh(path: str) -> str:
    return f"{path}/stream-{uuid.uuid4().hex}"


def progress(query) -> str:
    return json.dumps(query.lastProgress or {})
