"""Incremental refresh: new files of a stream are hashed, compared with the state and set over it, a version per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loregraph.operators.history import changed, upsert


class State:
    """Versions of a table under one folder; the last one that was written whole is in force, so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int | None:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return None
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path(self.folder)) if s.getPath().getName().startswith("v") and fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        return max(done) if done else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.folder}/v{v}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


def refresh(state: State, batch: DataFrame, key: str, text: str, version: int) -> None:
    """Set what changed in ``batch`` over the state. A batch that comes again writes the same version again."""
    now = state.version()
    at = now if now is None or now < version else version - 1 if version > 0 else None  # a batch that comes again starts from what was before it
    before = None if at is None else state.spark.read.parquet(f"{state.folder}/v{at}")
    if before is None:
        new = batch.dropDuplicates([key])
        from loregraph.functions.text import content_hash

        state.write(new.withColumn("content_hash", content_hash(new[text])), version)
        return
    state.write(upsert(before, changed(batch.dropDuplicates([key]), before, key, text), [key]), version)


def follow(source: DataFrame, state: State, checkpoint: str, key: str = "path", text: str = "content") -> StreamingQuery:
    """Run ``refresh`` on each batch of a stream until what is there has been read."""
    return source.writeStream.foreachBatch(lambda df, n: refresh(state, df, key, text, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
