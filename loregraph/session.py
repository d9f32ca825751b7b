"""Session settings every plan of this library assumes, and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC throughout; AQE re-plans joins, coalesces partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, name: str = "loregraph", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` wins when the cluster names one; only in a local session where it is unset a
    temporary folder is made. On a cluster that would be a folder of one machine: an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.match(r"local(?:\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    target = named or os.path.join(tempfile.gettempdir(), "loregraph-checkpoints")
    sc.setCheckpointDir(target)
    return target


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
