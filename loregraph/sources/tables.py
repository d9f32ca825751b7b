"""Parquet tables of a data folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str | list[str], order: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (a redelivered row replaces earlier ones).

    Only ``columns`` are given and read, besides the key and the order; without any, all are. Rows that tie on
    ``order`` are told apart by a hash of these columns, so that the choice doesn't depend on the partitioning. Rows with a null key are kept as they are, one per null key group.
    ``max_by`` aggregates on the map side, so a key that repeats often costs one row per partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if columns:
        df = df.select(*dict.fromkeys([*keys, *columns, order]))
    plain = [c for c, t in df.dtypes if not t.startswith("map") and "map<" not in t]
    rank = F.struct(F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns or df.columns)])
