"""Named-table access for the driver's Parquet datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TESTDATA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                   "events", "documents", "embeddings", "pages", "benchmark", "labels",
                   "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory (``<sf_dir>/<name>.parquet``)."""
    if name not in TESTDATA_TABLES:
        raise KeyError(f"unknown table {name!r}")
    return utc_timestamps(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def utc_timestamps(df: DataFrame) -> DataFrame:
    """PRJ-5 for naive columns: wall-clock (TIMESTAMP_NTZ) values are taken
    as UTC instants. With the session zone pinned to UTC this is a plain
    cast, evaluated inside the scan's codegen stage."""
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name)
                       if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                       for f in df.schema.fields])
