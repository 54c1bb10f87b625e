"""Parquet table scans with instants brought to TIMESTAMP (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``name``; zone-less timestamps are UTC wall clocks and are cast once here.

    The cast sits above the scan, so column pruning and filters on other
    columns still reach parquet.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in ntz}) if ntz else df
