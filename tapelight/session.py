"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", shuffle: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tapelight")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle)} | extra).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none and runs in one process (tests, bench), a
    temporary folder is made and set; on a cluster that is an error, since
    no machine-local folder would survive the loss of an executor.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tapelight-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """Cut lineage: write ``df`` once to the shared folder and read it back; discard() deletes what no plan needs any more."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*written_ones) -> None:
    """Delete the folders behind results of written(), once nothing reads them."""
    for df in written_ones:
        delete(df.sparkSession, df._written_at)


def spread(df, by: str):
    """``df`` over a task per core by hash of ``by``: few rows that cost much each (Python steps) would else be coalesced into one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, by)
