"""Structured Streaming: incremental ingestion, exactly-once within the watermark, streaming bars, stateful gap episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tapelight.session import scratch


def follow(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as they come; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: str, ts: str, late: str = "2 minutes") -> DataFrame:
    """Repeats of a key within the watermark dropped; state is bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def streaming_bars(stream: DataFrame, keys: list[str], ts: str, width: str, price: str = "price", weight: str = "size", tie: str = "trade_id") -> DataFrame:
    """make_bars over tumbling windows of a stream."""
    known = F.col(price).isNotNull()  # a null price counts in nothing
    at, w = F.when(known, F.struct(F.col(ts), F.col(tie))), F.when(known, F.col(weight))
    return stream.groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.count(price).alias("n"), F.max_by(price, at).alias("last"), (F.sum(F.col(price) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("vwap"), F.sum(w).alias("vol")
    ).select(*keys, F.unix_seconds("w.start").alias("bar"), "n", "last", "vwap", "vol")


def rolling(stream: DataFrame, keys: list[str], ts: str, width: str, step: str, x: str, late: str = "2 minutes") -> DataFrame:
    """Sum of ``x`` over the last ``width`` at every ``step``: sliding windows, each row in width/step of them; state ends with the watermark."""
    s = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, step).alias("w"))
    return s.agg(F.sum(x).alias("sum"), F.count(x).alias("n")).select(*keys, F.unix_seconds("w.end").alias("upto"), "sum", "n")


def since(stream: DataFrame, ts: str, start: str, back: str = "24 hours") -> DataFrame:
    """A cold start: only rows from ``back`` before ``start`` on, a filter that reaches the scan."""
    return stream.where(F.col(ts) >= F.lit(start).cast("timestamp") - F.expr(f"interval {back}"))


def drain(df: DataFrame, mode: str = "complete", name: str | None = None) -> DataFrame:
    """Run a query over all that is there (availableNow) and return what it wrote; an aggregate in complete mode keeps its open windows."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name or "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def gap_alerts(stream: DataFrame, entity: str, t: str, gap: str, opens: float = 0.05, closes: float = 0.02) -> DataFrame:
    """Open and close events of gap episodes with hysteresis, per entity, over a stream; state is one start time per entity."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        since = None if since is None or since < 0 else since
        out = []
        for x in sorted((r for b in batches for r in zip(b[t], b[gap])), key=lambda r: r[0]):
            if since is None and x[1] >= opens:
                since = int(x[0])
                out.append((key[0], since, None, "open"))
            elif since is not None and x[1] <= closes:
                out.append((key[0], since, int(x[0]), "close"))
                since = None
        state.update((-1 if since is None else since,))
        yield pd.DataFrame(out, columns=[entity, "start", "stop", "event"]).astype({"start": "Int64", "stop": "Int64"})

    kind = dict(stream.dtypes)[entity]
    return stream.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, start bigint, stop bigint, event string", "since bigint", "append", GroupStateTimeout.NoTimeout)
