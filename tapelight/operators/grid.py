"""Irregular readings -> a gapless regular grid per series.

``counter_grid`` takes readings of a cumulative counter. Per series it finds
resets (a reading below the one before: the counter started again, so the
reading itself is the increment), differences consecutive readings,
distributes each increment over the grid cells between the two readings in
proportion to overlap in time, and marks cells in which no reading lies.

Scale: the only windows over a whole series run over rows that were reduced
to one per cell first, so a series that holds a third of all rows costs no
more than its time span has cells; within a cell the window is keyed by
(series, cell). The cells of a silent stretch are generated from its two ends.

Defined results: rows without series, time or value (null or NaN) are no
readings. Equal stamps are ordered by ``tie``; repeated equal readings have
increment 0. A series with one reading has one cell. An empty table gives an
empty grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(c: Column, kind: str) -> Column:
    return c.isNotNull() & ~F.isnan(c) if kind in ("double", "float") else c.isNotNull()


def running_counter(df: DataFrame, series: str, time: str, step: Column, tie: str, cell_s: int = 300) -> DataFrame:
    """Add ``counter``: the running total of ``step`` (null counts as 0) in each series, via per-cell totals and a prefix over cells."""
    df = df.withColumns({"_cell": F.floor(F.unix_micros(time) / F.lit(cell_s * 1_000_000)).cast("bigint"), "_step": F.coalesce(F.when(~F.isnan(step.cast("double")), step.cast("double")), F.lit(0.0))})
    before = W.partitionBy(series).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    base = df.groupBy(series, "_cell").agg(F.sum("_step").alias("_sum")).select(series, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"))
    inside = W.partitionBy(series, "_cell").orderBy(time, tie).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum("_step").over(inside)).join(base, [series, "_cell"]).withColumn("counter", F.col("_base") + F.col("_in")).drop("_in", "_base", "_cell", "_step")


def counter_grid(df: DataFrame, series: str, time: str, counter: str, tie: str, value: str | None = None, cell_s: int = 300) -> DataFrame:
    """(series, cell_s, covered, n, last_value, filled_value, increment, resets), one row per cell from the first to the last reading of a series."""
    size = cell_s * 1_000_000
    kinds = dict(df.dtypes)
    df = df.where(F.col(series).isNotNull() & F.col(time).isNotNull() & usable(F.col(counter), kinds[counter]))
    r = df.select(F.col(series).alias("series"), F.unix_micros(time).alias("t"), F.col(counter).cast("double").alias("c"), F.col(tie).alias("tie"), (F.col(value) if value else F.lit(None).cast("double")).alias("v"))
    r = r.withColumn("cell", F.floor(F.col("t") / F.lit(size)).cast("bigint"))
    # differences inside a cell
    inside = W.partitionBy("series", "cell").orderBy("t", "tie")
    r = r.withColumn("_p", F.lag("c").over(inside))
    diff = F.when(F.col("_p").isNull(), 0.0).when(F.col("c") < F.col("_p"), F.col("c")).otherwise(F.col("c") - F.col("_p"))
    at = F.struct("t", "tie")
    cells = r.groupBy("series", "cell").agg(
        F.count("*").alias("n"), F.sum(diff).alias("inner"), F.count_if(F.col("c") < F.col("_p")).alias("resets"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("c", at).alias("c0"), F.max_by("c", at).alias("c1"), F.max_by("v", at).alias("last_value"),
    )
    # differences from cell to cell
    along = W.partitionBy("series").orderBy("cell")
    cells = cells.withColumns({"next": F.lead("cell").over(along), "tn": F.lead("t0").over(along), "cn": F.lead("c0").over(along), "pc": F.lag("c1").over(along), "pt": F.lag("t1").over(along)})
    jump = lambda now, was: F.when(was.isNull() | now.isNull(), 0.0).when(now < was, now).otherwise(now - was)
    share = lambda lo, hi, a, b: F.when(b > a, F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0)) / (b - a)).otherwise(0.0)
    lo = F.col("at") * size
    out = F.col("cell") == F.col("at")
    into, onward = jump(F.col("c0"), F.col("pc")), jump(F.col("cn"), F.col("c1"))
    spread = onward * share(lo, lo + size, F.col("t1"), F.col("tn"))
    head = F.when(F.col("pt").isNotNull(), into * share(lo, lo + size, F.col("pt"), F.col("t0"))).otherwise(F.coalesce(F.col("c0") * 0, F.lit(0.0)))
    span = F.sequence(F.col("cell"), F.coalesce(F.col("next") - 1, F.col("cell")))
    return cells.withColumn("at", F.explode(span)).select(
        "series", (F.col("at") * cell_s).alias("cell_s"), out.alias("covered"), F.when(out, F.col("n")).otherwise(0).alias("n"),
        F.when(out, F.col("last_value")).alias("last_value"), F.col("last_value").alias("filled_value"),
        (spread + F.when(out, F.col("inner") + head).otherwise(0.0)).alias("increment"),
        F.when(out, F.col("resets") + F.coalesce((F.col("pc") > F.col("c0")).cast("int"), F.lit(0))).otherwise(0).alias("resets"),
    )
