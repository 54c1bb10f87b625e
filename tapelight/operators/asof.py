"""As-of look-ups, event windows and band joins without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, t: str, cols: list[str], tie: str) -> DataFrame:
    """Each left row with the latest right row at or before its ``t`` within ``key``, and how old that is.

    Both sides are put in one sequence and values are carried forward: one
    shuffle by key, linear in the rows, whatever the number of look-ups. At
    equal times right rows come first, in the order of ``tie``.
    """
    r = right.select(F.col(key), F.col(t), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(t).alias("_at"), *cols).alias("_r"))
    lcols = [c for c in left.columns if c not in (key, t)]
    left_ = left.select(F.col(key), F.col(t), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = r.unionByName(left_, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(key, t, "_l.*", *[F.col(f"_m.{c}").alias(c) for c in cols], (F.col(t) - F.col("_m._at")).alias("age"))


def event_windows(events: DataFrame, trades: DataFrame, before: int, after: int, bucket: int = 86400) -> DataFrame:
    """(event columns, trade columns): trades in [t0 - before, t0 + after]; an equi-join on time buckets, then the exact bounds."""
    lo, hi = F.floor((F.col("t0") - before) / bucket), F.floor((F.col("t0") + after) / bucket)
    e = events.withColumn("_b", F.explode(F.sequence(lo, hi)))
    return e.join(trades.withColumn("_b", F.floor(F.col("t") / bucket)), "_b").where((F.col("t") >= F.col("t0") - before) & (F.col("t") <= F.col("t0") + after)).drop("_b")


def band_join(a: DataFrame, b: DataFrame, da: str, db: str, days: int, on: list[str] | None = None) -> DataFrame:
    """Pairs whose dates lie within ``days``: spans of days as wide as the band, so an a row goes to the two at most that its band reaches and meets b there; then the exact bounds."""
    width, at = 2 * days + 1, F.unix_date(da)
    x = a.withColumn("_span", F.explode(F.sequence(F.floor((at - days) / width), F.floor((at + days) / width))))
    y = b.withColumn("_span", F.floor(F.unix_date(db) / width))
    return x.join(y, ["_span", *(on or [])]).where(F.abs(F.datediff(da, db)) <= days).drop("_span")


def interpolate_at(points: DataFrame, at: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """Linear interpolation of (t, x) at the times of ``at``; beyond the ends the end values hold."""
    p = points.select(key, t, F.col(x).alias("_x")).where("_x is not null")
    both = p.withColumn("_side", F.lit(0)).unionByName(at.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w, back = Window.partitionBy(key).orderBy(t, "_side"), Window.partitionBy(key).orderBy(F.desc(t), F.desc("_side"))
    known = F.when(F.col("_side") == 0, F.struct(F.col(t).alias("t"), F.col("_x").alias("x")))
    both = both.withColumns({"_a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    a, b = F.col("_a"), F.col("_b")
    lerp = F.when(a.isNull(), b["x"]).when(b.isNull() | (b["t"] == a["t"]), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"]))
    return both.withColumn("interpolated", lerp).where("_side = 1").drop("_side", "_x", "_a", "_b")
