"""Bars from trades, and sequence functions over bars.

One shuffle by (entity, bar) builds the bars with partial aggregation, so a
market that holds a third of all trades is reduced before it moves; every
window after that is keyed by the entity and sorted by bar, which Spark
serves with a single exchange and sort for all functions of a chain.

Defined results: null prices count in neither ``n`` nor ``last``; equal
stamps are ordered by trade id; zero weight gives a null vwap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelight.operators import stats


def floor_to(t: Column, width: int) -> Column:
    """Start of the bar of ``width`` seconds that holds epoch second ``t``."""
    return t - F.pmod(t, F.lit(width))


def make_bars(df: DataFrame, keys: Sequence[str], width: int = 300, price: str = "price", weight: str = "size", lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """n, last, vwap and vol per (keys, bar); ``lo``/``hi`` bound the trades, half open."""
    if lo is not None:
        df = df.where(F.col("t") >= lo)
    if hi is not None:
        df = df.where(F.col("t") < hi)
    at, w = F.struct("t", "trade_id"), F.col(weight)
    known = F.col(price).isNotNull()
    return df.groupBy(*keys, floor_to(F.col("t"), width).alias("bar")).agg(
        F.count(price).alias("n"), F.max_by(F.col(price), F.when(known, at)).alias("last"),
        (F.sum(F.col(price) * w) / F.nullif(F.sum(F.when(known, w)), F.lit(0.0))).alias("vwap"), F.sum(F.when(known, w)).alias("vol"),
    )


def ofi_bars(df: DataFrame, keys: Sequence[str], width: int = 300, large: float | None = None, entity: str = "ticker") -> DataFrame:
    """Signed-volume bars: ofi, total, last, n, high, low, span; with ``large`` also the flow of trades at or over that quantile of the entity."""
    signed = F.when(F.col("taker_side") == "yes", F.col("size")).otherwise(-F.col("size"))
    extra = []
    if large is not None:
        cut = stats.percentiles(df, "size", [large], [entity], "_cut").select(entity, F.col("_cut")[0].alias("cut"))
        df = df.join(cut, entity)
        extra = [F.sum(F.when(F.col("size") >= F.col("cut"), signed).otherwise(0.0)).alias("ofi_large"), F.count_if(F.col("size") >= F.col("cut")).alias("n_large")]
    at = F.struct("t", "trade_id")
    return df.groupBy(*keys, floor_to(F.col("t"), width).alias("bar")).agg(
        F.sum(signed).alias("ofi"), F.sum("size").alias("total"), F.max_by("price", at).alias("last"), F.count("*").alias("n"),
        F.max("price").alias("high"), F.min("price").alias("low"), (F.max("price") - F.min("price")).alias("span"), *extra,
    )


def by(entity: str | Sequence[str], order: str = "bar") -> Window:
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(order)


def forward_returns(bars: DataFrame, entity: str = "ticker", x: str = "last", steps: int = 2) -> DataFrame:
    """dp_contemp and the incremental and cumulative leads 1 to ``steps`` between existing bars."""
    w = by(entity)
    lead = lambda k: F.lead(x, k).over(w) if k else F.col(x)
    cols = {"dp_contemp": F.col(x) - F.lag(x).over(w)} | {f"dp_{k}": lead(k) - lead(k - 1) for k in range(1, steps + 1)} | {f"cum_{k}": lead(k) - F.col(x) for k in range(2, steps + 1)}
    return bars.withColumns(cols)


def rolling_sum(bars: DataFrame, x: str, seconds: int, name: str, entity: str = "ticker") -> DataFrame:
    """Sum over the bars in (t - seconds, t]."""
    return bars.withColumn(name, F.sum(x).over(by(entity).rangeBetween(-(seconds - 1), 0)))


def zscore(df: DataFrame, x: str, name: str, entity: str = "ticker") -> DataFrame:
    """(x - mean) / sample deviation within the entity; null where it doesn't vary."""
    d = stats.joined_back(df, [entity], F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    return d.withColumn(name, (F.col(x) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def resample(bars: DataFrame, keys: Sequence[str], width: int, last: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Coarser bars: last non-null of ``last``, sum of ``sums``."""
    return bars.groupBy(*keys, floor_to(F.col("bar"), width).alias("coarse")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar"))).alias(c) for c in last], *[F.sum(c).alias(c) for c in sums]
    ).withColumnRenamed("coarse", "bar")


def bounded_fill(df: DataFrame, x: str, limit: int | None, entity: str = "fight") -> Column:
    """Last known ``x`` at most ``limit`` rows back on a dense grid; no limit carries it on without end."""
    w = by(entity)
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit if limit is not None else Window.unboundedPreceding, 0))


def backward_fill(x: str, entity: str = "fight") -> Column:
    """Next known ``x``: the last one from the far end backwards, a running value."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(entity).orderBy(F.desc("bar")).rowsBetween(Window.unboundedPreceding, 0))


def panel(k: DataFrame, p: DataFrame, width: int, limit: int = 12, entity: str = "fight", bounds: DataFrame | None = None) -> DataFrame:
    """Two-venue panel on the grid from an entity's first to its last bar, or on [lo, hi) of ``bounds`` (entity, lo, hi): values carried ``limit`` bars, stale flags, rows with any price, both_traded.

    Entities with one silent venue drop out.
    """
    ends = k.select(entity, "bar").unionByName(p.select(entity, "bar")).groupBy(entity).agg(F.min("bar").alias("lo"), F.max("bar").alias("hi"))
    both = k.select(entity).distinct().join(p.select(entity).distinct(), entity, "left_semi")
    if bounds is not None:
        ends = bounds.select(entity, "lo", (F.col("hi") - width).alias("hi")).where("hi >= lo")
    grid = ends.join(both, entity, "left_semi").select(entity, F.explode(F.sequence("lo", "hi", F.lit(width).cast("bigint"))).alias("bar"))
    side = lambda d, n: d.select(entity, "bar", *[F.col(c).alias(f"{n}_{c}") for c in ("last", "vwap", "vol", "n")])
    g = grid.join(side(k, "k"), [entity, "bar"], "left").join(side(p, "pm"), [entity, "bar"], "left")
    filled = {}
    for n in ("k", "pm"):
        f = bounded_fill(g, f"{n}_last", limit, entity)
        filled |= {f"{n}_fill": f, f"{n}_stale": F.col(f"{n}_last").isNull() & f.isNotNull()}
    g = g.withColumns(filled).where("k_fill is not null or pm_fill is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.select(
        entity, "bar", F.col("k_fill").alias("k_last"), "k_vwap", zero("k_vol").alias("k_vol"), zero("k_n").alias("k_n"), "k_stale",
        F.col("pm_fill").alias("pm_last"), "pm_vwap", zero("pm_vol").alias("pm_vol"), zero("pm_n").alias("pm_n"), "pm_stale", ((zero("k_n") > 0) & (zero("pm_n") > 0)).alias("both_traded"),
    )
