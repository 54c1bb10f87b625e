"""Strike ladders -> arbitrage-free distributions -> moments.

A contract's prices on a date form a ladder over strikes. All steps are
grouped aggregates and windows over (contract, date); only the closing of gaps
towards the median iterates, per ladder, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("contract", "date")


def daily(trades: DataFrame) -> DataFrame:
    """Last price, vwap and volume per (contract, date, strike)."""
    return trades.groupBy(*KEY, "strike").agg(F.max_by("price", "ord").alias("last"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.sum("size").alias("volume"))


def densify(d: DataFrame, x: str = "last") -> DataFrame:
    """Every strike of a contract on every month from its first to its last, prices carried on, leading gaps left out; with the contract's expiry (its last date)."""
    span = d.groupBy("contract").agg(F.min("date").alias("lo"), F.max("date").alias("expiry"))
    grid = d.select("contract", "strike").distinct().join(span, "contract").select("contract", "strike", "expiry", F.explode(F.sequence("lo", "expiry", F.expr("interval 1 month"))).alias("date"))
    g = grid.join(d.select(*KEY, "strike", x, "volume"), [*KEY, "strike"], "left")
    w = Window.partitionBy("contract", "strike").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumns({"price": F.last(x, ignorenulls=True).over(w), "volume": F.coalesce("volume", F.lit(0.0))}).where("price is not null").select(*KEY, "strike", "price", "volume", "expiry")


def monotone(g: DataFrame, x: str = "price", centre: float = 49.0) -> DataFrame:
    """Three repairs of a ladder that must fall with the strike: running minimum from the left, running maximum from the right, and from the middle out."""
    w = Window.partitionBy(*KEY).orderBy("strike")
    left = F.min(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # from the far end backwards: a running value, where a frame to the end would be summed up again for every row
    right = F.max(x).over(Window.partitionBy(*KEY).orderBy(F.desc("strike")).rowsBetween(Window.unboundedPreceding, 0))
    mid = F.min(F.struct(F.abs(F.col(x) - centre), F.col("strike"))).over(Window.partitionBy(*KEY))["strike"]
    g = g.withColumns({"ltr": left, "rtl": right, "mid": mid})
    half = Window.partitionBy(*KEY, (F.col("strike") <= F.col("mid")))
    up, down = half.orderBy("strike"), half.orderBy(F.desc("strike"))
    inner = F.when(F.col("strike") <= F.col("mid"), F.max(x).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.max(F.when(F.col("strike") == F.col("mid"), F.col(x))).over(Window.partitionBy(*KEY))
    outer = F.least(at, F.min(x).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return g.withColumn("middle", F.coalesce(inner, outer)).drop("mid")


def bins(g: DataFrame, x: str = "middle", top: float = 99.0, bottom: float = 1.0, step: float = 1.0) -> DataFrame:
    """(key, strike, price, mass): the masses between neighbouring strikes.

    A bin ``step`` below the lowest strike takes ``top`` minus the lowest price, each strike its price minus the next strike's, the highest
    its price minus ``bottom``. Missing strikes have mass 0; they and the low bin carry the price of the next strike up, as do prices of 0.
    Of strikes that round to one step the lowest stands.
    """
    w = Window.partitionBy(*KEY).orderBy("strike")
    low = g.groupBy(*KEY).agg((F.min("strike") - step).alias("strike"), F.lit(None).cast("double").alias("p"))
    d = g.select(*KEY, "strike", F.col(x).cast("double").alias("p")).unionByName(low)
    after = F.lead("p").over(w)
    mass = F.when(F.lag("strike").over(w).isNull(), top - after).when(F.lead("strike").over(w).isNotNull(), F.col("p") - after).otherwise(F.col("p") - bottom)
    k = F.round((F.col("strike") - F.min("strike").over(Window.partitionBy(*KEY))) / step).cast("int")
    d = d.withColumns({"mass": mass, "k": k, "lo": F.min("strike").over(Window.partitionBy(*KEY))})
    d = d.groupBy(*KEY, "lo", "k").agg(F.min_by("p", "strike").alias("p"), F.min_by("mass", "strike").alias("mass"))
    along, down = Window.partitionBy(*KEY).orderBy("k"), Window.partitionBy(*KEY).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"next": F.lead("k").over(along), "up": F.last(F.nullif("p", F.lit(0.0)), ignorenulls=True).over(down)}).withColumn("above", F.lead("up").over(along))
    d = d.withColumn("at", F.explode(F.sequence("k", F.coalesce(F.col("next") - 1, F.col("k")))))
    own = F.col("at") == F.col("k")
    return d.select(*KEY, (F.col("lo") + F.col("at") * step).alias("strike"), F.when(own, F.col("up")).otherwise(F.col("above")).alias("price"), F.when(own, F.coalesce("mass", F.lit(0.0))).otherwise(0.0).alias("mass"))


def normalised(b: DataFrame) -> DataFrame:
    """Probabilities of a ladder's masses, 100 in sum."""
    return b.select(*KEY, "strike", (F.col("mass") * 100 / F.nullif(F.sum("mass").over(Window.partitionBy(*KEY)), F.lit(0.0))).alias("probability"))


def pmf(g: DataFrame, x: str = "middle", top: float = 99.0, step: float = 1.0) -> DataFrame:
    """Probabilities by differencing, see bins()."""
    return normalised(bins(g, x, top, step=step))


def moments(p: DataFrame) -> DataFrame:
    """Weighted mean, median (first strike at half the mass), mode (first of ties), variance, Groeneveld-Meeden skewness and excess kurtosis per ladder."""
    w = Window.partitionBy(*KEY)
    x, q = F.col("strike"), F.col("probability")
    p = p.withColumns({"_t": F.sum(q).over(w), "_mu": F.sum(x * q).over(w) / F.sum(q).over(w), "_cum": F.sum(q).over(w.orderBy("strike"))})
    p = p.withColumn("_med", F.min(F.when(F.col("_cum") >= 0.5 * F.col("_t") - 1e-9, x)).over(w))
    dev = x - F.col("_mu")
    g = p.groupBy(*KEY).agg(
        F.max("_mu").alias("mean"), F.max("_med").alias("median"), F.max_by("strike", F.struct(F.round("probability", 9), -x)).alias("mode"),
        (F.sum(q * dev * dev) / F.max("_t")).alias("variance"), (F.sum(q * F.abs(x - F.col("_med"))) / F.max("_t")).alias("_mad"), (F.sum(q * F.pow(dev, 4)) / F.max("_t")).alias("_m4"),
    )
    zero = F.lit(0.0)
    return g.select(*KEY, "mean", "median", "mode", "variance", ((F.col("mean") - F.col("median")) / F.nullif("_mad", zero)).alias("skewness"), (F.col("_m4") / F.nullif(F.col("variance") * F.col("variance"), zero) - 3).alias("kurtosis"))


def pushed(price: list[float], mass: list[float], centre: float = 49.0) -> list[float]:
    """Masses of one ladder after gaps are closed towards its median: over ``centre`` a mass moves up into an empty bin, under it down, until none moves.

    The median's bin (the last over ``centre``; without one, the first of the highest price) stays where it is. Ladders of three bins or fewer stay.
    """
    m, n = list(mass), len(mass)
    if n < 4:
        return m
    known = [p if p is not None and p == p else None for p in price]
    over = [i for i, p in enumerate(known) if p is not None and p > centre]
    kept = over[-1] if over else max((i for i in range(n) if known[i] is not None), key=lambda i: (known[i], -i), default=-1)
    moved = True
    while moved:  # a mass only ever comes nearer to the median, so this ends
        moved = False
        for i in range(n - 1):
            p = known[i]
            if p is None or i == kept:
                continue
            if p > centre and m[i] != 0 and m[i + 1] == 0:
                m[i], m[i + 1], moved = 0.0, m[i], True
            elif p < centre and m[i] == 0 and m[i + 1] != 0 and i + 1 != kept:
                m[i], m[i + 1], moved = m[i + 1], 0.0, True
    return m


def swapped(b: DataFrame) -> DataFrame:
    """bins() with gaps closed towards the median; a ladder has as many rows as strikes, so an array each, in Arrow batches."""
    rows = b.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("strike", "price", "mass"))).alias("r"))
    push = F.pandas_udf(lambda p, m: pd.Series([pushed(list(x), list(y)) for x, y in zip(p, m)]), "array<double>")
    rows = rows.withColumn("m", push(F.col("r.price"), F.col("r.mass")))
    return rows.select(*KEY, F.explode(F.arrays_zip("r", "m")).alias("x")).select(*KEY, "x.r.strike", "x.r.price", F.col("x.m").alias("mass"))


def last_good(q: DataFrame, entity: str, order: str, bid: str = "bid", ask: str = "ask", widest: float = 10.0) -> DataFrame:
    """Midpoint of quotes; a spread over ``widest`` takes the last good quotes, if there were any."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wide = (F.col(ask) - F.col(bid)) > widest
    fill = lambda c: F.when(wide, F.coalesce(F.last(F.when(~wide, F.col(c)), ignorenulls=True).over(w), F.col(c))).otherwise(F.col(c))
    return q.withColumns({"good_bid": fill(bid), "good_ask": fill(ask)}).withColumn("mid", (F.col("good_bid") + F.col("good_ask")) / 2)


def exclusive_bins(g: DataFrame, x: str = "price") -> DataFrame:
    """Prices of mutually exclusive bins normalised to 100 per ladder, gaps filled within contract and strike."""
    s = F.sum(x).over(Window.partitionBy(*KEY))
    return g.withColumn("probability", F.col(x) * 100 / F.nullif(s, F.lit(0.0)))
