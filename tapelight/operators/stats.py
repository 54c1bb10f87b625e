"""Inference over bars and panels: quantile sorts, clustered regressions, spreads, resampling.

All estimators are sums over rows that Spark aggregates in parts; only
results of a few rows are combined further. Random draws are hashes of
(replication, slot, seed), so they need no driver state and repeat anywhere.

Defined results: rows with null in a used column are left out; groups that
are too small or don't vary give null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelight.session import written


def joined_back(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """``df`` with aggregates of its groups on every row: partial sums and a join, so no group is gathered in a task as a window would."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    of = df.groupBy(*keys).agg(*aggs).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(of, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def percentiles(df: DataFrame, x: str, at: Sequence[float], keys: Sequence[str] = (), name: str = "p") -> DataFrame:
    """(keys, ``name`` array<double>): exact interpolated percentiles of ``x`` per group, spread over all tasks.

    Equal values are counted first, then written in ranges of (keys, value); the counts of the ranges tell which of them hold the wanted
    ranks, and only there rows are numbered. So neither a hot group nor a hot value is ever in one task. Nulls are left out.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    counts = written(counts.repartitionByRange(*keys, "_x"), "ranges").withColumn("_file", F.col("_metadata.file_path"))
    ranges = counts.groupBy("_file", *keys).agg(F.sum("_n").alias("_rows"), F.min("_x").alias("_lo"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))  # one row per range
    ranges = ranges.withColumns({"_all": F.sum("_rows").over(w), "_base": F.coalesce(F.sum("_rows").over(w.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    places = [((F.col("_all") - 1) * q) for q in at]
    inside = functools.reduce(lambda a, b: a | b, [(r(p) >= F.col("_base")) & (r(p) < F.col("_base") + F.col("_rows")) for p in places for r in (F.floor, F.ceil)])
    on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in ("_file", *keys)])
    chosen = ranges.where(inside).select(*[F.col(c).alias(f"_r{c}") for c in ("_file", *keys)], "_all", "_base")
    rows = counts.join(chosen, on).drop(*[f"_r{c}" for c in ("_file", *keys)])
    rows = rows.withColumn("_upto", F.col("_base") + F.sum("_n").over(Window.partitionBy("_file", *keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_x")))
    picked = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), *[of(r(p)).alias(f"_{i}{n}") for i, p in enumerate(places) for n, r in (("a", F.floor), ("b", F.ceil))])
    one = lambda i, p: F.col(f"_{i}a") + (F.col(f"_{i}b") - F.col(f"_{i}a")) * (p - F.floor(p))
    return picked.select(*keys, F.array(*[one(i, p) for i, p in enumerate(places)]).alias(name))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows in ``order`` (make it unique): ranges are written and counted, then numbered each on its own."""
    rows = written(df.repartitionByRange(*order), "ranges").withColumn("_file", F.col("_metadata.file_path"))
    first = F.row_number().over(Window.partitionBy("_file").orderBy(*order))
    rows = rows.withColumn("_k", first)
    heads = rows.where("_k = 1").join(rows.groupBy(F.col("_file").alias("_f")).agg(F.count("*").alias("_rows")), F.col("_f") == F.col("_file"))
    # one row per range
    base = heads.select("_f", F.coalesce(F.sum("_rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(base, F.col("_f") == F.col("_file")).withColumn(name, (F.col("_base") + F.col("_k")).cast("bigint")).drop("_f", "_file", "_k", "_base")


def quantile_bins(df: DataFrame, x: str, bins: int = 5, name: str = "q") -> DataFrame:
    """Bins with right-closed edges at exact interpolated percentiles, ties together; the edges are one row."""
    d = df.crossJoin(F.broadcast(percentiles(df, x, [k / bins for k in range(1, bins)], name="_e")))  # one row of bins-1 numbers
    bin_ = F.lit(1) + sum((F.when(F.col(x) > F.col("_e")[k], 1).otherwise(0) for k in range(bins - 1)), F.lit(0))
    return d.withColumn(name, F.when(F.col(x).isNotNull(), bin_)).drop("_e")


def quintile_table(df: DataFrame, x: str, y: str) -> DataFrame:
    d = quantile_bins(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x)
    return d.groupBy("q").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def group_spread(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Mean of y in the top minus the bottom quintile, per group, then mean, standard error and t over groups."""
    d = quantile_bins(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x)
    per = d.groupBy(group).agg((F.avg(F.when(F.col("q") == 5, F.col(y))) - F.avg(F.when(F.col("q") == 1, F.col(y)))).alias("s")).where("s is not null")
    se = F.stddev_samp("s") / F.sqrt(F.count("s"))
    return per.agg(F.count("s").alias("groups"), F.avg("s").alias("spread"), se.alias("se"), (F.avg("s") / F.nullif(se, F.lit(0.0))).alias("t"))


def fe_ols(df: DataFrame, x: str, y: str, entity: str, cluster: str) -> DataFrame:
    """One-regressor fixed-effects OLS with cluster-robust errors and the factor G/(G-1)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = joined_back(d.select(entity, F.col(cluster).alias("_c"), F.col(x).alias("_x"), F.col(y).alias("_y")), [entity], F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    d = d.select(F.col("_c").alias(cluster), (F.col("_x") - F.col("_mx")).alias("xd"), (F.col("_y") - F.col("_my")).alias("yd"))
    g = d.groupBy(cluster).agg(F.sum(F.col("xd") * F.col("yd")).alias("xy"), F.sum(F.col("xd") * F.col("xd")).alias("xx"), F.count("*").alias("n"))
    # with one regressor a cluster's score is xy - b*xx, so the clusters' sums say all
    tot = g.agg(F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("xy") * F.col("xy")).alias("a"), F.sum(F.col("xy") * F.col("xx")).alias("b"), F.sum(F.col("xx") * F.col("xx")).alias("c"))
    beta = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    meat = F.greatest(F.lit(0.0), F.col("a") - 2 * F.col("beta") * F.col("b") + F.col("beta") * F.col("beta") * F.col("c"))
    tot = tot.withColumn("beta", beta).withColumn("se", F.sqrt(meat * F.col("g") / F.nullif(F.col("g") - 1, F.lit(0))) / F.col("sxx"))
    return tot.select("n", F.col("g").alias("clusters"), "beta", "se", (F.col("beta") / F.nullif(F.col("se"), F.lit(0.0))).alias("t"))


def pooled_ols(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """OLS with intercept, errors clustered with G/(G-1) * n/(n-2)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cluster, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = d.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    d = d.crossJoin(F.broadcast(m)).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    g = d.groupBy(cluster, "n", "mx", "my").agg(F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("u") * F.col("u")).alias("uu"))
    tot = g.groupBy("n", "mx", "my").agg(F.sum("uv").alias("suv"), F.sum("uu").alias("suu"), F.count("*").alias("g"), F.sum(F.col("uv") * F.col("uv")).alias("a"), F.sum(F.col("uv") * F.col("uu")).alias("b"), F.sum(F.col("uu") * F.col("uu")).alias("c"))
    tot = tot.withColumn("beta", F.col("suv") / F.nullif(F.col("suu"), F.lit(0.0)))
    meat = F.greatest(F.lit(0.0), F.col("a") - 2 * F.col("beta") * F.col("b") + F.col("beta") * F.col("beta") * F.col("c"))
    factor = F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * F.col("n") / F.nullif(F.col("n") - 2, F.lit(0))
    return tot.select("n", F.col("g").alias("clusters"), "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("intercept"), (F.sqrt(meat * factor) / F.col("suu")).alias("se"))


def hc3(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """OLS with intercept and HC3 errors per group: leverage 1/n + (x - mean)^2 / Sxx."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = joined_back(d.select(*groups, F.col(x).alias("_x"), F.col(y).alias("_y")), groups, F.count("*").alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    d = d.select(*groups, "_n", (F.col("_x") - F.col("_mx")).alias("_u"), (F.col("_y") - F.col("_my")).alias("_v"))
    d = joined_back(d, groups, F.sum(F.col("_u") * F.col("_u")).alias("_s"), F.sum(F.col("_u") * F.col("_v")).alias("_uv")).withColumn("_b", F.col("_uv") / F.nullif("_s", F.lit(0.0)))
    e = (F.col("_v") - F.col("_b") * F.col("_u")) / (1 - 1 / F.col("_n") - F.col("_u") * F.col("_u") / F.col("_s"))
    return d.groupBy(*groups).agg(F.max("_n").alias("n"), F.max("_b").alias("beta"), (F.sqrt(F.sum(e * e * F.col("_u") * F.col("_u"))) / F.max("_s")).alias("se"))


def clustered_or_hc3(df: DataFrame, x: str, y: str, groups: Sequence[str], cluster: str, least: int = 5) -> DataFrame:
    """(groups, n, clusters, errors, beta, se): OLS with intercept per group; clustered errors with G/(G-1) * n/(n-2) from ``least`` clusters on, else HC3."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = joined_back(d.select(*groups, F.col(cluster).alias("_c"), F.col(x).alias("_x"), F.col(y).alias("_y")), groups, F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    u, v = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    d = joined_back(d.select(*groups, "_c", "n", u.alias("_u"), v.alias("_v")), groups, F.sum(F.col("_u") * F.col("_u")).alias("_s"), F.sum(F.col("_u") * F.col("_v")).alias("_uv"))
    d = d.withColumn("beta", F.col("_uv") / F.nullif("_s", F.lit(0.0)))
    e = F.col("_v") - F.col("beta") * F.col("_u")
    lev = F.pow(e / F.nullif(1 - 1 / F.col("n") - F.col("_u") * F.col("_u") / F.nullif("_s", F.lit(0.0)), F.lit(0.0)), 2) * F.col("_u") * F.col("_u")
    c = d.groupBy(*groups, "_c").agg(F.max("n").alias("n"), F.max("_s").alias("_s"), F.max("beta").alias("beta"), F.sum(F.col("_u") * e).alias("_sc"), F.sum(lev).alias("_h"))
    g = c.groupBy(*groups).agg(F.max("n").alias("n"), F.count("*").alias("clusters"), F.max("_s").alias("_s"), F.max("beta").alias("beta"), F.sum(F.col("_sc") * F.col("_sc")).alias("_m"), F.sum("_h").alias("_h"))
    k, many = F.col("clusters"), F.col("clusters") >= least
    meat = F.when(many, F.col("_m") * k / (k - 1) * F.col("n") / F.nullif(F.col("n") - 2, F.lit(0))).otherwise(F.col("_h"))
    return g.select(*groups, "n", "clusters", F.when(many, "cluster").otherwise("HC3").alias("errors"), "beta", (F.sqrt(meat) / F.nullif("_s", F.lit(0.0))).alias("se"))


def ols(df: DataFrame, xs: Sequence[str], y: str) -> dict[str, np.ndarray]:
    """Many regressors with HC3 errors: the moment matrix is aggregated by Spark, (k+1)^2 numbers reach the driver; a second pass sums the leverages."""
    cols = ["_1", *xs]
    d = df.dropna(subset=[*xs, y]).withColumn("_1", F.lit(1.0))
    row = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)], *[F.sum(F.col(a) * F.col(y)).alias(f"y_{i}") for i, a in enumerate(cols)]).first()
    k = len(cols)
    a = np.array([[row[f"{i}_{j}"] for j in range(k)] for i in range(k)], dtype=float)
    inv = np.linalg.pinv(a)
    beta = inv @ np.array([row[f"y_{i}"] for i in range(k)], dtype=float)
    fit = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
    lev = sum((F.col(p) * F.col(q) * float(inv[i, j]) for i, p in enumerate(cols) for j, q in enumerate(cols)), F.lit(0.0))
    e2 = F.pow((F.col(y) - fit) / (1 - lev), 2)
    m = d.agg(*[F.sum(F.col(p) * F.col(q) * e2).alias(f"{i}_{j}") for i, p in enumerate(cols) for j, q in enumerate(cols)]).first()
    meat = np.array([[m[f"{i}_{j}"] for j in range(k)] for i in range(k)], dtype=float)
    return {"beta": beta, "se": np.sqrt(np.diag(inv @ meat @ inv))}


def roll_spread(bars: DataFrame, x: str = "last", entity: str = "ticker", least: int = 6) -> DataFrame:
    """Effective spread per entity: 2*sqrt(max(0, -cov(dp, previous dp)))."""
    w = Window.partitionBy(entity).orderBy("bar")
    d = bars.withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_l", F.lag("_d").over(w)).where("_d is not null and _l is not null")
    d = d.groupBy(entity).agg(F.count("*").alias("n"), F.covar_samp("_d", "_l").alias("cov")).where(F.col("n") >= least)
    return d.select(entity, "n", "cov", (2 * F.sqrt(F.greatest(F.lit(0.0), -F.col("cov")))).alias("spread"))


def unit_hash(*parts: Column) -> Column:
    """A draw in [0, 2^32): the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def resampled(per_cluster: DataFrame, value: str, weight: str, order: str, groups: Sequence[str] = (), reps: int = 200, seed: int = 42, median: bool = False) -> DataFrame:
    """(groups, rep, s): sum(value)/sum(weight), or the median of value, over a group's clusters drawn with replacement.

    A replication draws positions by hash; draws join clusters by position, so the work is reps x clusters rows, spread over all tasks.
    Clusters with null values are drawn too and add nothing.
    """
    # clusters are few against rows; positions come from their order
    w = Window.partitionBy(*(groups or [F.lit(1)]))
    at = per_cluster.select(*groups, F.col(value).alias("_v"), F.col(weight).alias("_w"), (F.row_number().over(w.orderBy(order)) - 1).cast("bigint").alias("pos"), F.count("*").over(w).alias("_n"))
    draws = at.select(*groups, "_n", "pos", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(*groups, "rep", (unit_hash(F.col("rep"), F.col("pos"), F.lit(seed)) % F.col("_n")).alias("pos"))
    what = F.percentile("_v", F.lit(0.5)) if median else F.sum("_v") / F.nullif(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).cast("double"), F.lit(0.0))
    return draws.join(at, [*groups, "pos"]).groupBy(*groups, "rep").agg(what.alias("s"))


def interval(draws: DataFrame, groups: Sequence[str] = (), s: str = "s") -> DataFrame:
    """(groups, lo, hi): the 95 % percentile interval of replications."""
    return draws.groupBy(*groups).agg(F.percentile(s, F.lit(0.025)).alias("lo"), F.percentile(s, F.lit(0.975)).alias("hi"))


def hash_bootstrap(per_cluster: DataFrame, value: str, weight: str, order: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """(point, n, lo, hi) of sum(value)/sum(weight) over clusters; no row where there is none."""
    ci = interval(resampled(per_cluster, value, weight, order, reps=reps, seed=seed))
    point = per_cluster.agg((F.sum(value) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("point"), F.count("*").alias("n")).where("n > 0")
    return point.crossJoin(F.broadcast(ci))


def two_stage_boot(stats: pd.DataFrame, agg: Callable[[pd.DataFrame], float], reps: int = 1000, rng: np.random.Generator | int = 42) -> tuple[float, float]:
    """Percentile interval of a callback over resampled per-cluster rows (few, already aggregated)."""
    r = np.random.default_rng(rng) if isinstance(rng, int) else rng
    draws = [agg(stats.iloc[r.integers(0, len(stats), len(stats))]) for _ in range(reps)] if len(stats) else []
    good = [d for d in draws if d == d]
    return (float(np.percentile(good, 2.5)), float(np.percentile(good, 97.5))) if good else (math.nan, math.nan)


def permutation(df: DataFrame, x: str, y: str, entity: str, order: str, reps: int = 20, seed: int = 7) -> DataFrame:
    """Null distribution of the pooled slope: y is shuffled within its entity by hash order, per replication."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(entity, order, F.col(x).alias("x"), F.col(y).alias("y"))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy(entity).orderBy(order)))
    r = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("h", F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(order).cast("string"), F.lit(str(seed)))))
    shuffled = r.select("rep", entity, F.row_number().over(Window.partitionBy("rep", entity).orderBy("h")).alias("pos"), "y")
    both = r.select("rep", entity, "pos", "x").join(shuffled, ["rep", entity, "pos"])
    return both.groupBy("rep").agg((F.covar_samp("x", "y") / F.nullif(F.var_samp("x"), F.lit(0.0))).alias("slope"))


def permutation_p(df: DataFrame, x: str, y: str, entity: str, order: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """The pooled slope and its two-sided permutation p-value, (1 + replications at least as far from 0) / (1 + replications)."""
    seen = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg((F.covar_samp(x, y) / F.nullif(F.var_samp(x), F.lit(0.0))).alias("observed"))
    null = permutation(df, x, y, entity, order, reps, seed).crossJoin(F.broadcast(seen))  # one row
    return null.agg(F.count("slope").alias("reps"), F.max("observed").alias("slope"), ((1 + F.count_if(F.abs("slope") >= F.abs("observed") - 1e-12)) / (1 + F.count("slope"))).alias("p"))


@F.pandas_udf(T.DoubleType())
def _two_sided(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in batches:
        yield t.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v and v is not None else None).astype("float64")


def p_normal(t: Column) -> Column:
    """Two-sided normal p-value."""
    return _two_sided(t)


def two_proportions(a: Column, n: Column, b: Column, m: Column) -> Column:
    """z of the difference of two proportions, pooled error."""
    p = (a + b) / (n + m)
    return (a / n - b / m) / F.nullif(F.sqrt(p * (1 - p) * (1 / n + 1 / m)), F.lit(0.0))


def fisher_z(r: Column, clip: float = 0.9999) -> Column:
    return F.atanh(F.greatest(F.lit(-clip), F.least(F.lit(clip), r)))


def round_trip_fee(price: Column, rate: float = 0.07) -> Column:
    """Quadratic fee of a contract, both ways."""
    return 2 * rate * price * (1 - price)


def monotone(values: Column) -> Column:
    """rising, falling or mixed over an array."""
    rising = F.forall(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.get(values, i) >= F.get(values, i - 1))
    falling = F.forall(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.get(values, i) <= F.get(values, i - 1))
    return F.when(rising, "rising").when(falling, "falling").otherwise("mixed")
