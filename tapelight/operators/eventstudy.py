"""Event-study operators on two-venue panels: cross-correlation, co-jumps, propagation, gap episodes.

All are windows keyed by the entity and ordered by bar (one exchange, one
sort) followed by grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelight.operators import stats
from tapelight.operators.bars import by


def returns(panel: DataFrame, entity: str = "fight") -> DataFrame:
    """Co-active rows with both venues' differences dk and dp between neighbours."""
    w = by(entity)
    d = panel.where("both_traded")
    return d.withColumns({"dk": F.col("k_last") - F.lag("k_last").over(w), "dp": F.col("pm_last") - F.lag("pm_last").over(w)})


def ccf(d: DataFrame, lags: Sequence[int], entity: str = "fight", least: int = 15, reps: int = 0) -> DataFrame:
    """Correlation of dk(t) with dp(t+lag) per entity and lag, then Fisher-z mean over entities; with ``reps`` its interval over drawn entities."""
    w = by(entity)
    d = d.where("dk is not null and dp is not null")
    for lag in lags:
        d = d.withColumn(f"_{lag}", F.lead("dp", lag).over(w) if lag >= 0 else F.lag("dp", -lag).over(w))
    long = d.select(entity, "dk", F.explode(F.array(*[F.struct(F.lit(g).alias("lag"), F.col(f"_{g}").alias("v")) for g in lags])).alias("e")).select(entity, "dk", "e.lag", "e.v").where("v is not null")
    each = long.groupBy(entity, "lag").agg(F.count("*").alias("n"), F.corr("dk", "v").alias("rho"), F.stddev_samp("dk").alias("s1"), F.stddev_samp("v").alias("s2"))
    each = each.where((F.col("n") >= least) & (F.col("s1") >= 1e-12) & (F.col("s2") >= 1e-12)).select(entity, "lag", stats.fisher_z(F.col("rho")).alias("z"))
    point = each.groupBy("lag").agg(F.count("*").alias("entities"), F.tanh(F.avg("z")).alias("rho"))
    if not reps:
        return point
    ci = stats.interval(stats.resampled(each.withColumn("one", F.lit(1)), "z", "one", entity, ["lag"], reps), ["lag"])
    return point.join(ci, "lag").withColumns({c: F.tanh(c) for c in ("lo", "hi")})


def three_buckets(d: DataFrame, thresholds: Sequence[float], era: str = "era") -> DataFrame:
    """Direction of the other venue's move when one jumps: same, zero, opposite; per direction, threshold and era, and pooled (null era)."""
    d = d.where("dk is not null and dp is not null")
    both = F.array(F.struct(F.lit("K->P").alias("dir"), F.col("dk").alias("a"), F.col("dp").alias("b")), F.struct(F.lit("P->K").alias("dir"), F.col("dp").alias("a"), F.col("dk").alias("b")))
    long = d.select(era, F.explode(both).alias("m")).select(era, "m.*").withColumn("thr", F.explode(F.array(*map(F.lit, thresholds)))).where(F.abs("a") >= F.col("thr"))
    s = F.signum("a") * F.col("b")
    long = long.select("dir", "thr", F.explode(F.array(F.col(era).cast("string"), F.lit("all"))).alias(era), s.alias("s"))
    return long.groupBy("dir", "thr", era).agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0).alias("same_n"), F.count_if(F.col("s") == 0).alias("zero_n"), F.count_if(F.col("s") < 0).alias("opp_n"))


def cojumps(d: DataFrame, threshold: float) -> DataFrame:
    """Where either venue jumps: how often both do, and how aligned they are."""
    d = d.where("dk is not null and dp is not null")
    jk, jp = F.abs("dk") >= threshold, F.abs("dp") >= threshold
    aligned = F.signum("dk") * F.signum("dp")
    return d.agg(F.count_if(jk | jp).alias("either"), F.count_if(jk & jp).alias("both"), F.avg(F.when(jk & jp, aligned)).alias("mean_aligned"), F.percentile(F.when(jk, F.abs("dp")), F.lit(0.5)).alias("median_response"), F.avg(F.abs("dp")).alias("baseline"))


def moves(d: DataFrame, threshold: float, horizons: Sequence[int], hold_bars: int, hold: float = 0.5, entity: str = "fight", lead: str = "k") -> DataFrame:
    """(entity, bar, kind, horizon, response): a row per jump of the leading venue and horizon.

    A jump is persistent if at least ``hold`` of it is left after ``hold_bars`` bars, else transient; without that many bars it is none. The
    response is the other venue's signed move: in the same bar for horizon 0, else summed over the next ``horizon`` bars, null where
    these are not all there or fewer than half of them are known.
    """
    w = by(entity)
    a, b, price = ("dk", "dp", "k_last") if lead == "k" else ("dp", "dk", "pm_last")
    d = d.withColumns({"_before": F.lag(price).over(w), "_after": F.lead(price, hold_bars).over(w)})
    for h in horizons:
        if h:
            ahead = w.rowsBetween(1, h)
            d = d.withColumn(f"_h{h}", F.when((F.count("*").over(ahead) == h) & (F.count(b).over(ahead) >= max(1, h // 2)), F.sum(b).over(ahead)))
    jumps = d.where((F.abs(a) >= threshold) & F.col("_before").isNotNull() & F.col("_after").isNotNull())
    kept = F.signum(a) * (F.col("_after") - F.col("_before")) >= hold * F.abs(a)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.signum(a) * F.col(f"_h{h}" if h else b)).alias("response")) for h in horizons])
    return jumps.select(entity, "bar", F.when(kept, "persistent").otherwise("transient").alias("kind"), F.explode(each).alias("e")).select(entity, "bar", "kind", "e.*")


def propagation(d: DataFrame, threshold: float, horizon: int, hold: float = 0.5, entity: str = "fight") -> DataFrame:
    """Jumps of K that persist or fade over the horizon, and P's cumulative response."""
    m = moves(d, threshold, [horizon], horizon, hold, entity).where("response is not null")
    return m.groupBy("kind").agg(F.count("*").alias("n"), F.avg("response").alias("response"), F.avg((F.col("response") > 0).cast("int")).alias("share_same"))


def contrast(d: DataFrame, threshold: float, horizons: Sequence[int], hold_bars: int, entity: str = "fight", reps: int = 200, seed: int = 42) -> DataFrame:
    """(horizon, entities, diff, lo, hi): response to persistent minus to transient jumps, paired by entity.

    Entities with both kinds give a difference each; the interval draws entities, those without a difference too.
    """
    m = moves(d, threshold, horizons, hold_bars, entity=entity).groupBy(entity, "horizon").agg(
        (F.avg(F.when(F.col("kind") == "persistent", F.col("response"))) - F.avg(F.when(F.col("kind") == "transient", F.col("response")))).alias("diff")
    )
    all_of = d.select(entity).distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    per = all_of.join(m, [entity, "horizon"], "left").withColumn("one", F.lit(1))
    point = per.groupBy("horizon").agg(F.count("diff").alias("entities"), F.avg("diff").alias("diff"))
    return point.join(stats.interval(stats.resampled(per, "diff", "one", entity, ["horizon"], reps, seed), ["horizon"]), "horizon")


def bucket_difference(d: DataFrame, thresholds: Sequence[float], entity: str = "fight", reps: int = 200, seed: int = 42) -> DataFrame:
    """(thr, diff, lo, hi): same-direction share of K's jumps minus that of P's, in points; the interval draws both sides' entities on their own."""
    d = d.where("dk is not null and dp is not null")
    both = F.array(F.struct(F.lit(1).alias("side"), F.col("dk").alias("a"), F.col("dp").alias("b")), F.struct(F.lit(-1).alias("side"), F.col("dp").alias("a"), F.col("dk").alias("b")))
    long = d.select(entity, F.explode(both).alias("m")).select(entity, "m.*").withColumn("thr", F.explode(F.array(*map(F.lit, thresholds)))).where(F.abs("a") >= F.col("thr"))
    per = long.groupBy(entity, "side", "thr").agg(F.count("*").alias("n"), F.count_if(F.signum("a") * F.col("b") > 0).alias("same")).withColumns({"rate": F.col("same") / F.col("n"), "one": F.lit(1)})
    sign = lambda c: F.sum(F.col("side") * c) * 100
    point = per.groupBy("thr", "side").agg((F.sum("same") / F.sum("n")).alias("p")).groupBy("thr").agg(sign(F.col("p")).alias("diff"))
    draws = [stats.resampled(per.where(F.col("side") == s), "rate", "one", entity, ["thr"], reps, seed + k).withColumn("side", F.lit(s)) for k, s in enumerate((1, -1))]
    rep = draws[0].unionByName(draws[1]).groupBy("thr", "rep").agg(sign(F.col("s")).alias("s"))
    return point.join(stats.interval(rep, ["thr"]), "thr")


def gap_episodes(panel: DataFrame, opens: float = 0.05, closes: float = 0.02, entity: str = "fight") -> DataFrame:
    """Episodes of |k - p| with hysteresis: open at ``opens`` from below, closed at ``closes``; censored if never closed.

    Gaps and islands: rows at or under ``closes`` end a segment; the first
    opening row of a segment starts its episode.
    """
    w = by(entity)
    g = panel.where("k_last is not null and pm_last is not null").withColumn("gap", F.round(F.abs(F.col("k_last") - F.col("pm_last")), 9))
    g = g.withColumns({"_c": (F.col("gap") <= closes).cast("int"), "_o": (F.col("gap") >= opens) & (F.lag("gap").over(w).isNull() | (F.lag("gap").over(w) < opens))})
    g = g.withColumn("_seg", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min(F.when(F.col("_o"), F.col("bar"))).over(Window.partitionBy(entity, "_seg"))
    g = g.withColumn("start", first).where("bar >= start")
    e = g.groupBy(entity, "_seg", "start").agg(F.max(F.when(F.col("_c") == 1, F.col("bar"))).alias("stop"), F.max("k_n").alias("_k"), F.max("pm_n").alias("_p"), F.max("gap").alias("widest"))
    return e.select(entity, "start", F.col("stop").alias("end"), ((F.col("stop") - F.col("start")) / 60).alias("duration_min"), F.col("stop").isNull().alias("censored"), F.when((F.col("_k") > 0) & (F.col("_p") > 0), "ACTIVE").otherwise("STALE-SIDE").alias("kind"), "widest")


def side_audit(panel: DataFrame, entity: str = "fight", least: int = 20, margin: float = 0.1) -> DataFrame:
    """Mean absolute deviation of the venues as they are and with one side flipped; flagged where flipped fits better and the deviation exceeds ``margin``."""
    d = panel.where("both_traded").groupBy(entity).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("k_last") - F.col("pm_last"))).alias("mad"), F.avg(F.abs(F.col("k_last") - (1 - F.col("pm_last")))).alias("mad_flip")).where(F.col("n") >= least)
    return d.withColumn("flag", (F.col("mad_flip") < F.col("mad")) & (F.col("mad") > margin))


class GateFailed(RuntimeError):
    """A stop gate found rows that must not be."""


def gate(df: DataFrame, bad: Column | str, name: str) -> DataFrame:
    """Pass ``df`` on, or raise if any row is ``bad`` (one row is fetched)."""
    hit = df.where(bad).limit(1).collect()
    if hit:
        raise GateFailed(f"{name}: {hit[0]}")
    return df
