"""Relational helpers: best match per key, overrides, upserts, coverage, complement legs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelight.functions import text as X


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (give a unique last column)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def coverage_floor(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows: the counts are aggregated first and met by a semi join, so no group is gathered."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def overridden(df: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """ACCEPT keeps a row, REMAP takes the override's value, REJECT nulls it; ``decision`` tells which (AUTO without override)."""
    o = overrides.select(F.col(key), F.upper("action").alias("_a"), F.col("correct").alias("_v"))
    d = df.join(o, key, "left")
    v = F.when(F.col("_a") == "REJECT", None).when(F.col("_a") == "REMAP", F.col("_v")).otherwise(F.col(value))
    return d.withColumn(value, v).withColumn("decision", F.coalesce("_a", F.lit("AUTO"))).drop("_a", "_v")


def sides(pairs: DataFrame, names: DataFrame, alt_era: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Which ticker of a bout stands for the market's first name, for (fight_id, era, tickers, who, named, ...) and (ticker, name, close_time).

    The ticker whose name shares most words with the first name is its YES side, the first in the list at equal scores. Where none shares
    any and there are two, the sides are flipped (``overrides``: fight_id, flip text, has the last word); in ``alt_era`` a flipped bout takes the ticker of
    the second name. ``close`` is that ticker's closing time, else the first other one's; ``side_method`` tells whether outcomes have names.
    """
    first, second = F.get("who", F.lit(0)), F.get("who", F.lit(1))
    t = pairs.select("fight_id", X.words(first).alias("_a"), X.words(second).alias("_b"), F.posexplode("tickers").alias("_pos", "ticker")).join(names, "ticker", "left")
    score = lambda c: F.coalesce(X.overlap(F.col(c), X.words(F.col("name"))), F.lit(0))
    t = t.withColumns({"_s0": score("_a"), "_s1": score("_b")})
    # a bout has a handful of tickers
    best = t.groupBy("fight_id").agg(
        F.max_by("ticker", F.struct("_s0", -F.col("_pos"))).alias("_t0"), F.max("_s0").alias("name_score"), F.max_by("ticker", F.struct("_s1", -F.col("_pos"))).alias("_t1"),
        F.array_sort(F.collect_list(F.when(F.col("close_time").isNotNull(), F.struct("_pos", "ticker", "close_time")))).alias("_closes"),
    )
    d = pairs.join(best, "fight_id")
    flip = (F.col("name_score") == 0) & (F.size("tickers") >= 2)
    if overrides is not None:
        d = d.join(overrides.select("fight_id", X.is_flag(F.col("flip")).alias("_o")), "fight_id", "left")
        flip = F.coalesce("_o", flip)
    two = F.size("who") >= 2
    yes = F.when(F.col("flip") & two & (F.col("era") == alt_era), F.col("_t1")).otherwise(F.col("_t0")) if alt_era else F.col("_t0")
    d = d.withColumn("flip", flip).withColumn("yes_ticker", yes)
    own = F.get(F.filter("_closes", lambda x: x["ticker"] == F.col("yes_ticker")), F.lit(0))["close_time"]
    close = F.coalesce(own, F.get("_closes", F.lit(0))["close_time"])
    method = F.when(F.size("named") > 0, "named_outcome").otherwise("slug_position")
    return d.withColumns({"pm_outcome": F.when(F.col("flip") & two, second).otherwise(first), "close": close, "side_method": method}).drop("_t0", "_t1", "_closes", "_o")


def case_fallback(df: DataFrame, known: DataFrame, on: Sequence[str], said: str, name: str) -> DataFrame:
    """``df`` with ``name`` from ``known`` where it is written as ``said``, else where only the case differs (the first in order), and ``how``."""
    lower = known.groupBy(*on, F.lower(name).alias("_low")).agg(F.min(name).alias("_any"), F.collect_set(name).alias("_all"))
    d = df.withColumn("_low", F.lower(said)).join(lower, [*on, "_low"], "left").drop("_low")
    exact = F.coalesce(F.array_contains("_all", F.col(said)), F.lit(False))
    how = F.when(exact, "exact").when(F.col("_any").isNotNull(), "case").otherwise("none")
    return d.withColumns({name: F.when(exact, F.col(said)).otherwise(F.col("_any")), "how": how}).drop("_any", "_all")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union in which an existing row wins over a new one with its key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per(both, keys, [F.col("_new"), *order]).drop("_new")


def replace_partition(spark, path: str, rows: DataFrame, by: str) -> None:
    """Overwrite only the partitions that ``rows`` has; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def complement_filter(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """Fills with a market's YES token on either side; markets without a known token are kept whole."""
    t = tokens.select("market_id", F.col("yes_token").alias("_y"))
    d = fills.join(t, "market_id", "left")
    return d.where(F.col("_y").isNull() | (F.col("maker_asset_id") == F.col("_y")) | (F.col("taker_asset_id") == F.col("_y"))).drop("_y")


def fill_price(d: DataFrame) -> DataFrame:
    """On-chain price of a fill: collateral over tokens, whichever side the collateral (short id) is on; null for empty fills."""
    maker_pays = F.length("maker_asset_id") < 20
    usd = F.when(maker_pays, F.col("maker_amount")).otherwise(F.col("taker_amount"))
    qty = F.when(maker_pays, F.col("taker_amount")).otherwise(F.col("maker_amount"))
    return d.withColumns({"usd": usd / 1e6, "qty": qty / 1e6, "price": usd / F.nullif(qty, F.lit(0))})


def stop_gate(df: DataFrame, lo: float = 0.98, hi: float = 1.02, mad: float = 0.01) -> DataFrame:
    """passed: count ratio inside [lo, hi] and deviation under ``mad``."""
    return df.withColumn("passed", F.col("ratio").between(lo, hi) & (F.col("mad") < mad))
