"""Quantities recorded in different units -> canonical units.

A value's text is parsed with a small grammar::

    quantity := [currency] number [expression]
    number   := digits with grouping and decimal mark of either style, exponent allowed
    expression := factor { ["of"] ["a"] factor }        e.g. "hundred contracts", "hundredths of a contract"
    factor   := unit | multiplier | "/" digits

Every unit is an exponent vector over the base dimensions (money, contract),
a decimal scale and an offset; an expression's vector and scale are the sums
over its factors. A value converts to the canonical unit of its column when
the vectors agree (a bare share of one dollar, "%" or "bp", is money: a
binary contract pays one dollar): canonical = number * 10^scale + offset.

Numbers without unit take the scale that the row itself proves: prices by
their complement (yes + no = one dollar), notionals by the row's other
amounts. Nothing to tell otherwise means the column's own unit.

Defined results: null, blank and unparsable text give null; infinities and
NaN give null. All steps work on single rows: no shuffle.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY, COUNT, NONE = (1, 0), (0, 1), (0, 0)

# Unit words, their exponent vector over (money, contract), decimal scale and offset.
UNITS: dict[str, tuple[tuple[int, int], int, float]] = {
    "$": (MONEY, 0, 0.0), "usd": (MONEY, 0, 0.0), "usdc": (MONEY, 0, 0.0), "dollar": (MONEY, 0, 0.0), "dollars": (MONEY, 0, 0.0),
    "¢": (MONEY, -2, 0.0), "c": (MONEY, -2, 0.0), "ct": (MONEY, -2, 0.0), "cts": (MONEY, -2, 0.0), "cent": (MONEY, -2, 0.0), "cents": (MONEY, -2, 0.0),
    "mill": (MONEY, -3, 0.0), "mills": (MONEY, -3, 0.0), "us": (NONE, 0, 0.0),
    "%": (NONE, -2, 0.0), "percent": (NONE, -2, 0.0), "pct": (NONE, -2, 0.0), "‰": (NONE, -3, 0.0), "permille": (NONE, -3, 0.0),
    "bp": (NONE, -4, 0.0), "bps": (NONE, -4, 0.0), "basis": (NONE, -4, 0.0), "point": (NONE, 0, 0.0), "points": (NONE, 0, 0.0),
    "contract": (COUNT, 0, 0.0), "contracts": (COUNT, 0, 0.0), "ctr": (COUNT, 0, 0.0), "ctrs": (COUNT, 0, 0.0), "lot": (COUNT, 0, 0.0), "lots": (COUNT, 0, 0.0),
    "tenth": (NONE, -1, 0.0), "tenths": (NONE, -1, 0.0), "hundredth": (NONE, -2, 0.0), "hundredths": (NONE, -2, 0.0), "thousandth": (NONE, -3, 0.0), "thousandths": (NONE, -3, 0.0),
    "millionth": (NONE, -6, 0.0), "millionths": (NONE, -6, 0.0), "micro": (NONE, -6, 0.0), "milli": (NONE, -3, 0.0),
    "ten": (NONE, 1, 0.0), "tens": (NONE, 1, 0.0), "hundred": (NONE, 2, 0.0), "hundreds": (NONE, 2, 0.0), "k": (NONE, 3, 0.0), "tsd": (NONE, 3, 0.0), "thousand": (NONE, 3, 0.0), "thousands": (NONE, 3, 0.0),
    "m": (NONE, 6, 0.0), "mm": (NONE, 6, 0.0), "mio": (NONE, 6, 0.0), "million": (NONE, 6, 0.0), "millions": (NONE, 6, 0.0), "bn": (NONE, 9, 0.0), "billion": (NONE, 9, 0.0),
    "of": (NONE, 0, 0.0), "a": (NONE, 0, 0.0), "an": (NONE, 0, 0.0), "per": (NONE, 0, 0.0),
}

NUMBER = r"[+-]?(?:\d[\d.,'\u00a0\u202f ]*\d|\d|(?=[.,]\d))(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
QUANTITY = re.compile(rf"\s*((?:US\$|[A-Za-z]{{3,4}}|[$€£¢]))?\s*({NUMBER})\s*(.*?)\s*", re.ASCII)
FACTOR = re.compile(r"([^\W\d_]+|[$¢%‰]|/\s*10+)")
BARE = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_SPELLED = T.StructType(
    [T.StructField("number", T.DoubleType()), T.StructField("money", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("scale", T.IntegerType()), T.StructField("offset", T.DoubleType())]
)


def number(text: str) -> float | None:
    """A number in either decimal style; None if it is none.

    With both marks the last one is the decimal mark. A single comma groups
    thousands when one to three digits not starting with 0 precede it and
    exactly three follow; several equal marks always group.
    """
    t = re.sub("['\u00a0\u202f ]", "", text)
    if "," in t and "." in t:
        t = t.replace(".", "").replace(",", ".") if t.rfind(",") > t.rfind(".") else t.replace(",", "")
    elif re.fullmatch(r"[+-]?[1-9]\d{0,2}(,\d{3})+", t) or re.fullmatch(r"[+-]?[1-9]\d{0,2}(\.\d{3}){2,}", t):
        t = t.replace(",", "").replace(".", "")
    try:
        x = float(t.replace(",", "."))
    except ValueError:
        return None
    return x if math.isfinite(x) else None


@functools.lru_cache(4096)
def expression(words: str) -> tuple[int, int, int, float] | None:
    """Sum of the exponent vectors, scales and offsets of an expression's factors; None if a factor is unknown."""
    money = count = scale = 0
    offset = 0.0
    for w in FACTOR.findall(words.lower()):
        if w.startswith("/"):
            scale -= w.count("0")
            continue
        if w not in UNITS:
            return None
        (m, c), s, o = UNITS[w]
        money, count, scale, offset = money + m, count + c, scale + s, offset + o
    return money, count, scale, offset


def parse_quantity(text: str | None) -> tuple | None:
    """(number, money, count, scale, offset) of a text with unit."""
    m = QUANTITY.fullmatch(text) if text else None
    x = number(m[2]) if m else None
    e = expression(f"{m[1] or ''} {m[3]}") if x is not None else None
    return (x, *e) if e else None


@F.pandas_udf(_SPELLED)
def _spelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [parse_quantity(t) or (None,) * 5 for t in texts]
        yield pd.DataFrame({f.name: pd.Series([r[k] for r in rows], dtype="Float64" if f.dataType == T.DoubleType() else "Int32") for k, f in enumerate(_SPELLED.fields)})


def quantities(df: DataFrame, **columns: str) -> DataFrame:
    """Add a struct(number, money, count, scale, offset, unit) per ``new=column``; ``unit`` is false for a bare number.

    Bare numbers are read by the JVM; only texts with units, signs of currency
    or another number style pass through the Arrow-batched grammar.
    """
    df = df.withColumns({f"_s{new}": _spelled(F.when(~F.col(c).rlike(BARE), F.col(c))) for new, c in columns.items()})
    made = {}
    for new, c in columns.items():
        plain = F.when(F.col(c).rlike(BARE), F.trim(c).try_cast("double"))
        s = lambda f: F.col(f"_s{new}.{f}")  # noqa: B023, E731
        made[new] = F.struct(
            F.coalesce(plain, s("number")).alias("number"), F.coalesce(s("money"), F.lit(0)).alias("money"), F.coalesce(s("count"), F.lit(0)).alias("count"),
            F.coalesce(s("scale"), F.lit(0)).alias("scale"), F.coalesce(s("offset"), F.lit(0.0)).alias("offset"), (s("number").isNotNull() & ((s("money") != 0) | (s("count") != 0) | (s("scale") != 0))).alias("unit"),
        )
    return df.withColumns({k: fence(v) for k, v in made.items()}).drop(*[f"_s{new}" for new in columns])


def fence(c: Column) -> Column:
    """``c`` behind an always-true random condition: Catalyst neither inlines it into its many uses nor pushes a filter on it down,
    either of which would repeat the grammar's expression in every place that reads one of its fields."""
    return F.when(F.rand(0) >= 0, c)


def price_scale(own: Column, other: Column, ceiling: int = 0, steps: tuple[int, ...] = (0, -2, -3, -4)) -> Column:
    """Scale s with own*10^s in dollars: the complement decides (own*10^s + other*10^r = 1), else ``ceiling``.

    ``own`` and ``other`` are structs of quantities(); ``ceiling`` is the decimal
    exponent of the column's own unit (0 dollars, -2 cents).
    """
    y, n = own["number"], other["number"]
    tenth = lambda s: F.lit(10.0**s)
    told = own["unit"] & own["money"].isin(0, 1) & (own["count"] == 0)
    sum_ = y + n
    same = F.coalesce(*[F.when(F.abs(sum_ * tenth(s) - 1) <= 0.0011, s) for s in steps])
    rest = F.when(n > 0, F.coalesce(*[F.when(F.abs(F.log10((1 - y * tenth(s)) / n) - r) <= 0.0005, s) for s in steps for r in steps if r != s]))
    against = F.coalesce(*[F.when(F.abs(y * tenth(s) + n * F.pow(F.lit(10.0), other["scale"]) - 1) <= 0.0011, s) for s in steps])
    paired = F.when(n.isNotNull(), F.when(other["unit"], against).otherwise(F.coalesce(same, rest)))
    # alone: the column's unit, unless the value would exceed one dollar in it
    alone = F.when(F.abs(y) * tenth(ceiling) <= 1, ceiling)
    for s in steps:
        if s < ceiling:
            alone = alone.when(F.abs(y) * tenth(s) <= 1, s)
    return F.when(told, own["scale"]).when(y.isNotNull(), F.coalesce(paired, alone.otherwise(ceiling)))


def count_scale(own: Column) -> Column:
    """Scale of a contract count; a unit that isn't a count of contracts gives null."""
    return F.when((own["money"] == 0) & own["count"].isin(0, 1), own["scale"])


def notional_scale(value: Column, expected: Column, steps: tuple[int, ...] = (0, -2, -3, -6, 3)) -> Column:
    """Scale s with value*10^s closest to the amount the row's other fields give; 0 where they give none or none fits within a tenth of a decade."""
    ratio = F.log10(F.when((value > 0) & (expected > 0), expected / value))
    fits = [F.when(F.abs(ratio - s) < 0.1, s) for s in steps]
    return F.coalesce(*fits, F.lit(0))


def collateral(df: DataFrame, id_unit: float = 1e-6) -> Column:
    """The collateral leg of an on-chain fill in dollars: the amount on the side whose asset id is 0."""
    zero = lambda c: F.trim(F.col(c)).rlike("^0+$")
    return F.when(zero("maker_asset_id"), F.col("maker_amount") * id_unit).when(zero("taker_asset_id"), F.col("taker_amount") * id_unit)


def _others(df: DataFrame, *made: str) -> list[str]:
    """Input columns that keep their place; one named like a result gives way to it."""
    return [c for c in df.columns if c not in made]


def live_quantities(df: DataFrame) -> DataFrame:
    """tape_live with ``price_usd``, ``contracts`` and the scales they were recorded at."""
    own = _others(df, "price_scale", "count_scale", "price_usd", "contracts")
    df = quantities(df, _y="yes_price_dollars", _n="no_price_dollars", _c="count_fp")
    df = df.withColumns({"price_scale": fence(price_scale(F.col("_y"), F.col("_n"))), "count_scale": fence(count_scale(F.col("_c")))})
    ten = lambda c: F.pow(F.lit(10.0), F.col(c))
    return df.select(*own, "price_scale", "count_scale", (F.col("_y.number") * ten("price_scale")).alias("price_usd"), (F.col("_c.number") * ten("count_scale") + F.col("_c.offset")).alias("contracts"))


def archive_quantities(df: DataFrame) -> DataFrame:
    """tape_archive with ``price_usd`` and its scale; the column's own unit is cents."""
    own = _others(df, "price_scale", "price_usd")
    bare = lambda c: F.struct(F.col(c).cast("double").alias("number"), F.lit(0).alias("money"), F.lit(0).alias("count"), F.lit(0).alias("scale"), F.lit(False).alias("unit"))
    df = df.withColumn("price_scale", fence(price_scale(bare("yes_price"), bare("no_price"), ceiling=-2, steps=(-2, -3, -4, 0))))
    return df.select(*own, "price_scale", (F.col("yes_price") * F.pow(F.lit(10.0), F.col("price_scale"))).alias("price_usd"))


def notional_quantities(df: DataFrame) -> DataFrame:
    """pm_trades with ``usdc`` and its scale; expected amounts come from the fill's collateral leg, else from size and the traded token's price."""
    own = _others(df, "usdc_scale", "usdc")
    sized = F.col("size") * F.when(F.lower("outcome") == "no", 1 - F.col("price_yes")).otherwise(F.col("price_yes"))
    good = lambda c: F.when(~F.isnan(c), c)
    df = df.withColumn("_e", F.coalesce(collateral(df), good(sized)))
    df = df.withColumn("usdc_scale", fence(F.when(good(F.col("usdc_amount")).isNotNull(), notional_scale(F.col("usdc_amount"), F.col("_e")))))
    return df.select(*own, "usdc_scale", (F.col("usdc_amount") * F.pow(F.lit(10.0), F.col("usdc_scale"))).alias("usdc"))
