"""Timestamps in mixed formats, precisions and zones -> one UTC form.

All formats are compiled into ONE regular expression, an alternation with
named groups; one match per value extracts every component. The components
are checked against the calendar and instants are assembled with integer day
arithmetic, so a value never passes a locale- or session-bound parser. This
runs in one Arrow-batched function that keeps no state; only the zone rules
of stamps without offset are applied by the JVM. No shuffle. Values already
in the canonical form should be filtered out before (a JVM predicate).

Defined results: null, blank and wordy values ("n/a"), impossible dates
(month 13, 30 February, hour 25) and zone names nobody knows give null.
A stamp without zone uses ``home_zone``; where that is null too it gives
null, since it names no single instant. An hour that occurs twice when
clocks go back is the first of the two unless ``received`` (the time the row
was fetched) shows that the second one fits: the later reading is taken when
it is not after ``received`` and the earlier lies over an hour before it. An
hour that clocks skip is read with the offset before the change. All-number
dates follow ``date_order`` (MDY, DMY, YMD); if they are impossible in that
order and possible in the other, the other is used. Two-digit years are
2000-2099. Digits alone are epochs: up to 11 digits seconds, 12-14
milliseconds, 15-17 microseconds, 18-19 nanoseconds; 8 digits are a compact
date and 14 starting with 19 or 20 a compact date and time.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Zone abbreviations in use on the feeds, offset from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "GST": 240, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "BRT": -180, "BRST": -120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

_MON = "(?:" + "|".join(MONTHS) + ")[a-z]*"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+)?"
_DATE = "|".join(
    (
        r"(?P<ya>\d{4})(?P<sa>[-/.])(?P<ma>\d{1,2})(?P=sa)(?P<da>\d{1,2})",
        r"(?P<yb>(?:19|20)\d\d)(?P<mb>\d\d)(?P<db>\d\d)",
        r"(?P<nc>\d{1,2})(?P<sc>[-/.])(?P<oc>\d{1,2})(?P=sc)(?P<yc>\d{4}|\d{2})",
        rf"{_WEEKDAY}(?P<wd>{_MON})\.?\s+(?P<dd>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<yd>\d{{4}})",
        rf"{_WEEKDAY}(?P<de>\d{{1,2}})(?:st|nd|rd|th)?[-\s](?P<we>{_MON})\.?[-,\s]+(?P<ye>\d{{4}}|\d{{2}})",
    )
)
_TIME = r"(?:(?P<ha>\d{1,2}):(?P<ia>\d\d)(?::(?P<ea>\d\d)(?:[.,](?P<fa>\d{1,9}))?)?|(?P<hb>\d\d)(?P<ib>\d\d)(?:(?P<eb>\d\d)(?:[.,](?P<fb>\d{1,9}))?)?)"
_ZONE = r"(?:(?:utc|gmt|z)?(?P<zs>[+-])(?P<zh>\d{1,2})(?::?(?P<zm>\d\d))?|(?P<zn>[a-z]+/[a-z0-9_+/-]+)|(?P<za>[a-z]{1,5}))"
PATTERN = re.compile(
    rf"\s*(?:(?:{_DATE})(?:(?:[T,\s]\s*|(?<=\d{{8}}))(?:at\s+)?{_TIME}(?:\s*(?P<ap>[ap])\.?m\b\.?)?(?:\s*{_ZONE})?)?|(?P<ep>\d{{9,19}})(?:\.(?P<ef>\d{{1,9}}))?)\s*",
    re.IGNORECASE | re.ASCII,
)

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
CANONICAL_DATE = r"^\d{4}-\d{2}-\d{2}$"


def known_zones(spark: SparkSession) -> list[str]:
    """IANA names that both this Python and the JVM know; asking for another would fail the task."""
    names = {z for z in zoneinfo.available_timezones() if re.fullmatch(r"[A-Z][A-Za-z_]+/[A-Za-z0-9_+/-]+|UTC", z)}
    try:
        names &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except AttributeError:  # no JVM handle in a remote session
        pass
    return sorted(names)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a Gregorian date, in integers: years that start in March end with the leap day."""
    y -= m <= 2
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * ((m + 9) % 12) + 2) // 5 + d - 719469


def days_in_month(y: int, m: int) -> int:
    return 28 + (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) if m == 2 else 30 if m in (4, 6, 9, 11) else 31


def _micros(digits: str | None) -> int:
    return int((digits + "00000")[:6]) if digits else 0


def assemble(value: str | None, order: str | None) -> tuple[int | None, int | None, int | None, int | None, str | None]:
    """(epoch microseconds, day written, microseconds of the wall clock, offset in seconds, zone name); nulls where the stamp doesn't tell."""
    none = (None, None, None, None, None)
    m = PATTERN.fullmatch(value) if value else None
    if not m:
        return none
    g = m.groupdict()
    if e := g["ep"]:
        n = len(e)
        if n <= 11:
            return int(e) * 1_000_000 + _micros(g["ef"]), None, None, None, None
        return int(e) * 1000 if n <= 14 else int(e) if n <= 17 else int(e) // 1000, None, None, None, None
    y = g["ya"] or g["yb"] or g["yc"] or g["yd"] or g["ye"]
    year = int(y) + (2000 if len(y) == 2 else 0)
    if g["nc"]:
        first, second = int(g["nc"]), int(g["oc"])
        by_month = first <= 12 if second > 12 else (order or "").upper() == "MDY" and first <= 12
        month, day = (first, second) if by_month else (second, first)
    else:
        word = g["wd"] or g["we"]
        month = MONTHS.index(word[:3].lower()) + 1 if word else int(g["ma"] or g["mb"])
        day = int(g["da"] or g["db"] or g["dd"] or g["de"])
    if not (year >= 1 and 1 <= month <= 12 and 1 <= day <= days_in_month(year, month)):
        return none
    hour, minute, second = int(g["ha"] or g["hb"] or 0), int(g["ia"] or g["ib"] or 0), int(g["ea"] or g["eb"] or 0)
    if g["ap"]:
        if not 1 <= hour <= 12:
            return none
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return none
    days = days_from_civil(year, month, day)
    wall = (days * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000 + _micros(g["fa"] or g["fb"])
    offset, zone = None, g["zn"]
    if g["zs"]:
        offset = (int(g["zh"]) * 3600 + int(g["zm"] or 0) * 60) * (-1 if g["zs"] == "-" else 1)
        if abs(offset) > 18 * 3600:
            return none
    elif a := g["za"]:
        if a.upper() not in ABBREVIATIONS:
            return none
        offset = ABBREVIATIONS[a.upper()] * 60
    return None, days, wall, offset, zone


_PARTS = T.StructType([T.StructField(n, T.LongType()) for n in ("epoch_us", "day", "wall_us", "offset_s")] + [T.StructField("zone", T.StringType())])


@F.pandas_udf(_PARTS)
def _assemble(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for value, order in batches:
        rows = [assemble(v, o) for v, o in zip(value, order)]
        yield pd.DataFrame({f.name: pd.Series([r[k] for r in rows], dtype="object" if f.name == "zone" else "Int64") for k, f in enumerate(_PARTS.fields)})


def parse(df, value: str, home_zone: Column | None = None, date_order: Column | None = None, received: Column | None = None, zones: list[str] | None = None, keep: str = "_t"):
    """Add ``{keep}_us`` (UTC microseconds) and ``{keep}_day`` (the calendar date written, days since 1970) for column ``value``."""
    zones = known_zones(df.sparkSession) if zones is None else zones
    nothing = F.lit(None).cast("string")
    own, p = [c for c in df.columns if c not in (f"{keep}_us", f"{keep}_day", f"{keep}p")], f"{keep}p"
    df = df.withColumn(p, _assemble(F.col(value), date_order if date_order is not None else nothing))
    named = F.coalesce(F.col(f"{p}.zone"), home_zone if home_zone is not None else nothing)
    zone = F.when(named.isin(zones), named)
    wall = F.timestamp_micros(f"{p}.wall_us")
    first = F.to_utc_timestamp(wall, zone)
    # the hour that occurs twice: one hour later reads the same on the wall
    second = F.timestamp_micros(F.unix_micros(first) + 3_600_000_000)
    waited = F.unix_micros(received) - F.unix_micros(first) if received is not None else F.lit(None).cast("bigint")
    later = (F.from_utc_timestamp(second, zone) == wall) & (waited >= 3_600_000_000)
    local = F.unix_micros(first) + F.when(later, 3_600_000_000).otherwise(0)
    us = F.coalesce(F.col(f"{p}.epoch_us"), F.col(f"{p}.wall_us") - F.col(f"{p}.offset_s") * 1_000_000, local)
    return df.select(*own, us.alias(f"{keep}_us"), F.col(f"{p}.day").alias(f"{keep}_day"))


def utc_text(us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``"""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
