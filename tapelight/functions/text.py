"""Scalar functions over names, tickers, slugs and titles; all JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Composed letters that fall apart into a plain one and marks: generated, not listed.
_COMPOSED = "".join(c for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _COMPOSED)

# Parts of names that don't tell people apart.
STOP_WORDS = ("de", "da", "el", "al", "van", "von", "le", "la", "los", "del", "jr", "sr", "ii", "iii")
# Month codes of tickers.
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def plain_name(c: Column) -> Column:
    """Diacritics stripped, lower case, only letters a-z and blanks kept; a letter with a stroke is dropped, not replaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, _COMPOSED, _PLAIN)), "[^a-z ]", ""), " +", " "))


def name_tokens(c: Column, least: int = 3) -> Column:
    """Sorted distinct tokens of at least ``least`` letters that are no stop words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(plain_name(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS))))


def words(c: Column) -> Column:
    """All distinct words of a name."""
    return F.array_distinct(F.filter(F.split(plain_name(c), " "), lambda t: t != ""))


def title_name(c: Column) -> Column:
    """Who a title asks about: "Will X win the ...", also beat or defeat."""
    return F.nullif(F.trim(F.regexp_extract(c, r"^Will (.+?) (?:win|beat|defeat) ", 1)), F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def any_contained(a: Column, b: Column, least: int = 4) -> Column:
    """Whether a token of one side contains one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.length(x) >= least) & (F.length(y) >= least) & (x.contains(y) | y.contains(x))))


def ticker_parts(c: Column) -> Column:
    """struct(series, day, fight, fighter) of SERIES-yyMONddFIGHT-FIGHTER; null day where the code is no date."""
    get = lambda k: F.regexp_extract(c, r"^([A-Z]+)-(\d{2})([A-Z]{3})(\d{2})([A-Z0-9]*)-([A-Z0-9.]+)$", k)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTH_CODES)), get(3)).cast("string"), 2, "0")
    return F.struct(F.nullif(get(1), F.lit("")).alias("series"), F.try_to_date(F.concat(F.lit("20"), get(2), F.lit("-"), month, F.lit("-"), get(4)), "yyyy-MM-dd").alias("day"), F.nullif(get(5), F.lit("")).alias("fight"), F.nullif(get(6), F.lit("")).alias("fighter"))


def fight_of(c: Column) -> Column:
    """A ticker without its last part."""
    return F.regexp_extract(c, r"^(.*)-[^-]*$", 1)


def strike_of(c: Column) -> Column:
    return F.regexp_extract(c, r"(?<=-T)\d+\.?\d*", 0).try_cast("double")


def slug_parts(c: Column) -> Column:
    """struct(a, b, day): names or codes and the date of a slug in any of its four forms."""
    dated = r"^ufc-([a-z]+)-([a-z]+)-(\d{4}-\d{2}-\d{2})(?:-\d+)*$"
    versus = r"^(.+?)-vs-(.+?)(?:-\d+)?$"
    will = r"^will-(.+?)-beat-(.+?)(?:-in-mma-bout(?:-\d+)?)?$"
    part = lambda p, k: F.when(c.rlike(p), F.regexp_extract(c, p, k))
    return F.struct(F.coalesce(part(dated, 1), part(will, 1), part(versus, 1)).alias("a"), F.coalesce(part(dated, 2), part(will, 2), part(versus, 2)).alias("b"), F.try_to_date(part(dated, 3), "yyyy-MM-dd").alias("day"))


def is_flag(c: Column) -> Column:
    """Text to boolean: true, 1, yes against false, 0, no; null else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def json_list(c: Column) -> Column:
    return F.from_json(c, "array<string>")
