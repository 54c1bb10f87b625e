from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tapelight.operators import stamps

UTC = timezone.utc


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    ("2025-10-01T00:15:08.993932Z", "UTC", "MDY", us(2025, 10, 1, 0, 15, 8) + 993932),
    ("2025-09-30T21:56:49.621-04:00", None, None, us(2025, 10, 1, 1, 56, 49) + 621000),
    ("1759279255", None, None, 1759279255 * 10**6),
    ("1759335482.117", None, None, 1759335482117000),
    ("1782718114833", None, None, 1782718114833000),
    ("1782718114833123", None, None, 1782718114833123),
    ("1782718114833123456", None, None, 1782718114833123),
    ("20251001T015228Z", None, None, us(2025, 10, 1, 1, 52, 28)),
    ("20251001015228Z", None, None, us(2025, 10, 1, 1, 52, 28)),
    ("10/3/2025 7:39:47 PM", "America/New_York", "MDY", us(2025, 10, 3, 23, 39, 47)),
    ("10/3/2025 12:00:00 AM", "UTC", "MDY", us(2025, 10, 3)),
    ("03/10/2025 07:39:47", "UTC", "DMY", us(2025, 10, 3, 7, 39, 47)),
    ("31/10/2025 07:39:47", "UTC", "MDY", us(2025, 10, 31, 7, 39, 47)),
    ("2025/10/03 18:57:56", "Asia/Tokyo", "YMD", us(2025, 10, 3, 9, 57, 56)),
    ("2025-10-04 15:35:36.036 America/New_York", "UTC", None, us(2025, 10, 4, 19, 35, 36) + 36000),
    ("2025-10-04 18:35:13 UTC-3", "UTC", None, us(2025, 10, 4, 21, 35, 13)),
    ("2025-11-02 22:15:43 EST", "UTC", None, us(2025, 11, 3, 3, 15, 43)),
    ("Sun, 03 May 2026 00:40:53 +0400", None, None, us(2026, 5, 2, 20, 40, 53)),
    ("December 2, 2025 07:43:06", "UTC", None, us(2025, 12, 2, 7, 43, 6)),
    ("2024-02-29 00:00:00Z", None, None, us(2024, 2, 29)),
    ("2025-02-29 00:00:00Z", None, None, None),
    ("2025-13-01 00:00:00Z", None, None, None),
    ("2025-10-01 25:00:00Z", None, None, None),
    ("2025-10-01 10:00:00 XYZ", None, None, None),
    ("2025-10-01 10:00:00", None, None, None),
    ("2025-10-01 10:00:00", "Nowhere/Land", None, None),
    ("n/a", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
    ("x" * 100_000, "UTC", None, None),
]


def test_formats(spark):
    rows = [(k, v, z, o) for k, (v, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, v string, zone string, ord string")
    got = {r.id: r._t_us for r in stamps.parse(df, "v", F.col("zone"), F.col("ord")).collect()}
    for k, (v, z, _, want) in enumerate(CASES):
        assert got[k] == want, (v and v[:60], z)


def test_hour_that_occurs_twice(spark):
    # clocks went back on 2025-11-02: 01:30 is 05:30 and again 06:30 UTC
    at = lambda h, m: datetime(2025, 11, 2, h, m)
    df = spark.createDataFrame([(1, "2025-11-02 01:30:00", at(5, 31)), (2, "2025-11-02 01:30:00", at(6, 31)), (3, "2025-11-02 01:30:00", None)], "id int, v string, got timestamp")
    r = {x.id: x._t_us for x in stamps.parse(df, "v", F.lit("America/New_York"), None, F.col("got")).collect()}
    assert r == {1: us(2025, 11, 2, 5, 30), 2: us(2025, 11, 2, 6, 30), 3: us(2025, 11, 2, 5, 30)}


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2025-10-01T00:00:00Z", "x", 7)], "v string, _tp string, _t_us int")
    assert stamps.parse(df, "v").first()._t_us == us(2025, 10, 1)
    assert stamps.parse(df.where("false"), "v").count() == 0


@pytest.mark.parametrize("y,m,d", [(1970, 1, 1), (1969, 12, 31), (2000, 2, 29), (2100, 3, 1), (1, 1, 1), (2026, 12, 31)])
def test_day_arithmetic(y, m, d):
    assert stamps.days_from_civil(y, m, d) == (datetime(y, m, d) - datetime(1970, 1, 1)).days
