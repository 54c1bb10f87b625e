"""Ladders against their rules written out, percentiles and ranks against plain sorting, streams against batches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapelight.operators import bars, ladders, match, stats
from tapelight.streaming import live


def rule(price, mass):
    """The gap rule, step by step on lists that count from one."""
    p, x = [None, *price], [None, *mass]
    n = len(mass)
    high = [i for i in range(1, n + 1) if p[i] is not None and p[i] > 49]
    if high:
        fixed = max(high)
    else:
        best = max((v for v in price if v is not None), default=None)
        fixed = next((i for i in range(1, n + 1) if p[i] == best), 0)
    again = n - 1 > 2
    while again:
        again = False
        for i in range(1, n):
            if p[i] is None:
                continue
            if p[i] > 49 and x[i] != 0 and x[i + 1] == 0 and i != fixed:
                x[i + 1], x[i], again = x[i], 0, True
            if p[i] < 49 and x[i] == 0 and x[i + 1] != 0 and i != fixed and i + 1 != fixed:
                x[i], x[i + 1], again = x[i + 1], 0, True
    return x[1:]


def test_pushed_by_hand():
    assert ladders.pushed([90, 80, 70, 60, 30, 20], [5, 0, 3, 0, 0, 7]) == [0.0, 0.0, 5, 3, 7, 0.0]
    # a tie at the centre moves neither way; all prices under it: the highest price's bin stays
    assert ladders.pushed([49, 49, 49, 49], [5, 0, 0, 7]) == [5, 0, 0, 7]
    assert ladders.pushed([40, 30, 20, 10], [0, 0, 6, 0]) == [0, 6, 0.0, 0]
    assert ladders.pushed([80, 20, 10], [1, 0, 2]) == [1, 0, 2] and ladders.pushed([], []) == []


@pytest.mark.parametrize("seed", range(30))
def test_pushed_against_the_rule(seed):
    r = random.Random(seed)
    n = r.randrange(1, 14)
    price = sorted((float(r.choice([1, 20, 48, 49, 50, 70, 98])) for _ in range(n)), reverse=True)
    mass = [float(r.choice([0, 0, 1, 3, 7])) for _ in range(n)]
    assert ladders.pushed(price, mass) == rule(price, mass)


def test_bins_by_hand(spark):
    d = date(2025, 1, 1)
    rows = [("c", d, 3.0, 80.0), ("c", d, 4.0, 60.0), ("c", d, 7.0, 10.0), ("low", d, 1.0, 30.0), ("tie", d, 1.0, 49.0), ("tie", d, 2.0, 49.0), ("zero", d, 1.0, 5.0), ("zero", d, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "contract string, date date, strike double, middle double").withColumn("k", F.lit("clash"))
    got = {}
    for r in ladders.bins(df).orderBy("contract", "strike").collect():
        got.setdefault(r.contract, []).append((r.strike, r.price, r.mass))
    assert got["c"] == [(2.0, 80.0, 19.0), (3.0, 80.0, 20.0), (4.0, 60.0, 50.0), (5.0, 10.0, 0.0), (6.0, 10.0, 0.0), (7.0, 10.0, 9.0)]
    assert got["low"] == [(0.0, 30.0, 69.0), (1.0, 30.0, 29.0)] and got["tie"] == [(0.0, 49.0, 50.0), (1.0, 49.0, 0.0), (2.0, 49.0, 48.0)]
    assert got["zero"] == [(0.0, 5.0, 94.0), (1.0, 5.0, 5.0), (2.0, None, -1.0)]
    assert [r.mass for r in ladders.swapped(ladders.bins(df)).where("contract = 'c'").orderBy("strike").collect()] == [19.0, 20.0, 50.0, 9.0, 0.0, 0.0]
    assert ladders.swapped(ladders.bins(df.where("false"))).count() == 0


def test_percentiles_against_sorting(spark):
    r = random.Random(3)
    rows = [(r.choice("abc") if k % 3 else "hot", float(r.choice([1, 2, 2, 2, r.randrange(1000)])), k) for k in range(3000)] + [("hot", None, 1), (None, 4.0, 2), ("one", 7.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, _n int").repartition(7)
    at = [0.0, 0.1, 0.5, 0.9, 1.0]

    def plain(xs):
        xs = sorted(xs)
        return [xs[int(p)] + (xs[min(int(p) + 1, len(xs) - 1)] - xs[int(p)]) * (p - int(p)) for p in ((len(xs) - 1) * q for q in at)]

    got = {x.g: list(x.p) for x in stats.percentiles(df, "x", at, ["g"]).collect()}
    assert got.keys() == {"a", "b", "c", "hot", "one", None}
    for g, p in got.items():
        assert p == pytest.approx(plain([x for h, x, _ in rows if h == g and x is not None]))
    assert list(stats.percentiles(df, "x", at).first().p) == pytest.approx(plain([x for _, x, _ in rows if x is not None]))
    assert stats.percentiles(df.where("false"), "x", at, ["g"]).count() == 0


def test_ranked_against_sorting(spark):
    r = random.Random(5)
    rows = [(r.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(6)
    got = [(x.v, x.id) for x in sorted(stats.ranked(df, [F.desc("v"), F.col("id")]).collect(), key=lambda x: x["rank"])]
    assert got == sorted(rows, key=lambda x: (-x[0], x[1]))


def test_hc3_without_groups(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + (k % 3), "a") for k in range(20)], "x double, y double, g string")
    assert tuple(stats.hc3(df, "x", "y").first()) == pytest.approx(tuple(stats.hc3(df, "x", "y", ["g"]).drop("g").first()))


def test_streaming_bars_skip_null_prices(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [("a", 0.5, 2.0, 1, t0), ("a", 0.6, None, 2, t0 + timedelta(seconds=5)), ("a", None, 6.0, 3, t0 + timedelta(seconds=9)), ("b", None, 1.0, 4, t0)]
    df = spark.createDataFrame(rows, "ticker string, price double, size double, trade_id int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = live.drain(live.streaming_bars(stream, ["ticker"], "ts", "5 minutes")).orderBy("ticker").collect()
    want = bars.make_bars(df.withColumn("t", F.unix_seconds("ts")), ["ticker"]).orderBy("ticker").collect()
    assert [(r.n, r.last, r.vwap, r.vol) for r in got] == [(r.n, r.last, r.vwap, r.vol) for r in want] == [(2, 0.6, 0.5, 2.0), (0, None, None, None)]


def test_streaming_rolling_sum_and_cold_start(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", float(k), t0 + timedelta(hours=k)) for k in range(12)], "k string, x double, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.since(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "2025-01-01 12:00:00", "10 hours")
    got = {(r.upto - 1735689600) // 3600: (r.sum, r.n) for r in live.drain(live.rolling(stream, ["k"], "ts", "6 hours", "1 hour", "x")).collect()}
    for end in range(3, 18):
        inside = [float(h) for h in range(2, 12) if end - 6 <= h < end]
        assert got[end] == (sum(inside), len(inside))


def test_sides(spark):
    pairs = spark.createDataFrame(
        [("f1", "live", ["t1", "t2"], ["Clara Dumont", "Anna Berg"], ["x"]), ("f2", "live", ["t3", "t4"], ["Nobody", "Hanna Ismold"], []), ("f3", "old", ["t3", "t4"], ["Nobody", "Hanna Ismold"], []), ("f4", "live", ["t9"], None, None)],
        "fight_id string, era string, tickers array<string>, who array<string>, named array<string>",
    )
    t = datetime(2025, 1, 1)
    names = spark.createDataFrame([("t1", "Anna Berg", t), ("t2", "Clara Dumont", None), ("t3", "Frida Gall", None), ("t4", "Hanna Ismold", t)], "ticker string, name string, close_time timestamp")
    got = {r.fight_id: (r.yes_ticker, r.flip, r.pm_outcome, r.close, r.side_method) for r in match.sides(pairs, names, "live").collect()}
    assert got["f1"] == ("t2", False, "Clara Dumont", t, "named_outcome") and got["f2"] == ("t4", True, "Hanna Ismold", t, "slug_position")
    assert got["f3"] == ("t3", True, "Hanna Ismold", t, "slug_position") and got["f4"][:3] == ("t9", False, None)
    o = spark.createDataFrame([("f1", "True"), ("f2", "0")], "fight_id string, flip string")
    assert {r.fight_id: r.flip for r in match.sides(pairs, names, "live", o).where("fight_id in ('f1', 'f2')").collect()} == {"f1": True, "f2": False}
