import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapelight.functions import text as X
from tapelight.operators import asof, bars, eventstudy, ladders, match, stats
from tapelight.sources import io


def test_names_keep_stroke_letters_out(spark):
    r = spark.createDataFrame([("Ana Syguła",), ("Benoît Saint-Denis",), (None,)], "n string").select(X.plain_name(F.col("n"))).collect()
    assert [x[0] for x in r] == ["ana sygua", "benoit saintdenis", None]


def test_fill_limit_and_stale(spark):
    b = [(1, 0, 0.5, 0.5, 1.0, 1)] + [(1, 3600 * 14, 0.7, 0.7, 1.0, 1)]
    k = spark.createDataFrame(b, "fight int, bar bigint, last double, vwap double, vol double, n int")
    p = spark.createDataFrame([(1, 0, 0.4, 0.4, 1.0, 1)], k.schema)
    got = {r.bar // 3600: r for r in bars.panel(k, p, 3600).collect()}
    assert set(got) == set(range(13)) | {14} and got[12].k_stale and not got[0].k_stale and got[14].pm_last is None


def test_quantile_bins_keep_ties(spark):
    xs = [0.0] * 10 + [1.0] * 5 + list(map(float, range(2, 12)))
    d = stats.quantile_bins(spark.createDataFrame([(x,) for x in xs], "x double"), "x").toPandas()
    assert d.groupby("x")["q"].nunique().max() == 1
    edges = np.percentile(xs, [20, 40, 60, 80])
    assert (d["q"] == 1 + sum((d["x"] > e).astype(int) for e in edges)).all()


def test_regressions_against_numpy(spark):
    r = np.random.default_rng(0)
    d = pd.DataFrame({"x": r.normal(size=200), "z": r.normal(size=200), "g": r.integers(0, 12, 200)})
    d["y"] = 1 + 2 * d.x - d.z + r.normal(size=200)
    df = spark.createDataFrame(d)
    m = np.column_stack([np.ones(200), d.x, d.z])
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ d.y
    e = (d.y - m @ b) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
    se = np.sqrt(np.diag(inv @ (m.T * (e**2).to_numpy()) @ m @ inv))
    got = stats.ols(df, ["x", "z"], "y")
    assert np.allclose(got["beta"], b) and np.allclose(got["se"], se)
    one = stats.hc3(df, "x", "y").first()
    m1 = m[:, :2]
    i1 = np.linalg.inv(m1.T @ m1)
    b1 = i1 @ m1.T @ d.y
    e1 = (d.y - m1 @ b1) / (1 - np.einsum("ij,jk,ik->i", m1, i1, m1))
    assert one.beta == pytest.approx(b1[1]) and one.se == pytest.approx(np.sqrt((i1 @ (m1.T * (e1**2).to_numpy()) @ m1 @ i1)[1, 1]))


def test_boot_is_repeatable():
    s = pd.DataFrame({"v": range(10)})
    assert stats.two_stage_boot(s, lambda d: d.v.mean(), 200, 42) == stats.two_stage_boot(s, lambda d: d.v.mean(), 200, 42)


def test_episode_state_machine(spark):
    r = np.random.default_rng(4)
    data = [(f, t, 0.5, float(0.5 + r.choice([0.0, 0.01, 0.03, 0.05, 0.08])), 1, 1) for f in range(20) for t in range(40)]
    df = spark.createDataFrame(data, "fight int, bar int, k_last double, pm_last double, k_n int, pm_n int")
    got = {(x.fight, x.start, x.end) for x in eventstudy.gap_episodes(df).collect()}
    want = set()
    for f in range(20):
        since, prior = None, None
        for _, t, k, p, *_ in [d for d in data if d[0] == f]:
            g = round(abs(k - p), 9)
            if since is None and g >= 0.05 and (prior is None or prior < 0.05):
                since = t
            elif since is not None and g <= 0.02:
                want.add((f, since, t))
                since = None
            prior = g
        if since is not None:
            want.add((f, since, None))
    assert got == want


def test_ladder_identities(spark):
    r = np.random.default_rng(2)
    g = spark.createDataFrame([("c", 1, float(s), float(r.integers(1, 99))) for s in range(1, 20)], "contract string, date int, strike double, price double")
    m = ladders.monotone(g).orderBy("strike").toPandas()
    assert m["middle"].is_monotonic_decreasing and m["ltr"].is_monotonic_decreasing and m["rtl"].is_monotonic_decreasing
    p = ladders.pmf(ladders.monotone(g))
    assert p.agg(F.sum("probability")).first()[0] == pytest.approx(100)
    b = ladders.bins(ladders.monotone(g))
    u = ladders.swapped(b).orderBy("strike").toPandas()
    assert sorted(u["mass"]) == sorted(r.mass for r in b.collect()) and ladders.normalised(ladders.swapped(b)).agg(F.sum("probability")).first()[0] == pytest.approx(100)
    # no gap is left that a mass over 49 could move up into, nor one under it down, but at the median's bin
    kept = max(u.index[u.price > 49])
    assert not any(u.price[k] > 49 and k != kept and u["mass"][k] and not u["mass"][k + 1] for k in range(len(u) - 1))
    assert not any(u.price[k] < 49 and k + 1 != kept and not u["mass"][k] and u["mass"][k + 1] for k in range(len(u) - 1))


def test_band_join_against_all_pairs(spark):
    r = np.random.default_rng(3)
    make = lambda n: [(k, int(r.integers(3)) if k % 9 else None, int(r.integers(-200, 200)) if k % 7 else None) for k in range(n)]
    left, right = make(150), make(120)
    frame = lambda rows, x: spark.createDataFrame(rows, f"{x} int, k int, d int").select(x, "k", F.date_from_unix_date("d").alias(f"d{x}"))
    for days in (0, 1, 30):
        j = asof.band_join(frame(left, "a"), frame(right, "b"), "da", "db", days, ["k"]).select("a", "b")
        want = sorted((a, b) for a, k, d in left for b, m, e in right if None not in (k, d, e) and k == m and abs(d - e) <= days)
        assert want and sorted(tuple(x) for x in j.collect()) == want
        assert rows_out(j, "GenerateExec") <= 2 * len(left)


def rows_out(df, kind):
    """Rows that the nodes of a kind made in the plan that ran."""
    def walk(p):
        name = p.getClass().getSimpleName()
        inner = p.executedPlan() if name == "AdaptiveSparkPlanExec" else p.plan() if name.endswith("QueryStageExec") else None
        below = [inner] if inner else [p.children().apply(k) for k in range(p.children().size())]
        return (p.metrics().apply("numOutputRows").value() if name == kind else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_asof_and_interpolation(spark):
    right = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 20, 3.0, 3)], "k string, t int, x double, id int")
    left = spark.createDataFrame([("a", 9, "p"), ("a", 10, "q"), ("a", 15, "r"), ("b", 5, "s")], "k string, t int, tag string")
    got = {r.tag: (r.x, r.age) for r in asof.asof_backward(left, right, "k", "t", ["x"], "id").collect()}
    assert got == {"p": (None, None), "q": (2.0, 0), "r": (2.0, 5), "s": (None, None)}
    i = asof.interpolate_at(right.where("id <> 1"), left.where("k = 'a'"), "k", "t", "x").collect()
    assert {r.tag: r.interpolated for r in i} == {"p": 2.0, "q": 2.0, "r": 2.5}


def test_gate(spark):
    df = spark.range(3)
    assert eventstudy.gate(df, "id > 5", "g").count() == 3
    with pytest.raises(eventstudy.GateFailed):
        eventstudy.gate(df, "id > 1", "g")


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2026-01-01"), (2, "b", "2026-01-02")], "id int, v string, created_time string")
    io.append_by_date(df, f"{tmp_path}/d")
    assert io.dated(spark, f"{tmp_path}/d", ["2026-01-02"]).count() == 1
    assert io.parquet_tree(spark, f"{tmp_path}/d").count() == 2
    io.publish(spark, df, f"{tmp_path}/p", "1")
    io.publish(spark, df.limit(1), f"{tmp_path}/p", "2")
    assert io.current(spark, f"{tmp_path}/p").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        io.publish(spark, df, f"{tmp_path}/p", "2")
    io.one_csv(df, f"{tmp_path}/c")
    assert io.csv(spark, f"{tmp_path}/c", "id int, v string, created_time string").count() == 2
    (tmp_path / "j.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert io.json_lines(spark, f"{tmp_path}/j.json", "a int").where("a is not null").count() == 2
    match.replace_partition(spark, f"{tmp_path}/r", df, "v")
    match.replace_partition(spark, f"{tmp_path}/r", df.where("v = 'a'"), "v")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    assert io.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | a | 2026-01-01 |" and "tabular" in io.latex(df)


def test_paged_source(spark, tmp_path):
    for m in ("A", "B"):
        (tmp_path / f"{m}.0.json").write_text(json.dumps({"trades": [{"trade_id": f"{m}1", "ticker": m}], "cursor": "1"}))
        (tmp_path / f"{m}.1.json").write_text(json.dumps({"trades": [{"trade_id": f"{m}2", "count_fp": 3}]}))
    spark.dataSource.register(io.PagedTrades)
    got = spark.read.format("paged_trades").option("path", str(tmp_path)).option("markets", "A,B").load().collect()
    assert sorted(r.trade_id for r in got) == ["A1", "A2", "B1", "B2"]


def test_retry_waits_longer():
    waits, answers = [], [(429, ""), (429, ""), (200, "x")]
    assert io.Retry(sleep=waits.append)(lambda: answers.pop(0)) == "x" and waits == [0.5, 1.0]


def test_gap_alerts_stream(spark, tmp_path):
    from tapelight.streaming import live

    spark.createDataFrame([("f", 1, 0.06), ("f", 2, 0.03), ("f", 3, 0.01), ("g", 1, 0.01)], "fight string, t bigint, gap double").write.parquet(f"{tmp_path}/in")
    s = live.follow(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = {tuple(r) for r in live.drain(live.gap_alerts(s, "fight", "t", "gap"), "append").collect()}
    assert got == {("f", 1, None, "open"), ("f", 1, 3, "close")}


def test_offset_pages_headers_and_candles(spark):
    import base64
    import json

    from tapelight.sources import io

    data = [{"id": k} for k in range(7)]
    asked = []
    fetch = lambda at: asked.append(at) or (200, json.dumps(data[at : at + 3]))
    assert list(io.offset_pages(fetch, io.Retry(), 3)) == data and asked == [0, 3, 6]
    assert [x["id"] for x in io.offset_pages(fetch, io.Retry(), 3, until=lambda x: x["id"] == 4)] == [0, 1, 2, 3]
    h = io.signed(lambda b: b[::-1], "k", "get", "/trades?cursor=1", 5)
    assert h["ACCESS-TIMESTAMP"] == "5" and base64.b64decode(h["ACCESS-SIGNATURE"]) == b"5GET/trades"[::-1]
    answer = {"market_ticker": "M", "candlesticks": [{"end_period_ts": 86400, "yes_bid": {"open": 0.1, "close": 0.2}, "price": {"high": 0.5}, "volume": 3}]}
    r = io.candles(spark.createDataFrame([(json.dumps(answer),), (None,), ("{}",)], "payload string")).collect()
    assert len(r) == 1 and (r[0].market_ticker, r[0].yes_bid_open, r[0].yes_bid_close, r[0].yes_ask_open, r[0].price_high, r[0].volume, r[0].open_interest) == ("M", 0.1, 0.2, None, 0.5, 3, None)
