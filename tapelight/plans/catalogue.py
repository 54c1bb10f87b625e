"""The registered queries of the analytics operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelight.functions import text as X
from tapelight.operators import asof, bars, eventstudy, ladders, match, stats
from tapelight.sources import io
from tapelight.sources.fixtures import LADDER_SQL, TAPE_SQL, ladder, tape
from tapelight.sources.tables import table
from tapelight.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOUR, COARSE = 3600, 21600


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- shared SQL ---------------------------------------------------------------
_OFI = TAPE_SQL + """, bars AS (SELECT ticker, t - t % 3600 AS bar, sum(CASE WHEN taker_side='yes' THEN size ELSE -size END) AS ofi, sum(size) AS total,
  arg_max(price, (t, trade_id)) AS last, count(*) AS n, max(price) AS high, min(price) AS low FROM tape GROUP BY ALL)"""
_RET = _OFI + """, ret AS (SELECT *, last - lag(last) OVER w AS dp_contemp, lead(last) OVER w - last AS dp_1, lead(last,2) OVER w - lead(last) OVER w AS dp_2,
  lead(last,3) OVER w - lead(last,2) OVER w AS dp_3, CAST(epoch_ms(bar*1000) AS DATE) AS card FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar)),
 z AS (SELECT *, (ofi - avg(ofi) OVER p) / nullif(stddev_samp(ofi) OVER p, 0) AS ofi_z, sum(total) OVER (PARTITION BY ticker ORDER BY bar RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS vol_6h FROM ret WINDOW p AS (PARTITION BY ticker))"""
_QUINT = _RET + """, e AS (SELECT quantile_cont(ofi_z, 0.2) a, quantile_cont(ofi_z, 0.4) b, quantile_cont(ofi_z, 0.6) c, quantile_cont(ofi_z, 0.8) d FROM z WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL),
 q AS (SELECT z.*, 1 + (ofi_z>a)::INT + (ofi_z>b)::INT + (ofi_z>c)::INT + (ofi_z>d)::INT AS q FROM z, e WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL)"""
_VENUE = TAPE_SQL + """, vb AS (SELECT venue, fight, t - t % 3600 AS bar, count(price) AS n, arg_max(price, (t, trade_id)) AS last, sum(price*size)/nullif(sum(size),0) AS vwap, sum(size) AS vol FROM tape GROUP BY ALL),
 k AS (SELECT * FROM vb WHERE venue='K'), p AS (SELECT * FROM vb WHERE venue='P')"""
_PANEL = _VENUE + """, ends AS (SELECT fight, min(bar) lo, max(bar) hi FROM vb GROUP BY fight HAVING count(DISTINCT venue)=2),
 grid AS (SELECT fight, unnest(generate_series(lo, hi, 3600)) AS bar FROM ends),
 g AS (SELECT grid.fight, grid.bar, k.last kl, k.vwap kw, k.vol kv, k.n kn, p.last pl, p.vwap pw, p.vol pv, p.n pn FROM grid LEFT JOIN k USING (fight, bar) LEFT JOIN p USING (fight, bar)),
 f AS (SELECT *, last_value(kl IGNORE NULLS) OVER w AS kf, last_value(pl IGNORE NULLS) OVER w AS pf FROM g WINDOW w AS (PARTITION BY fight ORDER BY bar ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
 panel AS (SELECT fight, bar, kf AS k_last, kw AS k_vwap, coalesce(kv,0) AS k_vol, coalesce(kn,0) AS k_n, kl IS NULL AND kf IS NOT NULL AS k_stale, pf AS pm_last, pw AS pm_vwap, coalesce(pv,0) AS pm_vol,
   coalesce(pn,0) AS pm_n, pl IS NULL AND pf IS NOT NULL AS pm_stale, coalesce(kn,0)>0 AND coalesce(pn,0)>0 AS both_traded FROM f WHERE kf IS NOT NULL OR pf IS NOT NULL)"""
_CO = _PANEL + """, co AS (SELECT *, k_last - lag(k_last) OVER w AS dk, pm_last - lag(pm_last) OVER w AS dp, CAST(year(CAST(epoch_ms(bar*1000) AS TIMESTAMP))*100 + month(CAST(epoch_ms(bar*1000) AS TIMESTAMP)) AS VARCHAR) || CASE WHEN day(CAST(epoch_ms(bar*1000) AS TIMESTAMP)) <= 15 THEN 'a' ELSE 'b' END AS era FROM panel WHERE both_traded WINDOW w AS (PARTITION BY fight ORDER BY bar))"""


def _ofi(spark: SparkSession, sf: str) -> DataFrame:
    return bars.ofi_bars(tape(spark, sf), ["ticker"], HOUR)


def _ret(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.forward_returns(_ofi(spark, sf), steps=3)
    b = b.withColumn("card", F.to_date(F.timestamp_seconds("bar")))
    return bars.rolling_sum(bars.zscore(b, "ofi", "ofi_z"), "total", 6 * HOUR, "vol_6h")


def _venue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = tape(spark, sf)
    return tuple(bars.make_bars(t.where(F.col("venue") == v), ["fight"], HOUR) for v in "KP")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return bars.panel(*_venue(spark, sf), HOUR)


def _co(spark: SparkSession, sf: str) -> DataFrame:
    at = F.timestamp_seconds("bar")
    era = F.concat(F.date_format(at, "yyyyMM"), F.when(F.dayofmonth(at) <= 15, "a").otherwise("b"))
    return eventstudy.returns(_panel(spark, sf)).withColumn("era", era)


# -- bars and order flow ------------------------------------------------------
@query("WITH " + TAPE_SQL + " SELECT ticker, t - t % 3600 AS bar, count(price) AS n, round(arg_max(price,(t,trade_id)),6) AS last, round(sum(price*size)/nullif(sum(size),0),6) AS vwap, round(sum(size),6) AS vol FROM tape GROUP BY ALL")
def q01_bars_vwap(spark, sf):
    return rounded(bars.make_bars(tape(spark, sf), ["ticker"], HOUR), "last", "vwap", "vol")


@query("WITH " + _OFI + " SELECT ticker, bar, round(ofi,6) AS ofi, round(total,6) AS total, round(last,6) AS last, n, round(high,6) AS high, round(low,6) AS low, round(high-low,6) AS span FROM bars")
def q02_ofi_bars(spark, sf):
    return rounded(_ofi(spark, sf), "ofi", "total", "last", "high", "low", "span")


@query("WITH " + TAPE_SQL + ", c AS (SELECT ticker, quantile_cont(size, 0.9) cut FROM tape GROUP BY ticker) SELECT ticker, t - t % 3600 AS bar, round(sum(CASE WHEN size>=cut THEN CASE WHEN taker_side='yes' THEN size ELSE -size END ELSE 0 END),6) AS ofi_large, count_if(size>=cut)::BIGINT AS n_large FROM tape JOIN c USING (ticker) GROUP BY ALL")
def q03_large_ofi(spark, sf):
    return rounded(bars.ofi_bars(tape(spark, sf), ["ticker"], HOUR, large=0.9), "ofi_large").select("ticker", "bar", "ofi_large", "n_large")


@query("WITH " + _RET + " SELECT ticker, bar, round(dp_contemp,6) AS dp_contemp, round(dp_1,6) AS dp_1, round(dp_2,6) AS dp_2, round(dp_1+dp_2,6) AS cum_2 FROM z")
def q04_forward_returns(spark, sf):
    return rounded(_ret(spark, sf), "dp_contemp", "dp_1", "dp_2", "cum_2").select("ticker", "bar", "dp_contemp", "dp_1", "dp_2", "cum_2")


@query("WITH " + _RET + " SELECT ticker, bar, round(vol_6h,4) AS vol_6h FROM z")
def q05_rolling_6h_volume(spark, sf):
    return rounded(_ret(spark, sf), "vol_6h", digits=4).select("ticker", "bar", "vol_6h")


@query("WITH " + _RET + " SELECT ticker, bar, round(ofi_z,6) AS ofi_z, round(ofi/nullif(vol_6h,0),6) AS ofi_vol FROM z")
def q06_zscore_volscale(spark, sf):
    return _ret(spark, sf).select("ticker", "bar", F.round("ofi_z", 6).alias("ofi_z"), F.round(F.col("ofi") / F.nullif("vol_6h", F.lit(0.0)), 6).alias("ofi_vol"))


@query("WITH " + _QUINT + " SELECT q, count(*) AS n, round(avg(ofi_z),6) AS mean_x, round(avg(dp_1),6) AS mean_y FROM q GROUP BY q")
def q07_quintile_means(spark, sf):
    return rounded(stats.quintile_table(_ret(spark, sf), "ofi_z", "dp_1"), "mean_x", "mean_y")


@query("WITH " + _QUINT + ", s AS (SELECT card, avg(dp_1) FILTER (q=5) - avg(dp_1) FILTER (q=1) AS s FROM q GROUP BY card) SELECT count(s) AS groups, round(avg(s),6) AS spread, round(stddev_samp(s)/sqrt(count(s)),6) AS se, round(avg(s)/(stddev_samp(s)/sqrt(count(s))),4) AS t FROM s WHERE s IS NOT NULL")
def q08_quintile_card_spread(spark, sf):
    return rounded(rounded(stats.group_spread(_ret(spark, sf), "ofi_z", "dp_1", "card"), "spread", "se"), "t", digits=4)


_FE = ", d AS (SELECT *, ofi_z - avg(ofi_z) OVER w AS xd, {y} - avg({y}) OVER w AS yd FROM z WHERE ofi_z IS NOT NULL AND {y} IS NOT NULL WINDOW w AS (PARTITION BY ticker)), b AS (SELECT sum(xd*yd)/sum(xx) AS beta, sum(xx) AS sxx, count(*) AS n FROM (SELECT *, xd*xd AS xx FROM d)), s AS (SELECT card, sum(xd*(yd-beta*xd)) AS sc FROM d, b GROUP BY card)"
_FE_OUT = "SELECT any_value(n) AS n, count(*) AS clusters, round(any_value(beta),8) AS beta, round(sqrt(sum(sc*sc)*count(*)/(count(*)-1))/any_value(sxx),8) AS se FROM s, b"


@query("WITH " + _RET + _FE.format(y="dp_1") + _FE_OUT)
def q09_fe_ols_cluster(spark, sf):
    return rounded(stats.fe_ols(_ret(spark, sf), "ofi_z", "dp_1", "ticker", "card").drop("t"), "beta", "se", digits=8)


@query("WITH " + _RET + """, d AS (SELECT ofi_z AS x, dp_1 AS y, card FROM z WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL), m AS (SELECT avg(x) mx, avg(y) my, count(*) n FROM d),
 b AS (SELECT sum((x-mx)*(y-my))/sum((x-mx)*(x-mx)) AS beta, sum((x-mx)*(x-mx)) AS sxx FROM d, m), s AS (SELECT card, sum((x-mx)*((y-my)-beta*(x-mx))) AS sc FROM d, m, b GROUP BY card)
 SELECT any_value(n) AS n, count(*) AS clusters, round(any_value(beta),8) AS beta, round(any_value(my - beta*mx),8) AS intercept, round(sqrt(sum(sc*sc)*count(*)/(count(*)-1)*any_value(n)/(any_value(n)-2))/any_value(sxx),8) AS se FROM s, b, m""")
def q10_pooled_ols_cluster(spark, sf):
    return rounded(stats.pooled_ols(_ret(spark, sf), "ofi_z", "dp_1", "card"), "beta", "intercept", "se", digits=8)


@query("WITH " + _RET + """, d AS (SELECT ticker, ofi_z AS x, dp_1 AS y FROM z WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL), c AS (SELECT ticker, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY ticker)),
 b AS (SELECT *, sum(u*u) OVER w AS s, sum(u*v) OVER w / sum(u*u) OVER w AS b FROM c WINDOW w AS (PARTITION BY ticker)) SELECT ticker, max(n) AS n, round(max(b),8) AS beta, round(sqrt(sum(power((v-b*u)/(1-1.0/n-u*u/s),2)*u*u))/max(s),8) AS se FROM b GROUP BY ticker""")
def q11_hc3_regression(spark, sf):
    return rounded(stats.hc3(_ret(spark, sf), "ofi_z", "dp_1", ["ticker"]), "beta", "se", digits=8)


@query("WITH " + _RET + ", l AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, ticker, card, ofi_z AS x, dp_{k} AS y FROM z" for k in (1, 2, 3)) + """), d AS (SELECT lag, card, x - avg(x) OVER w AS xd, y - avg(y) OVER w AS yd FROM l WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY lag, ticker))
 SELECT lag, count(*) AS n, round(sum(xd*yd)/sum(xd*xd),8) AS beta FROM d GROUP BY lag""")
def q12_lag_structure(spark, sf):
    r = _ret(spark, sf)
    long = r.select("ticker", "card", F.col("ofi_z").alias("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"dp_{k}").alias("y")) for k in (1, 2, 3)])).alias("e")).select("ticker", "x", "e.*").where("x is not null and y is not null")
    w = Window.partitionBy("lag", "ticker")
    d = long.select("lag", (F.col("x") - F.avg("x").over(w)).alias("xd"), (F.col("y") - F.avg("y").over(w)).alias("yd"))
    return d.groupBy("lag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("xd") * F.col("yd")) / F.sum(F.col("xd") * F.col("xd")), 8).alias("beta"))


@query("WITH " + _OFI + ", d AS (SELECT ticker, bar, last - lag(last) OVER w AS d FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar)), l AS (SELECT *, lag(d) OVER (PARTITION BY ticker ORDER BY bar) AS l FROM d) SELECT ticker, count(*) AS n, round(covar_samp(d,l),8) AS cov, round(2*sqrt(greatest(0,-covar_samp(d,l))),6) AS spread FROM l WHERE d IS NOT NULL AND l IS NOT NULL GROUP BY ticker HAVING count(*)>=6")
def q13_roll_spread(spark, sf):
    return rounded(rounded(stats.roll_spread(_ofi(spark, sf)), "cov", digits=8), "spread")


@query("WITH " + _RET + ", v AS (SELECT ticker, sum(n) AS trades FROM z GROUP BY ticker), m AS (SELECT median(trades) AS m FROM v), d AS (SELECT CASE WHEN trades < m THEN 'thin' ELSE 'thick' END AS side, ofi_z, dp_1 FROM z JOIN v USING (ticker), m WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL) SELECT side, count(*) AS n, round(corr(ofi_z, dp_1),6) AS rho FROM d GROUP BY side")
def q14_liquidity_split(spark, sf):
    r = _ret(spark, sf)
    v = r.groupBy("ticker").agg(F.sum("n").alias("trades"))
    m = v.agg(F.percentile("trades", F.lit(0.5)).alias("m"))
    v = v.crossJoin(F.broadcast(m)).select("ticker", F.when(F.col("trades") < F.col("m"), "thin").otherwise("thick").alias("side"))  # m is one row
    return r.where("ofi_z is not null and dp_1 is not null").join(v, "ticker").groupBy("side").agg(F.count("*").alias("n"), F.round(F.corr("ofi_z", "dp_1"), 6).alias("rho"))


# -- panels -------------------------------------------------------------------
@query("WITH " + _PANEL + " SELECT fight, bar, round(k_last,6) AS k_last, round(k_vwap,6) AS k_vwap, round(k_vol,6) AS k_vol, k_n, k_stale, round(pm_last,6) AS pm_last, round(pm_vwap,6) AS pm_vwap, round(pm_vol,6) AS pm_vol, pm_n, pm_stale, both_traded FROM panel")
def q15_panel_ffill(spark, sf):
    return rounded(_panel(spark, sf), "k_last", "k_vwap", "k_vol", "pm_last", "pm_vwap", "pm_vol")


@query("WITH " + _PANEL + " SELECT fight, count(*) AS n_bars, count_if(both_traded)::BIGINT AS both_bars, round(100.0*count_if(both_traded)/count(*),6) AS both_pct, sum(k_n)::BIGINT AS k_trades, sum(pm_n)::BIGINT AS pm_trades, min(bar) AS first_bar, max(bar) AS last_bar FROM panel GROUP BY fight")
def q16_coverage(spark, sf):
    return _panel(spark, sf).groupBy("fight").agg(F.count("*").alias("n_bars"), F.count_if("both_traded").alias("both_bars"), F.round(100.0 * F.count_if("both_traded") / F.count("*"), 6).alias("both_pct"), F.sum("k_n").alias("k_trades"), F.sum("pm_n").alias("pm_trades"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("WITH " + _PANEL + ", r AS (SELECT fight, bar - bar % 21600 AS bar, arg_max(k_last, bar) FILTER (k_last IS NOT NULL) AS k_last, arg_max(pm_last, bar) FILTER (pm_last IS NOT NULL) AS pm_last, sum(k_n)::BIGINT AS k_n, sum(pm_n)::BIGINT AS pm_n FROM panel GROUP BY fight, bar - bar % 21600) SELECT fight, bar, round(k_last,6) AS k_last, round(pm_last,6) AS pm_last, k_n, pm_n FROM r WHERE k_n>0 AND pm_n>0")
def q17_resample_coactive(spark, sf):
    r = bars.resample(_panel(spark, sf), ["fight"], COARSE, ["k_last", "pm_last"], ["k_n", "pm_n"]).where("k_n > 0 and pm_n > 0")
    return rounded(r, "k_last", "pm_last").select("fight", "bar", "k_last", "pm_last", "k_n", "pm_n")


_LAGS = (-3, -2, -1, 0, 1, 2, 3)


@query("WITH " + _CO + ", c AS (SELECT * FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT fight, {k} AS lag, dk, {'lead' if k >= 0 else 'lag'}(dp, {abs(k)}) OVER (PARTITION BY fight ORDER BY bar) AS v FROM c" for k in _LAGS) + """),
 e AS (SELECT fight, lag, count(*) n, corr(dk,v) rho, stddev_samp(dk) s1, stddev_samp(v) s2 FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT lag, count(*) AS entities, round(tanh(avg(atanh(greatest(-0.9999,least(0.9999,rho))))),6) AS rho FROM e WHERE n>=15 AND s1>=1e-12 AND s2>=1e-12 GROUP BY lag""")
def q18_ccf_by_lag(spark, sf):
    return rounded(eventstudy.ccf(_co(spark, sf), _LAGS), "rho")


@query("WITH " + _CO + """, m AS (SELECT era, 'K->P' AS dir, dk AS a, dp AS b FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL UNION ALL SELECT era, 'P->K', dp, dk FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL),
 x AS (SELECT dir, thr, era, sign(a)*b AS s FROM m, (VALUES (0.03),(0.05)) v(thr) WHERE abs(a)>=thr) SELECT dir, CAST(thr AS DOUBLE) AS thr, coalesce(era,'all') AS era, count(*) AS n, count_if(s>0)::BIGINT AS same_n, count_if(s=0)::BIGINT AS zero_n, count_if(s<0)::BIGINT AS opp_n FROM x GROUP BY GROUPING SETS ((dir,thr,era),(dir,thr))""")
def q19_three_bucket_grouping_sets(spark, sf):
    return eventstudy.three_buckets(_co(spark, sf), (0.03, 0.05))


@query("WITH " + _CO + " SELECT count_if(abs(dk)>=0.05 OR abs(dp)>=0.05)::BIGINT AS either, count_if(abs(dk)>=0.05 AND abs(dp)>=0.05)::BIGINT AS both, round(avg(sign(dk)*sign(dp)) FILTER (abs(dk)>=0.05 AND abs(dp)>=0.05),6) AS mean_aligned, round(median(abs(dp)) FILTER (abs(dk)>=0.05),6) AS median_response, round(avg(abs(dp)),6) AS baseline FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL")
def q20_cojump_table(spark, sf):
    return rounded(eventstudy.cojumps(_co(spark, sf), 0.05), "mean_aligned", "median_response", "baseline")


@query("WITH " + _CO + """, w AS (SELECT *, lag(k_last) OVER o AS bf, lead(k_last,3) OVER o AS af, sum(dp) OVER n AS resp, count(*) OVER n AS rows_, count(dp) OVER n AS have FROM co WINDOW o AS (PARTITION BY fight ORDER BY bar), n AS (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 j AS (SELECT CASE WHEN (af-bf)/dk >= 0.5 THEN 'persistent' ELSE 'transient' END AS kind, sign(dk)*resp AS s FROM w WHERE abs(dk)>=0.03 AND af IS NOT NULL AND rows_=3 AND have>=1) SELECT kind, count(*) AS n, round(avg(s),6) AS response, round(avg((s>0)::INT),6) AS share_same FROM j GROUP BY kind""")
def q21_propagation(spark, sf):
    return rounded(eventstudy.propagation(_co(spark, sf), 0.03, 3), "response", "share_same")


def boot_sql(per: str, groups: str, order: str, v: str, w: str = "1", reps: int = 200, seed: int = 42, name: str = "b", median: bool = False) -> str:
    """CTEs {name}s (replications s) and {name}i (lo, hi) over clusters drawn by md5."""
    g, of = (f"{groups}, ", f"PARTITION BY {groups}") if groups else ("", "")
    what = "median(v)" if median else "sum(v)/sum(CASE WHEN v IS NOT NULL THEN w END)"
    return f""", {name}o AS (SELECT {g}{v} AS v, {w} AS w, row_number() OVER ({of} ORDER BY {order})-1 AS pos, count(*) OVER ({of}) AS n FROM {per}),
 {name}d AS (SELECT {g}rep, ('0x'||substr(md5(rep||'|'||pos||'|{seed}'),1,8))::BIGINT % n AS pos FROM {name}o, (SELECT unnest(range({reps})) rep)),
 {name}s AS (SELECT {g}rep, {what} AS s FROM {name}d JOIN {name}o USING ({g}pos) GROUP BY ALL), {name}i AS (SELECT {g}quantile_cont(s,0.025) AS lo, quantile_cont(s,0.975) AS hi FROM {name}s {"GROUP BY " + groups if groups else ""})"""


def moves_sql(lead: str, horizons: tuple[int, ...], hold: int, thr: float) -> str:
    """CTE m_{lead}(fight, bar, kind, horizon, response) from co."""
    a, b, px = ("dk", "dp", "k_last") if lead == "k" else ("dp", "dk", "pm_last")
    far = [h for h in horizons if h]
    cols = ", ".join(f"CASE WHEN count(*) OVER n{h} = {h} AND count({b}) OVER n{h} >= {max(1, h // 2)} THEN sum({b}) OVER n{h} END AS h{h}" for h in far)
    wins = ", ".join(f"n{h} AS (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in far)
    each = " UNION ALL ".join(f"SELECT fight, bar, kind, {h} AS horizon, s*{f'h{h}' if h else b} AS response FROM j_{lead}" for h in horizons)
    return f""", w_{lead} AS (SELECT *, lag({px}) OVER o AS bf, lead({px},{hold}) OVER o AS af, {cols} FROM co WINDOW o AS (PARTITION BY fight ORDER BY bar), {wins}),
 j_{lead} AS (SELECT *, sign({a}) AS s, CASE WHEN sign({a})*(af-bf) >= 0.5*abs({a}) THEN 'persistent' ELSE 'transient' END AS kind FROM w_{lead} WHERE abs({a})>={thr} AND bf IS NOT NULL AND af IS NOT NULL), m_{lead} AS ({each})"""


@query("WITH " + _CO + moves_sql("k", (0, 1, 3), 3, 0.03) + """, pr AS (SELECT fight, horizon, avg(response) FILTER (kind='persistent') - avg(response) FILTER (kind='transient') AS diff FROM m_k GROUP BY ALL),
 per AS (SELECT f.fight, h.horizon, pr.diff FROM (SELECT DISTINCT fight FROM co) f CROSS JOIN (VALUES (0),(1),(3)) h(horizon) LEFT JOIN pr ON pr.fight=f.fight AND pr.horizon=h.horizon)""" + boot_sql("per", "horizon", "fight", "diff")
 + " SELECT horizon, count(diff) AS entities, round(avg(diff),6) AS diff, round(any_value(lo),6) AS lo, round(any_value(hi),6) AS hi FROM per JOIN bi USING (horizon) GROUP BY horizon")
def q22_contrast_paired(spark, sf):
    """Response to persistent minus to transient jumps, paired by fight, with its interval."""
    return rounded(eventstudy.contrast(_co(spark, sf), 0.03, (0, 1, 3), 3), "diff", "lo", "hi")


@query("WITH " + TAPE_SQL + """, c AS (SELECT card, sum(price) v, count(*) w FROM tape GROUP BY card), o AS (SELECT *, row_number() OVER (ORDER BY card)-1 AS pos, count(*) OVER () AS n FROM c),
 d AS (SELECT rep, ('0x'||substr(md5(rep||'|'||slot||'|42'),1,8))::BIGINT % n AS pos FROM (SELECT count(*) n FROM c), LATERAL (SELECT unnest(range(200)) rep), LATERAL (SELECT unnest(range(n)) slot)),
 s AS (SELECT rep, sum(v)/sum(w) s FROM d JOIN o USING (pos) GROUP BY rep) SELECT round((SELECT sum(v)/sum(w) FROM c),6) AS point, (SELECT count(*) FROM c) AS n, round(quantile_cont(s,0.025),6) AS lo, round(quantile_cont(s,0.975),6) AS hi FROM s""")
def q23_hash_bootstrap_ci(spark, sf):
    per = tape(spark, sf).groupBy("card").agg(F.sum("price").alias("v"), F.count("*").alias("w"))
    return rounded(stats.hash_bootstrap(per, "v", "w", "card"), "point", "lo", "hi")


_GAPS = _PANEL + """, ga AS (SELECT *, round(abs(k_last-pm_last),9) AS gap FROM panel WHERE k_last IS NOT NULL AND pm_last IS NOT NULL),
 gb AS (SELECT *, gap<=0.02 AS c, gap>=0.05 AND (lag(gap) OVER w IS NULL OR lag(gap) OVER w < 0.05) AS o, coalesce(sum((gap<=0.02)::INT) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS seg FROM ga WINDOW w AS (PARTITION BY fight ORDER BY bar)),
 gc AS (SELECT *, min(bar) FILTER (o) OVER (PARTITION BY fight, seg) AS start FROM gb),
 ep AS (SELECT fight, start, max(bar) FILTER (c) AS "end", (max(bar) FILTER (c) - start)/60.0 AS duration_min, max(bar) FILTER (c) IS NULL AS censored, CASE WHEN max(k_n)>0 AND max(pm_n)>0 THEN 'ACTIVE' ELSE 'STALE-SIDE' END AS kind, max(gap) AS widest FROM gc WHERE bar>=start GROUP BY fight, seg, start)"""


@query("WITH " + _GAPS + ' SELECT fight, start, "end", round(duration_min,6) AS duration_min, censored, kind, round(widest,6) AS widest FROM ep')
def q24_gap_episodes(spark, sf):
    return rounded(eventstudy.gap_episodes(_panel(spark, sf)), "duration_min", "widest")


@query("WITH " + _GAPS + " SELECT kind, count(*) AS episodes, count_if(censored)::BIGINT AS open_n, round(median(duration_min),6) AS median_min, round(avg((duration_min<=120)::INT) FILTER (NOT censored),6) AS share_short FROM ep GROUP BY kind")
def q25_episode_summary(spark, sf):
    e = eventstudy.gap_episodes(_panel(spark, sf))
    return e.groupBy("kind").agg(F.count("*").alias("episodes"), F.count_if("censored").alias("open_n"), F.round(F.percentile("duration_min", F.lit(0.5)), 6).alias("median_min"), F.round(F.avg(F.when(~F.col("censored"), (F.col("duration_min") <= 120).cast("int"))), 6).alias("share_short"))


@query("WITH " + TAPE_SQL + ", v AS (SELECT ticker, sum(size) vol FROM tape GROUP BY ticker), q AS (SELECT quantile_cont(vol,0.9) q FROM v) SELECT ticker, round(vol,4) AS vol, CASE WHEN vol>=q THEN 'main' ELSE 'undercard' END AS tier, row_number() OVER (ORDER BY vol DESC, ticker) AS rank FROM v, q")
def q26_tier_top_decile(spark, sf):
    v = tape(spark, sf).groupBy("ticker").agg(F.sum("size").alias("vol"))
    d = v.crossJoin(F.broadcast(stats.percentiles(v, "vol", [0.9])))  # one row
    d = stats.ranked(d, [F.desc("vol"), F.col("ticker")])
    return d.select("ticker", F.round("vol", 4).alias("vol"), F.when(F.col("vol") >= F.col("p")[0], "main").otherwise("undercard").alias("tier"), "rank")


@query("WITH " + TAPE_SQL + ", v AS (SELECT fight, CASE WHEN day(card)<=15 THEN 1 ELSE 2 END AS era, count(*) n FROM tape WHERE venue='P' GROUP BY ALL), m AS (SELECT median(n) FILTER (era=1) a, median(n) FILTER (era=2) b FROM v) SELECT a AS median_1, b AS median_2, round(b/a,6) AS ratio, b/a BETWEEN 0.4 AND 1.0 AS passed FROM m")
def q27_depth_fragmentation(spark, sf):
    v = tape(spark, sf).where("venue = 'P'").groupBy("fight", F.when(F.dayofmonth("card") <= 15, 1).otherwise(2).alias("era")).agg(F.count("*").alias("n"))
    med = lambda e: F.percentile(F.when(F.col("era") == e, F.col("n")), F.lit(0.5))
    return v.agg(med(1).alias("median_1"), med(2).alias("median_2")).withColumn("ratio", F.round(F.col("median_2") / F.col("median_1"), 6)).withColumn("passed", (F.col("median_2") / F.col("median_1")).between(0.4, 1.0))


@query("WITH " + _PANEL + ", a AS (SELECT fight, count(*) n, avg(abs(k_last-pm_last)) mad, avg(abs(k_last-(1-pm_last))) mf FROM panel WHERE both_traded GROUP BY fight HAVING count(*)>=20) SELECT fight, n, round(mad,6) AS mad, round(mf,6) AS mad_flip, mf<mad AND mad>0.1 AS flag FROM a")
def q28_side_audit_mad(spark, sf):
    return rounded(eventstudy.side_audit(_panel(spark, sf)), "mad", "mad_flip")


@query("WITH " + _VENUE + ", j AS (SELECT fight, count(*) n, avg(abs(k.vwap-p.vwap)) mad FROM k JOIN p USING (fight, bar) GROUP BY fight), c AS (SELECT fight, sum(n) FILTER (venue='K') a, sum(n) FILTER (venue='P') b FROM vb GROUP BY fight) SELECT fight, n, round(mad,6) AS mad, round(b*1.0/a,6) AS ratio, b*1.0/a BETWEEN 0.98 AND 1.02 AND mad<0.01 AS passed FROM j JOIN c USING (fight)")
def q29_vwap_mad_two_sources(spark, sf):
    k, p = _venue(spark, sf)
    j = k.select("fight", "bar", F.col("vwap").alias("a")).join(p.select("fight", "bar", F.col("vwap").alias("b")), ["fight", "bar"]).groupBy("fight").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mad"))
    c = k.groupBy("fight").agg(F.sum("n").alias("ka")).join(p.groupBy("fight").agg(F.sum("n").alias("pb")), "fight")
    return rounded(match.stop_gate(j.join(c, "fight").withColumn("ratio", F.col("pb") / F.col("ka"))), "mad", "ratio").select("fight", "n", "mad", "ratio", "passed")


# -- entity resolution --------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _sql_tokens(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents({c})),'[^a-z ]','','g'),' +',' ','g')),' '), lambda x: length(x)>=3 AND x NOT IN ({_STOP}))))"


@query(f"""WITH a AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS da, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS db, o_orderkey AS okey, o_totalprice AS oprice FROM orders WHERE o_orderpriority LIKE '5%'),
 j AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(da-db), oprice DESC, okey) AS rn FROM a JOIN b USING (cust) WHERE db BETWEEN da-30 AND da+30) SELECT o_orderkey, okey, abs(da-db)::INT AS apart FROM j WHERE rn=1""")
def q30_band_join_top1(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice", "o_orderpriority")
    a = o.where(F.col("o_orderpriority").startswith("1")).select("cust", F.col("d").alias("da"), "o_orderkey")
    b = o.where(F.col("o_orderpriority").startswith("5")).select("cust", F.col("d").alias("db"), F.col("o_orderkey").alias("okey"), F.col("o_totalprice").alias("oprice"))
    j = asof.band_join(a, b, "da", "db", 30, ["cust"]).withColumn("apart", F.abs(F.datediff("da", "db")))
    return match.first_per(j, ["o_orderkey"], [F.col("apart"), F.desc("oprice"), F.col("okey")]).select("o_orderkey", "okey", "apart")


@query("""WITH o AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REMAP' ELSE 'REJECT' END AS action, 'Brand#99' AS correct FROM part WHERE p_partkey % 10 < 3)
 SELECT p_partkey, CASE action WHEN 'REJECT' THEN NULL WHEN 'REMAP' THEN correct ELSE p_brand END AS p_brand, coalesce(action,'AUTO') AS decision FROM part LEFT JOIN o USING (p_partkey)""")
def q31_override_merge(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey") % 10
    o = p.where(k < 3).select("p_partkey", F.when(k == 0, "ACCEPT").when(k == 1, "REMAP").otherwise("REJECT").alias("action"), F.lit("Brand#99").alias("correct"))
    return match.overridden(p, o, "p_partkey", "p_brand")


@query(f"""WITH n AS (SELECT fight_id, {_sql_tokens('fighters_kalshi[1]')} AS a, {_sql_tokens('fighters_kalshi[2]')} AS b FROM fights_k WHERE len(fighters_kalshi)=2) SELECT fight_id, array_to_string(a,' ') AS a, array_to_string(b,' ') AS b, len(list_intersect(a,b))::INT AS overlap FROM n""")
def q32_name_norm_overlap(spark, sf):
    f = table(spark, sf, "fights_k").where(F.size("fighters_kalshi") == 2)
    d = f.select("fight_id", X.name_tokens(F.col("fighters_kalshi")[0]).alias("a"), X.name_tokens(F.col("fighters_kalshi")[1]).alias("b"))
    return d.select("fight_id", F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"), X.overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(r"""WITH t AS (SELECT ticker, regexp_extract(ticker,'^([A-Z]+)-(\d{2})([A-Z]{3})(\d{2})([A-Z0-9]*)-([A-Z0-9.]+)$',['s','y','m','d','f','g']) AS p FROM markets_k)
 SELECT ticker, nullif(p.s,'') AS series, try_strptime(p.y||p.m||p.d,'%y%b%d')::DATE AS day, nullif(p.f,'') AS fight, nullif(p.g,'') AS fighter, regexp_extract(ticker,'^(.*)-[^-]*$',1) AS event FROM t""")
def q33_ticker_parse(spark, sf):
    return table(spark, sf, "markets_k").withColumn("p", X.ticker_parts(F.col("ticker"))).select("ticker", "p.*", X.fight_of(F.col("ticker")).alias("event"))


@query(r"""WITH c AS (SELECT id, slug, regexp_extract(slug,'^ufc-([a-z]+)-([a-z]+)-(\d{4}-\d{2}-\d{2})(?:-\d+)*$',['a','b','d']) AS x, regexp_extract(slug,'^will-(.+?)-beat-(.+?)(?:-in-mma-bout(?:-\d+)?)?$',['a','b']) AS y, regexp_extract(slug,'^(.+?)-vs-(.+?)(?:-\d+)?$',['a','b']) AS v FROM markets_p)
 SELECT id, coalesce(nullif(x.a,''),nullif(y.a,''),nullif(v.a,'')) AS a, coalesce(nullif(x.b,''),nullif(y.b,''),nullif(v.b,'')) AS b, TRY_CAST(nullif(x.d,'') AS DATE) AS day FROM c""")
def q34_slug_parse(spark, sf):
    return table(spark, sf, "markets_p").withColumn("p", X.slug_parts(F.col("slug"))).select("id", "p.*")


# -- as-of and event windows --------------------------------------------------
_CAL = ", cal AS (SELECT DISTINCT ticker, epoch_us(CAST(card AS TIMESTAMP))//1000000 + 43200 AS t0 FROM tape)"


def _calendar(t: DataFrame) -> DataFrame:
    return t.select("ticker", (F.unix_seconds(F.col("card").cast("timestamp")) + 43200).alias("t0")).distinct()


@query("WITH " + TAPE_SQL + _CAL + ", r AS (SELECT ticker, t, arg_max(price, trade_id) AS price FROM tape GROUP BY ticker, t) SELECT cal.ticker, t0, round(r.price,6) AS price, t0 - r.t AS age FROM cal ASOF LEFT JOIN r ON cal.ticker=r.ticker AND cal.t0>=r.t")
def q35_asof_marks(spark, sf):
    t = tape(spark, sf)
    left = _calendar(t).select("ticker", F.col("t0").alias("t"))
    m = asof.asof_backward(left.withColumn("_k", F.lit(1)), t, "ticker", "t", ["price"], "trade_id")
    return m.select("ticker", F.col("t").alias("t0"), F.round("price", 6).alias("price"), "age")


@query("WITH " + TAPE_SQL + _CAL + " SELECT cal.ticker, t0, count_if(t<t0)::BIGINT AS pre_n, count_if(t>t0)::BIGINT AS post_n, round(sum(size) FILTER (t>t0),6) AS post_vol, round(arg_max(price,(t,trade_id)) FILTER (t<=t0),6) AS mark FROM cal JOIN tape ON cal.ticker=tape.ticker AND t BETWEEN t0-21600 AND t0+86400 GROUP BY ALL")
def q36_event_panel_counts(spark, sf):
    t = tape(spark, sf)
    j = asof.event_windows(_calendar(t).withColumnRenamed("ticker", "tk"), t, 21600, 86400).where("tk = ticker")
    pre = F.col("t") <= F.col("t0")
    return j.groupBy("ticker", "t0").agg(F.count_if(F.col("t") < F.col("t0")).alias("pre_n"), F.count_if(~pre).alias("post_n"), F.round(F.sum(F.when(~pre, F.col("size"))), 6).alias("post_vol"), F.round(F.max_by("price", F.when(pre, F.struct("t", "trade_id"))), 6).alias("mark"))


# -- ladders ------------------------------------------------------------------
_DAILY = LADDER_SQL + ", daily AS (SELECT contract, date, strike, arg_max(price, ord) AS last, sum(price*size)/sum(size) AS vwap, sum(size) AS volume FROM ladder GROUP BY ALL)"
_DENSE = _DAILY + """, sp AS (SELECT contract, min(date) lo, max(date) expiry FROM daily GROUP BY contract), gr AS (SELECT contract, strike, expiry, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(expiry AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS date FROM (SELECT DISTINCT contract, strike FROM daily) JOIN sp USING (contract)),
 dn AS (SELECT contract, date, strike, last_value(last IGNORE NULLS) OVER (PARTITION BY contract, strike ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, coalesce(volume,0) AS volume, expiry FROM gr LEFT JOIN daily USING (contract, date, strike)), dense AS (SELECT * FROM dn WHERE price IS NOT NULL)"""
_MONO = _DENSE + """, mi AS (SELECT *, first_value(strike) OVER (PARTITION BY contract, date ORDER BY abs(price-49), strike) AS mid FROM dense), mono AS (SELECT *, min(price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ltr, max(price) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rtl,
 CASE WHEN strike<=mid THEN max(CASE WHEN strike<=mid THEN price END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE min(CASE WHEN strike>=mid THEN price END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS middle FROM mi WINDOW w AS (PARTITION BY contract, date ORDER BY strike))"""
_BINS = _MONO + """, al AS (SELECT contract, date, strike, middle AS p FROM mono UNION ALL SELECT contract, date, min(strike) - 1, NULL FROM mono GROUP BY contract, date),
 ma AS (SELECT contract, date, strike, CASE WHEN lag(strike) OVER w IS NULL THEN 99 - lead(p) OVER w WHEN lead(strike) OVER w IS NOT NULL THEN p - lead(p) OVER w ELSE p - 1 END AS m FROM al WINDOW w AS (PARTITION BY contract, date ORDER BY strike)),
 en AS (SELECT contract, date, min(strike) lo, max(strike) hi FROM ma GROUP BY contract, date), fu AS (SELECT contract, date, lo + unnest(range(CAST(hi-lo AS BIGINT)+1)) AS strike FROM en), filled AS (SELECT contract, date, strike, coalesce(m,0) AS m FROM fu LEFT JOIN ma USING (contract, date, strike))"""
_PMF = _BINS + """, pmf AS (SELECT contract, date, strike, m*100/nullif(sum(m) OVER (PARTITION BY contract, date),0) AS probability FROM filled)"""


def _dense(spark, sf):
    return ladders.densify(ladders.daily(ladder(spark, sf)))


@query("WITH " + _DAILY + " SELECT contract, date, strike, last, round(vwap,6) AS vwap, volume FROM daily")
def q37_ladder_daily_last_vwap(spark, sf):
    return rounded(ladders.daily(ladder(spark, sf)), "vwap")


@query("WITH " + _DENSE + " SELECT contract, date, strike, price, volume, expiry FROM dense")
def q38_ladder_densify(spark, sf):
    return _dense(spark, sf)


@query("WITH " + _MONO + " SELECT contract, date, strike, price, ltr, rtl, middle FROM mono")
def q39_monotone_ltr_rtl_middle(spark, sf):
    return ladders.monotone(_dense(spark, sf)).select("contract", "date", "strike", "price", "ltr", "rtl", "middle")


@query("WITH " + _PMF + " SELECT contract, date, strike, round(probability,6) AS probability FROM pmf")
def q40_pmf_diff_complete(spark, sf):
    return rounded(ladders.pmf(ladders.monotone(_dense(spark, sf))), "probability")


@query("WITH " + _PMF + """, a AS (SELECT *, sum(probability) OVER w AS t, sum(strike*probability) OVER w / sum(probability) OVER w AS mu, sum(probability) OVER (PARTITION BY contract, date ORDER BY strike) AS cum FROM pmf WINDOW w AS (PARTITION BY contract, date)), b AS (SELECT *, min(strike) FILTER (cum>=0.5*t-1e-9) OVER (PARTITION BY contract, date) AS med FROM a),
 g AS (SELECT contract, date, max(mu) AS mean, max(med) AS median, arg_max(strike,(round(probability,9),-strike)) AS mode, sum(probability*(strike-mu)*(strike-mu))/max(t) AS variance, sum(probability*abs(strike-med))/max(t) AS mad, sum(probability*power(strike-mu,4))/max(t) AS m4 FROM b GROUP BY contract, date)
 SELECT contract, date, round(mean,6) AS mean, median, mode, round(variance,6) AS variance, round((mean-median)/nullif(mad,0),6) AS skewness, round(m4/nullif(variance*variance,0)-3,6) AS kurtosis FROM g""")
def q41_moments(spark, sf):
    return rounded(ladders.moments(ladders.pmf(ladders.monotone(_dense(spark, sf)))), "mean", "variance", "skewness", "kurtosis")


@query()
def q42_swap_fixpoint(spark, sf):
    """Gaps closed towards the median, ladder by ladder."""
    return rounded(ladders.normalised(ladders.swapped(ladders.bins(ladders.monotone(_dense(spark, sf))))), "probability")


_QUOTES = LADDER_SQL + ", q AS (SELECT contract, date, min(price) AS bid, min(price) + (max(strike) - min(strike)) % 21 AS ask FROM ladder GROUP BY contract, date)"


@query("WITH " + _QUOTES + """, l AS (SELECT *, ask-bid>10 AS wide, last_value(CASE WHEN ask-bid<=10 THEN bid END IGNORE NULLS) OVER w AS lb, last_value(CASE WHEN ask-bid<=10 THEN ask END IGNORE NULLS) OVER w AS la FROM q WINDOW w AS (PARTITION BY contract ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 m AS (SELECT contract, date, bid, ask, CASE WHEN wide THEN coalesce(lb,bid) ELSE bid END AS good_bid, CASE WHEN wide THEN coalesce(la,ask) ELSE ask END AS good_ask FROM l) SELECT *, (good_bid+good_ask)/2 AS mid FROM m""")
def q43_bidask_last_good(spark, sf):
    q = ladder(spark, sf).groupBy("contract", "date").agg(F.min("price").alias("bid"), (F.min("price") + (F.max("strike") - F.min("strike")) % 21).alias("ask"))
    return ladders.last_good(q, "contract", "date")


@query("WITH " + _PMF + ", mu AS (SELECT contract, date, sum(strike*probability)/sum(probability) mu FROM pmf GROUP BY ALL), f AS (SELECT contract, max(date) expiry, arg_max(mu,date) final FROM mu GROUP BY contract) SELECT (expiry-date)::INT AS days_to_event, count(*) AS n, round(avg(abs(mu-final)),6) AS mean_abs_error FROM mu JOIN f USING (contract) GROUP BY 1")
def q44_forecast_error_curve(spark, sf):
    m = ladders.moments(ladders.pmf(ladders.monotone(_dense(spark, sf)))).select("contract", "date", "mean")
    f = m.groupBy("contract").agg(F.max("date").alias("expiry"), F.max_by("mean", "date").alias("final"))
    return m.join(f, "contract").groupBy(F.datediff("expiry", "date").alias("days_to_event")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("mean") - F.col("final"))), 6).alias("mean_abs_error"))


@query("WITH " + TAPE_SQL + ", w AS (SELECT *, last_value(price) OVER (PARTITION BY fight ORDER BY t, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM tape) SELECT fight, round(avg((taker_side='yes' AND fin>price)::INT)/nullif(avg((taker_side='yes')::INT),0),6) AS p_up_given_yes, round(avg(abs(fin-price)),6) AS distance FROM w GROUP BY fight")
def q45_conditional_probs(spark, sf):
    t = tape(spark, sf)
    fin = t.groupBy("fight").agg(F.max_by("price", F.struct("t", "trade_id")).alias("fin"))
    yes = (F.col("taker_side") == "yes").cast("int")
    up = ((F.col("taker_side") == "yes") & (F.col("fin") > F.col("price"))).cast("int")
    return t.join(fin, "fight").groupBy("fight").agg(F.round(F.avg(up) / F.nullif(F.avg(yes), F.lit(0.0)), 6).alias("p_up_given_yes"), F.round(F.avg(F.abs(F.col("fin") - F.col("price"))), 6).alias("distance"))


# -- relational building blocks ----------------------------------------------
@query("WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS new FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY new, o_orderkey) AS rn FROM u) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn=1")
def q46_upsert_dedup(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return match.upsert(o.where("o_orderkey % 2 = 0"), o, ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey AND o.o_totalprice>100000) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey=c.c_custkey) AND c.c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*)>=50)")
def q47_semi_anti_coverage(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    c = match.coverage_floor(c, "c_nationkey", 50)
    c = c.join(table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderpriority AS series, " + ", ".join(f"count_if(year(o_orderdate)={y})::BIGINT AS y{y}" for y in range(1992, 1999)) + " FROM orders GROUP BY 1")
def q48_pivot_wide(spark, sf):
    years = list(range(1992, 1999))
    p = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("y")).groupBy("series").pivot("y", years).count().na.fill(0)
    return p.select("series", *[F.col(str(y)).alias(f"y{y}") for y in years])


@query("SELECT 'customer' AS src, c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def q49_union_schema_evolve(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True)


@query("WITH a AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus='O') SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_f', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def q50_set_ops(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    part = lambda n, d: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return part("both", a.intersect(b)).union(part("only_f", a.subtract(b))).union(part("any", a.union(b).distinct()))


@query("WITH " + _RET + """, d AS (SELECT ticker, bar, ofi_z x, dp_1 y, row_number() OVER (PARTITION BY ticker ORDER BY bar) pos FROM z WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL), r AS (SELECT rep, d.*, md5(rep||'|'||bar||'|7') h FROM d, (SELECT unnest(range(20)) rep)), s AS (SELECT rep, ticker, row_number() OVER (PARTITION BY rep, ticker ORDER BY h) pos, y FROM r)
 SELECT r.rep::INT AS rep, round(covar_samp(r.x, s.y)/var_samp(r.x),8) AS slope FROM r JOIN s USING (rep, ticker, pos) GROUP BY r.rep""")
def q51_permutation_test(spark, sf):
    return rounded(stats.permutation(_ret(spark, sf), "ofi_z", "dp_1", "ticker", "bar"), "slope", digits=8)


@query("WITH " + _VENUE + """, u AS (SELECT fight, bar, last x, 0 side FROM p UNION ALL SELECT fight, bar, last, 1 FROM k), w AS (SELECT *, last_value(CASE WHEN side=0 THEN bar END IGNORE NULLS) OVER a AS ta, last_value(CASE WHEN side=0 THEN x END IGNORE NULLS) OVER a AS xa, first_value(CASE WHEN side=0 THEN bar END IGNORE NULLS) OVER b AS tb, first_value(CASE WHEN side=0 THEN x END IGNORE NULLS) OVER b AS xb FROM u WINDOW a AS (PARTITION BY fight ORDER BY bar, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY fight ORDER BY bar, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT fight, count(*) AS n, round(avg(abs(x - CASE WHEN ta IS NULL THEN xb WHEN tb IS NULL OR ta=tb THEN xa ELSE xa+(xb-xa)*(bar-ta)/(tb-ta) END)),6) AS mad FROM w WHERE side=1 GROUP BY fight""")
def q52_interp_mad(spark, sf):
    k, p = _venue(spark, sf)
    d = asof.interpolate_at(p, k.select("fight", "bar", F.col("last").alias("own")), "fight", "bar", "last")
    return d.groupBy("fight").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("own") - F.col("interpolated"))), 6).alias("mad"))


@query("WITH " + TAPE_SQL + ", c AS (SELECT *, dense_rank() OVER (ORDER BY card DESC) AS r FROM tape) SELECT card, r<=2 AS sealed, count(*) AS n, round(avg(price),6) AS mean_price FROM c GROUP BY ALL")
def q53_holdout_cards(spark, sf):
    t = tape(spark, sf)
    # cards are few: ranked apart from the trades, then met by date
    cards = t.select("card").distinct().withColumn("sealed", F.dense_rank().over(Window.orderBy(F.desc("card"))) <= 2)
    return t.join(cards, "card").groupBy("card", "sealed").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price"))


# -- streaming ----------------------------------------------------------------
@query(ORACLE["q01_bars_vwap"])
def q54_stream_bars_available_now(spark, sf):
    """q01 as a stream: dedup within the watermark, tumbling windows, all that is there."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    at = f"{sf}/events.parquet"
    from pathlib import Path

    folder, glob = (at, "*.parquet") if Path(at).is_dir() else (sf, "events.parquet")
    e = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    k = F.get_json_object("props", "$.k").cast("int")
    t = e.select(F.col("event_id").alias("trade_id"), (F.col("user_id") % 20).alias("ticker"), ((k + 0.5) / 100).alias("price"), F.col("value").alias("size"), F.col("ts").cast("timestamp").alias("ts"))
    return rounded(live.drain(live.streaming_bars(live.once(t, "trade_id", "ts", "2 days"), ["ticker"], "ts", "1 hour")), "last", "vwap", "vol")


# -- venue P fills, sides and windows -----------------------------------------
_YES = ", tk AS (SELECT id AS market_id, json_extract_string(clob_token_ids, '$[0]') AS yes_token, json_extract_string(clob_token_ids, '$[1]') AS no_token FROM markets_p)"
_FILLS = "fills AS (SELECT delivery_id, CAST(TRY_CAST(trim(market_id) AS DOUBLE) AS BIGINT)::VARCHAR AS market_id, maker_asset_id, taker_asset_id, maker_amount, taker_amount FROM pm_trades WHERE maker_amount IS NOT NULL)"


def _fills(spark, sf):
    from tapelight.operators.delivery import whole_id

    f = table(spark, sf, "pm_trades").where("maker_amount is not null")
    return f.select("delivery_id", whole_id(F.col("market_id")).alias("market_id"), "maker_asset_id", "taker_asset_id", "maker_amount", "taker_amount")


def _tokens(spark, sf):
    ids = X.json_list(F.col("clob_token_ids"))
    return table(spark, sf, "markets_p").select(F.col("id").alias("market_id"), F.get(ids, F.lit(0)).alias("yes_token"), F.get(ids, F.lit(1)).alias("no_token"))


@query("WITH " + _FILLS + _YES + " SELECT f.* FROM fills f LEFT JOIN tk USING (market_id) WHERE yes_token IS NULL OR maker_asset_id = yes_token OR taker_asset_id = yes_token")
def q55_complement_filter(spark, sf):
    return match.complement_filter(_fills(spark, sf), _tokens(spark, sf))


@query("WITH " + _FILLS + _YES + """, p AS (SELECT *, CASE WHEN length(maker_asset_id)<20 THEN maker_amount ELSE taker_amount END AS u, CASE WHEN length(maker_asset_id)<20 THEN taker_amount ELSE maker_amount END AS q FROM fills LEFT JOIN tk USING (market_id))
 SELECT delivery_id, round(u/1e6,6) AS usd, round(q/1e6,6) AS qty, round(CASE WHEN no_token IN (maker_asset_id, taker_asset_id) THEN 1-u*1.0/nullif(q,0) ELSE u*1.0/nullif(q,0) END,6) AS price_yes FROM p""")
def q56_onchain_price(spark, sf):
    d = match.fill_price(_fills(spark, sf)).join(_tokens(spark, sf), "market_id", "left")
    no = (F.col("maker_asset_id") == F.col("no_token")) | (F.col("taker_asset_id") == F.col("no_token"))
    return d.select("delivery_id", F.round("usd", 6).alias("usd"), F.round("qty", 6).alias("qty"), F.round(F.when(no, 1 - F.col("price")).otherwise(F.col("price")), 6).alias("price_yes"))


@query("SELECT ticker, epoch_us(close_time)//1000000 - 3600 - (epoch_us(close_time)//1000000 - 3600) % 300 AS t_end, epoch_us(close_time)//1000000 - 3600 - (epoch_us(close_time)//1000000 - 3600) % 300 - 259200 AS t_start FROM markets_k WHERE close_time IS NOT NULL")
def q57_fight_window(spark, sf):
    end = bars.floor_to(F.unix_seconds("close_time") - 3600, 300)
    return table(spark, sf, "markets_k").where("close_time is not null").select("ticker", end.alias("t_end"), (end - 259200).alias("t_start"))


@query("""WITH w AS (SELECT ticker, epoch_us(close_time)//1000000 AS c FROM markets_k WHERE close_time IS NOT NULL), t AS (SELECT a.ticker, epoch_us(created_time)//1000000 AS t, delivery_id, CASE WHEN yes_price+no_price=1000 THEN yes_price/1e3 WHEN yes_price+no_price=10000 THEN yes_price/1e4 ELSE yes_price/1e2 END AS price, n_contracts AS q FROM tape_archive a WHERE yes_price IS NOT NULL AND no_price IS NOT NULL)
 SELECT t.ticker, t - t % 300 AS bar, count(*) AS n, round(arg_max(price,(t,delivery_id)),6) AS last, sum(q)::BIGINT AS vol FROM t JOIN w ON t.ticker=w.ticker AND t>=c-259200-3600 AND t<c+7200 GROUP BY ALL""")
def q58_window_bars(spark, sf):
    from tapelight.operators.units import archive_quantities

    w = table(spark, sf, "markets_k").where("close_time is not null").select(F.col("ticker").alias("tk"), F.unix_seconds("close_time").alias("c"))
    t = archive_quantities(table(spark, sf, "tape_archive").where("yes_price is not null and no_price is not null").select("ticker", "created_time", "delivery_id", "yes_price", "no_price", "n_contracts"))
    t = t.select("ticker", F.unix_seconds("created_time").alias("t"), F.col("delivery_id").alias("trade_id"), F.col("price_usd").alias("price"), F.col("n_contracts").alias("size"))
    j = t.join(w, (F.col("tk") == F.col("ticker")) & (F.col("t") >= F.col("c") - 259200 - 3600) & (F.col("t") < F.col("c") + 7200))
    return rounded(bars.make_bars(j, ["ticker"], 300), "last").select("ticker", "bar", "n", "last", "vol")


@query("""WITH c AS (SELECT s, m, make_timestamp(y, m, 10, 8, 30, 0) AS wall FROM (VALUES ('cpi'),('jobs')) v(s), (SELECT unnest(range(1,13)) m), (SELECT unnest([2024,2025]) y)) SELECT s AS series, epoch_us(wall AT TIME ZONE 'America/New_York')//1000000 AS release_utc FROM c""")
def q59_release_calendar(spark, sf):
    s = io.literal(spark, [("cpi",), ("jobs",)], "series string")
    d = s.withColumn("y", F.explode(F.array(F.lit(2024), F.lit(2025)))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    wall = F.make_timestamp("y", "m", F.lit(10), F.lit(8), F.lit(30), F.lit(0))
    return d.select("series", F.unix_seconds(F.to_utc_timestamp(wall, "America/New_York")).alias("release_utc"))


@query("WITH " + TAPE_SQL + _CAL + """, m AS (SELECT cal.ticker, t0, arg_max(price,(t,trade_id)) FILTER (t<t0) AS pre, t0 - max(t) FILTER (t<t0) AS stale, arg_max(price,(t,trade_id)) FILTER (t<=t0+14400) AS p4, arg_max(price,(t,trade_id)) FILTER (t<=t0+86400) AS p24, count_if(t>t0)::BIGINT AS n FROM cal JOIN tape ON cal.ticker=tape.ticker AND t BETWEEN t0-21600 AND t0+86400 GROUP BY cal.ticker, t0)
 SELECT ticker, count(*) AS events, count_if(pre IS NOT NULL AND stale<=7200 AND n>0)::BIGINT AS usable, round(avg(p4-pre),6) AS drift_4h, round(avg(p24-pre),6) AS drift_24h FROM m GROUP BY ticker""")
def q60_event_drift(spark, sf):
    t = tape(spark, sf)
    j = asof.event_windows(_calendar(t).withColumnRenamed("ticker", "tk"), t, 21600, 86400).where("tk = ticker")
    at = F.struct("t", "trade_id")
    upto = lambda s: F.max_by("price", F.when(F.col("t") <= F.col("t0") + s, at))
    pre = F.col("t") < F.col("t0")
    m = j.groupBy("ticker", "t0").agg(F.max_by("price", F.when(pre, at)).alias("pre"), F.max(F.when(pre, F.col("t"))).alias("tp"), upto(14400).alias("p4"), upto(86400).alias("p24"), F.count_if(F.col("t") > F.col("t0")).alias("n"))
    good = F.col("pre").isNotNull() & (F.col("t0") - F.col("tp") <= 7200) & (F.col("n") > 0)
    return m.groupBy("ticker").agg(F.count("*").alias("events"), F.count_if(good).alias("usable"), F.round(F.avg(F.col("p4") - F.col("pre")), 6).alias("drift_4h"), F.round(F.avg(F.col("p24") - F.col("pre")), 6).alias("drift_24h"))


# -- more of the ladders ------------------------------------------------------
@query("WITH " + _DENSE + " SELECT contract, date, strike, round(price*100/sum(price) OVER (PARTITION BY contract, date),6) AS probability FROM dense")
def q61_exclusive_bins(spark, sf):
    return rounded(ladders.exclusive_bins(_dense(spark, sf)), "probability").select("contract", "date", "strike", "probability")


@query("WITH " + _PMF + ", c AS (SELECT *, sum(probability) OVER (PARTITION BY contract, date ORDER BY strike) AS cum, sum(probability) OVER (PARTITION BY contract, date) AS t FROM pmf) SELECT contract, date, min(strike) FILTER (cum>=0.25*t-1e-9) AS p25, min(strike) FILTER (cum>=0.75*t-1e-9) AS p75, round(sum(probability) FILTER (strike>40),6) AS tail FROM c GROUP BY contract, date")
def q62_tail_quantiles(spark, sf):
    p = ladders.pmf(ladders.monotone(_dense(spark, sf)))
    w = Window.partitionBy("contract", "date")
    c = p.withColumns({"cum": F.sum("probability").over(w.orderBy("strike")), "t": F.sum("probability").over(w)})
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("t") - 1e-9, F.col("strike")))
    return c.groupBy("contract", "date").agg(at(0.25).alias("p25"), at(0.75).alias("p75"), F.round(F.sum(F.when(F.col("strike") > 40, F.col("probability"))), 6).alias("tail"))


@query("WITH " + _DAILY + " SELECT contract, date, " + ", ".join(f"max(last) FILTER (strike={k}) AS s{k}" for k in (1, 10, 25, 50)) + " FROM daily GROUP BY contract, date")
def q63_ladder_wide(spark, sf):
    strikes = [1, 10, 25, 50]
    d = ladders.daily(ladder(spark, sf)).withColumn("s", F.col("strike").cast("int")).groupBy("contract", "date").pivot("s", strikes).agg(F.max("last"))
    return d.select("contract", "date", *[F.col(str(k)).alias(f"s{k}") for k in strikes])


# -- statistics, reports ------------------------------------------------------
@query("WITH " + _CO + """, r AS (SELECT *, sum(dp) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS r1, sum(dp) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r4, lead(k_last,4) OVER (PARTITION BY fight ORDER BY bar) AS e FROM co)
 SELECT count(*) AS n, round(avg(sign(dk)*r1),6) AS near, round(avg(sign(dk)*r4),6) AS far, round(sum(sign(dk)*r1)/nullif(sum(sign(dk)*r4),0),4) AS speed, round((SELECT avg(abs(r4)) FROM r WHERE r4 IS NOT NULL),6) AS baseline FROM r WHERE abs(dk)>=0.03 AND e IS NOT NULL AND r1 IS NOT NULL AND r4 IS NOT NULL""")
def q64_speed_ratio(spark, sf):
    w = bars.by("fight")
    r = _co(spark, sf).withColumns({"r1": F.sum("dp").over(w.rowsBetween(1, 1)), "r4": F.sum("dp").over(w.rowsBetween(1, 4)), "e": F.lead("k_last", 4).over(w)})
    s, ok = F.signum("dk"), (F.abs("dk") >= 0.03) & F.col("e").isNotNull() & F.col("r1").isNotNull() & F.col("r4").isNotNull()
    when = lambda c: F.when(ok, c)
    return r.agg(F.count_if(ok).alias("n"), F.round(F.avg(when(s * F.col("r1"))), 6).alias("near"), F.round(F.avg(when(s * F.col("r4"))), 6).alias("far"), F.round(F.sum(when(s * F.col("r1"))) / F.nullif(F.sum(when(s * F.col("r4"))), F.lit(0.0)), 4).alias("speed"), F.round(F.avg(F.abs("r4")), 6).alias("baseline"))


@query("WITH " + _CO + ", s AS (SELECT count_if(abs(dk)>=0.03 AND sign(dk)*dp>0)::DOUBLE a, count_if(abs(dk)>=0.03)::DOUBLE n, count_if(abs(dp)>=0.03 AND sign(dp)*dk>0)::DOUBLE b, count_if(abs(dp)>=0.03)::DOUBLE m FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL) SELECT round(a/n,6) AS share_k, round(b/m,6) AS share_p, round((a/n-b/m)/sqrt((a+b)/(n+m)*(1-(a+b)/(n+m))*(1/n+1/m)),6) AS z FROM s")
def q65_two_proportions(spark, sf):
    d = _co(spark, sf).where("dk is not null and dp is not null")
    one = lambda a, b: (F.count_if((F.abs(a) >= 0.03) & (F.signum(a) * F.col(b) > 0)).cast("double"), F.count_if(F.abs(a) >= 0.03).cast("double"))
    (a, n), (b, m) = one("dk", "dp"), one("dp", "dk")
    s = d.agg(a.alias("a"), n.alias("n"), b.alias("b"), m.alias("m"))
    return s.select(F.round(F.col("a") / F.col("n"), 6).alias("share_k"), F.round(F.col("b") / F.col("m"), 6).alias("share_p"), F.round(stats.two_proportions(F.col("a"), F.col("n"), F.col("b"), F.col("m")), 6).alias("z"))


@query("WITH " + _QUINT + ", s AS (SELECT q, avg(dp_1) m FROM q GROUP BY q), l AS (SELECT list(m ORDER BY q) v FROM s) SELECT CASE WHEN v[1]<=v[2] AND v[2]<=v[3] AND v[3]<=v[4] AND v[4]<=v[5] THEN 'rising' WHEN v[1]>=v[2] AND v[2]>=v[3] AND v[3]>=v[4] AND v[4]>=v[5] THEN 'falling' ELSE 'mixed' END AS shape, round(v[5]-v[1],6) AS spread, v[5]-v[1] > 0.0 AS confirmed, round((SELECT avg(2*0.07*last*(1-last)) FROM q),6) AS fee FROM l")
def q66_confirmatory_verdict(spark, sf):
    r = _ret(spark, sf).where("ofi_z is not null and dp_1 is not null")
    s = stats.quintile_table(r, "ofi_z", "dp_1").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "mean_y"))), lambda e: e["mean_y"]).alias("v"))  # five rows
    fee = r.agg(F.avg(stats.round_trip_fee(F.col("last"))).alias("fee"))
    spread = F.get("v", F.lit(4)) - F.get("v", F.lit(0))
    return s.crossJoin(F.broadcast(fee)).select(stats.monotone(F.col("v")).alias("shape"), F.round(spread, 6).alias("spread"), (spread > 0).alias("confirmed"), F.round("fee", 6).alias("fee"))


@query("WITH " + TAPE_SQL + " SELECT venue, count(*) AS n, round(avg(price),6) AS mean, round(stddev_samp(price),6) AS std, min(price) AS min, quantile_cont(price,0.25) AS p25, quantile_cont(price,0.5) AS p50, quantile_cont(price,0.75) AS p75, max(price) AS max, count(DISTINCT ticker) AS tickers, round(stddev_samp(price)/sqrt(count(*)),8) AS sem FROM tape GROUP BY venue")
def q67_describe(spark, sf):
    t = tape(spark, sf)
    q = stats.percentiles(t, "price", [0.25, 0.5, 0.75], ["venue"])
    d = t.groupBy("venue").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.stddev_samp("price"), 6).alias("std"), F.min("price").alias("min"), F.max("price").alias("max"), F.countDistinct("ticker").alias("tickers"), F.round(F.stddev_samp("price") / F.sqrt(F.count("*")), 8).alias("sem"))
    return d.join(q, "venue").select(*d.columns, *[F.col("p")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75"))])


@query("WITH " + TAPE_SQL + " SELECT venue, taker_side, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY venue),6) AS pct FROM tape GROUP BY venue, taker_side")
def q68_value_counts(spark, sf):
    c = tape(spark, sf).groupBy("venue", "taker_side").agg(F.count("*").alias("n"))
    return c.select("venue", "taker_side", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("venue")), 6).alias("pct"))


@query("SELECT series, count(*) AS n, count_if(taker_side IN ('yes','no'))::BIGINT AS usable, round(100.0*count_if(taker_side IN ('yes','no'))/count(*),6) AS pct, min(fetched_at) AS first_at, max(fetched_at) AS last_at, count(DISTINCT ticker) AS tickers FROM tape_live GROUP BY series")
def q69_attrition(spark, sf):
    ok = F.coalesce(F.col("taker_side").isin("yes", "no"), F.lit(False))
    return table(spark, sf, "tape_live").groupBy("series").agg(F.count("*").alias("n"), F.count_if(ok).alias("usable"), F.round(100.0 * F.count_if(ok) / F.count("*"), 6).alias("pct"), F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at"), F.countDistinct("ticker").alias("tickers"))


@query("WITH s AS (SELECT market_id, count(usdc_amount)*2 > count(*) AS has FROM pm_trades GROUP BY 1) SELECT market_id, count(*) AS n, has, round(sum(CASE WHEN has THEN usdc_amount ELSE coalesce(TRY_CAST(size AS DOUBLE),1.0)*price_yes END),2) AS weight FROM pm_trades JOIN s USING (market_id) GROUP BY ALL")
def q70_preferred_source(spark, sf):
    t = table(spark, sf, "pm_trades").select("market_id", "usdc_amount", "size", "price_yes")
    own = F.coalesce("size", F.lit(1.0)) * F.col("price_yes")
    # both sums in one pass, the choice after it
    g = t.groupBy("market_id").agg(F.count("*").alias("n"), (F.count("usdc_amount") * 2 > F.count("*")).alias("has"), F.sum("usdc_amount").alias("u"), F.sum(own).alias("o"))
    return g.select("market_id", "n", "has", F.round(F.when(F.col("has"), F.col("u")).otherwise(F.col("o")), 2).alias("weight"))


@query("WITH " + _RET + ", d AS (SELECT card, dp_1, dp_contemp FROM z WHERE dp_1 IS NOT NULL AND dp_contemp IS NOT NULL) SELECT CASE WHEN dp_contemp>0 THEN 'up' WHEN dp_contemp<0 THEN 'down' ELSE 'flat' END AS surprise, count(*) AS n, round(avg(dp_1),6) AS response, round(regr_slope(dp_1, dp_contemp),6) AS slope, round(regr_intercept(dp_1, dp_contemp),6) AS intercept FROM d GROUP BY 1")
def q71_surprise_responses(spark, sf):
    d = _ret(spark, sf).where("dp_1 is not null and dp_contemp is not null")
    sign = F.when(F.col("dp_contemp") > 0, "up").when(F.col("dp_contemp") < 0, "down").otherwise("flat")
    return d.groupBy(sign.alias("surprise")).agg(F.count("*").alias("n"), F.round(F.avg("dp_1"), 6).alias("response"), F.round(F.regr_slope("dp_1", "dp_contemp"), 6).alias("slope"), F.round(F.regr_intercept("dp_1", "dp_contemp"), 6).alias("intercept"))


@query("WITH " + _RET + """, d AS (SELECT 1.0 AS c0, ofi_z AS c1, dp_contemp AS c2, dp_1 AS y FROM z WHERE ofi_z IS NOT NULL AND dp_contemp IS NOT NULL AND dp_1 IS NOT NULL),
 m AS (SELECT count(*)::DOUBLE n, sum(c1) a, sum(c2) b, sum(c1*c1) aa, sum(c1*c2) ab, sum(c2*c2) bb, sum(y) y0, sum(c1*y) y1, sum(c2*y) y2 FROM d),
 t AS (SELECT *, n*(aa*bb-ab*ab) - a*(a*bb-ab*b) + b*(a*ab-aa*b) AS det FROM m),
 i AS (SELECT (aa*bb-ab*ab)/det i00, (b*ab-a*bb)/det i01, (a*ab-b*aa)/det i02, (n*bb-b*b)/det i11, (a*b-n*ab)/det i12, (n*aa-a*a)/det i22, y0, y1, y2 FROM t),
 be AS (SELECT *, i00*y0+i01*y1+i02*y2 b0, i01*y0+i11*y1+i12*y2 b1, i02*y0+i12*y1+i22*y2 b2 FROM i),
 r AS (SELECT c1, c2, power((y-b0-b1*c1-b2*c2)/(1-(i00+2*i01*c1+2*i02*c2+i11*c1*c1+2*i12*c1*c2+i22*c2*c2)),2) AS e FROM d, be),
 s AS (SELECT sum(e) m00, sum(e*c1) m01, sum(e*c2) m02, sum(e*c1*c1) m11, sum(e*c1*c2) m12, sum(e*c2*c2) m22 FROM r),
 v AS (SELECT b0, b1, b2, """ + ", ".join(f"sqrt({x}*{x}*m00+{y}*{y}*m11+{z}*{z}*m22+2*{x}*{y}*m01+2*{x}*{z}*m02+2*{y}*{z}*m12) AS s{k}" for k, (x, y, z) in enumerate((("i00", "i01", "i02"), ("i01", "i11", "i12"), ("i02", "i12", "i22")))) + """ FROM be, s)
 SELECT 'const' AS name, round(b0,8) AS beta, round(s0,8) AS se FROM v UNION ALL SELECT 'ofi_z', round(b1,8), round(s1,8) FROM v UNION ALL SELECT 'dp_contemp', round(b2,8), round(s2,8) FROM v""")
def q72_two_shock_regression(spark, sf):
    """Coefficients and HC3 errors of two regressors; two passes over the data, 3x3 numbers at the driver."""
    r = stats.ols(_ret(spark, sf), ["ofi_z", "dp_contemp"], "dp_1")
    return io.literal(spark, [(n, round(float(b), 8), round(float(s), 8)) for n, b, s in zip(("const", "ofi_z", "dp_contemp"), r["beta"], r["se"])], "name string, beta double, se double")


@query()
def q73_p_values(spark, sf):
    r = stats.fe_ols(_ret(spark, sf), "ofi_z", "dp_1", "ticker", "card")
    return r.withColumn("p", stats.p_normal(F.col("t"))).withColumn("stars", io.stars(F.col("p")))


_XW = f"""fk AS (SELECT fight_id, TRY_CAST(try_strptime(left(fight_id,8),'%Y%m%d') AS DATE) AS d, era, tickers, coalesce({_sql_tokens("array_to_string(fighters_kalshi,' ')")}, []) AS a FROM fights_k),
 nm AS (SELECT p.*, m.end_date, list_filter(p.outcomes, lambda x: lower(x) NOT IN ('yes','no')) AS named FROM fights_p p LEFT JOIN markets_p m ON m.id=p.pm_id),
 fp AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(pm_slug,'(\\d{{4}}-\\d{{2}}-\\d{{2}})',1),'') AS DATE), CAST(end_date AS DATE)) AS pd, {_sql_tokens("CASE WHEN len(named)>0 THEN array_to_string(named,' ') ELSE replace(pm_slug,'-',' ') END")} AS b FROM nm),
 cand AS (SELECT fight_id, pm_id, len(list_intersect(a,b)) AS n, row_number() OVER (PARTITION BY fight_id ORDER BY len(list_intersect(a,b)) DESC, pm_volume DESC NULLS LAST, pm_id) AS rn FROM fk JOIN fp ON pd BETWEEN d-1 AND d+1 WHERE len(list_intersect(a,b))>=1),
 xw AS (SELECT fk.fight_id, c.pm_id, coalesce(c.n,0)::INT AS overlap_count, CASE WHEN c.n>=2 OR (len(a)>=2 AND c.n*1.0/len(a)>=0.5) THEN 'exact' WHEN c.n>=1 THEN 'fuzzy' ELSE 'unmatched' END AS match_confidence FROM fk LEFT JOIN cand c ON c.fight_id=fk.fight_id AND c.rn=1)"""


def _market_sides(spark, sf):
    """Venue P's markets with names from named outcomes, else the slug, and the day from the slug, else the end date."""
    mp = table(spark, sf, "markets_p").select(F.col("id").alias("pm_id"), "end_date")
    fp = table(spark, sf, "fights_p").join(mp, "pm_id", "left")
    named = F.filter("outcomes", lambda x: ~F.lower(x).isin("yes", "no"))
    names = F.when(F.size(named) > 0, F.array_join(named, " ")).otherwise(F.translate("pm_slug", "-", " "))
    day = F.coalesce(F.try_to_date(F.nullif(F.regexp_extract("pm_slug", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd"), F.to_date("end_date"))
    return fp.select("pm_id", "outcomes", "fighters_pm", "pm_slug", "pm_volume", named.alias("named"), day.alias("pd"), X.name_tokens(names).alias("b"))


def _crosswalk(spark, sf):
    fk = table(spark, sf, "fights_k").select("fight_id", F.try_to_date(F.substring("fight_id", 1, 8), "yyyyMMdd").alias("d"), F.coalesce(X.name_tokens(F.array_join("fighters_kalshi", " ")), F.array().cast("array<string>")).alias("a"))
    fp = _market_sides(spark, sf).where("pd is not null")
    # met by day and token, so a day's bouts are never all compared; the shared tokens of a pair are its score
    j = asof.band_join(fk.select("fight_id", "d", F.explode("a").alias("token")), fp.select("pm_id", "pd", "pm_volume", F.explode("b").alias("token")), "d", "pd", 1, ["token"])
    j = j.groupBy("fight_id", "pm_id").agg(F.count("*").cast("int").alias("n"), F.first("pm_volume").alias("pm_volume"))
    best = match.first_per(j, ["fight_id"], [F.desc("n"), F.desc_nulls_last("pm_volume"), F.col("pm_id")]).select("fight_id", "pm_id", "n")
    n, k = F.coalesce("n", F.lit(0)), F.size("a")
    sure = F.when((n >= 2) | ((k >= 2) & (n / k >= 0.5)), "exact").when(n >= 1, "fuzzy").otherwise("unmatched")
    return fk.join(best, "fight_id", "left").select("fight_id", "pm_id", n.alias("overlap_count"), sure.alias("match_confidence"))


@query("WITH " + _XW + " SELECT * FROM xw")
def q74_crosswalk_rules(spark, sf):
    """Rule-based crosswalk: fights and markets a day apart at most whose name tokens overlap, best overlap first, then volume; every fight with how sure its match is."""
    return _crosswalk(spark, sf)


# -- the survey's full parameters of q12, q18 and q51 -------------------------
_FAR = _RET + ", far AS (SELECT *, lead(last,4) OVER w - lead(last,3) OVER w AS dp_4, lead(last,5) OVER w - lead(last,4) OVER w AS dp_5 FROM z WINDOW w AS (PARTITION BY ticker ORDER BY bar))"


@query("WITH " + _FAR + ", l AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, ticker, ofi_z AS x, dp_{k} AS y FROM far" for k in range(1, 6)) + """), d AS (SELECT lag, x - avg(x) OVER w AS xd, y - avg(y) OVER w AS yd FROM l WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY lag, ticker))
 SELECT lag, count(*) AS n, round(sum(xd*yd)/sum(xd*xd),8) AS beta FROM d GROUP BY lag""")
def q75_lag_structure_1_to_5(spark, sf):
    r = bars.zscore(bars.forward_returns(_ofi(spark, sf), steps=5), "ofi", "ofi_z")
    long = r.select("ticker", F.col("ofi_z").alias("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"dp_{k}").alias("y")) for k in range(1, 6)])).alias("e")).select("ticker", "x", "e.*").where("x is not null and y is not null")
    w = Window.partitionBy("lag", "ticker")
    d = long.select("lag", (F.col("x") - F.avg("x").over(w)).alias("xd"), (F.col("y") - F.avg("y").over(w)).alias("yd"))
    return d.groupBy("lag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("xd") * F.col("yd")) / F.sum(F.col("xd") * F.col("xd")), 8).alias("beta"))


@query("WITH " + _CO + ", c AS (SELECT * FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT fight, {k} AS lag, dk, {'lead' if k >= 0 else 'lag'}(dp, {abs(k)}) OVER (PARTITION BY fight ORDER BY bar) AS v FROM c" for k in range(-6, 7)) + """),
 e AS (SELECT fight, lag, count(*) n, corr(dk,v) rho, stddev_samp(dk) s1, stddev_samp(v) s2 FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT lag, count(*) AS entities, round(tanh(avg(atanh(greatest(-0.9999,least(0.9999,rho))))),6) AS rho FROM e WHERE n>=15 AND s1>=1e-12 AND s2>=1e-12 GROUP BY lag""")
def q76_ccf_by_lag_6(spark, sf):
    return rounded(eventstudy.ccf(_co(spark, sf), range(-6, 7)), "rho")


@query("WITH " + _RET + """, d AS (SELECT ticker, bar, ofi_z x, dp_1 y, row_number() OVER (PARTITION BY ticker ORDER BY bar) pos FROM z WHERE ofi_z IS NOT NULL AND dp_1 IS NOT NULL), r AS (SELECT rep, d.*, md5(rep||'|'||bar||'|7') h FROM d, (SELECT unnest(range(2000)) rep)), s AS (SELECT rep, ticker, row_number() OVER (PARTITION BY rep, ticker ORDER BY h) pos, y FROM r),
 n AS (SELECT r.rep, covar_samp(r.x, s.y)/var_samp(r.x) AS slope FROM r JOIN s USING (rep, ticker, pos) GROUP BY r.rep), o AS (SELECT covar_samp(x, y)/var_samp(x) AS observed FROM d) SELECT count(slope) AS reps, round(max(observed),8) AS slope, round((1 + count_if(abs(slope) >= abs(observed) - 1e-12))/(1 + count(slope)),8) AS p FROM n, o""")
def q77_permutation_p(spark, sf):
    return rounded(stats.permutation_p(_ret(spark, sf), "ofi_z", "dp_1", "ticker", "bar"), "slope", "p", digits=8)


@query("""WITH d AS (SELECT o_orderpriority AS series, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_orderpriority, date_trunc('month', CAST(o_orderdate AS DATE)))
 SELECT series, epoch_us(make_timestamp(year(d), month(d), day(d), 8, 30, 0) AT TIME ZONE 'America/New_York')//1000000 AS release_utc FROM d""")
def q78_release_calendar_orders(spark, sf):
    """Monthly releases by priority from orders: the month's first order date at 08:30 in New York."""
    o = table(spark, sf, "orders").where("o_orderpriority is not null and o_orderdate is not null").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"))
    o = o.groupBy("series", F.trunc("d", "month").alias("m")).agg(F.min("d").alias("d"))
    wall = F.make_timestamp(F.year("d"), F.month("d"), F.day("d"), F.lit(8), F.lit(30), F.lit(0))
    return o.select("series", F.unix_seconds(F.to_utc_timestamp(wall, "America/New_York")).alias("release_utc"))
