"""More registered queries: intervals, side resolution, joins and reports that the catalogue's main families build on."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelight.functions import text as X
from tapelight.operators import asof, bars, eventstudy, ladders, match, stats
from tapelight.plans.catalogue import _CO, _GAPS, _MONO, _PANEL, _PMF, _RET, _VENUE, _XW, HOUR, _co, _crosswalk, _dense, _market_sides, _panel, _ret, _venue, boot_sql, moves_sql, query, rounded
from tapelight.sources.fixtures import LADDER_SQL, TAPE_SQL, ladder, tape
from tapelight.sources.tables import table

# -- intervals by md5 draws ---------------------------------------------------
_NEAR = (-2, -1, 0, 1, 2)


@query("WITH " + _CO + ", c AS (SELECT * FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT fight, {k} AS lag, dk, {'lead' if k >= 0 else 'lag'}(dp, {abs(k)}) OVER (PARTITION BY fight ORDER BY bar) AS v FROM c" for k in _NEAR) + """),
 e AS (SELECT fight, lag, count(*) n, atanh(greatest(-0.9999,least(0.9999,corr(dk,v)))) z, stddev_samp(dk) s1, stddev_samp(v) s2 FROM l WHERE v IS NOT NULL GROUP BY ALL), z AS (SELECT * FROM e WHERE n>=15 AND s1>=1e-12 AND s2>=1e-12)""" + boot_sql("z", "lag", "fight", "z")
 + " SELECT lag, count(*) AS entities, round(tanh(avg(z)),6) AS rho, round(tanh(any_value(lo)),6) AS lo, round(tanh(any_value(hi)),6) AS hi FROM z JOIN bi USING (lag) GROUP BY lag")
def q79_ccf_interval(spark, sf):
    return rounded(eventstudy.ccf(_co(spark, sf), _NEAR, reps=200), "rho", "lo", "hi")


@query("WITH " + _CO + """, m AS (SELECT fight, 1 AS side, dk AS a, dp AS b FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL UNION ALL SELECT fight, -1, dp, dk FROM co WHERE dk IS NOT NULL AND dp IS NOT NULL),
 per AS (SELECT fight, side, CAST(thr AS DOUBLE) AS thr, count(*) AS n, count_if(sign(a)*b>0) AS same, count_if(sign(a)*b>0)*1.0/count(*) AS rate FROM m, (VALUES (0.03),(0.05)) v(thr) WHERE abs(a)>=thr GROUP BY ALL), pk AS (SELECT * FROM per WHERE side=1), pp AS (SELECT * FROM per WHERE side=-1)""" + boot_sql("pk", "thr", "fight", "rate", name="k") + boot_sql("pp", "thr", "fight", "rate", seed=43, name="p") + """,
 d AS (SELECT thr, (ks.s-ps.s)*100 AS s FROM ks JOIN ps USING (thr, rep)), di AS (SELECT thr, quantile_cont(s,0.025) lo, quantile_cont(s,0.975) hi FROM d GROUP BY thr),
 pt AS (SELECT thr, 100*(sum(same) FILTER (side=1)*1.0/sum(n) FILTER (side=1) - sum(same) FILTER (side=-1)*1.0/sum(n) FILTER (side=-1)) AS diff FROM per GROUP BY thr) SELECT thr, round(diff,6) AS diff, round(lo,6) AS lo, round(hi,6) AS hi FROM pt JOIN di USING (thr)""")
def q80_bucket_difference(spark, sf):
    return rounded(eventstudy.bucket_difference(_co(spark, sf), (0.03, 0.05)), "diff", "lo", "hi")


@query("WITH " + _CO + moves_sql("k", (0, 1, 3), 3, 0.03) + moves_sql("p", (0, 1, 3), 3, 0.03) + """, al AS (SELECT 'K->P' AS dir, * FROM m_k UNION ALL SELECT 'P->K', * FROM m_p),
 ok AS (SELECT * FROM al WHERE response IS NOT NULL), per AS (SELECT dir, kind, horizon, fight, avg(response) AS v FROM ok GROUP BY ALL)""" + boot_sql("per", "dir, kind, horizon", "fight", "v")
 + ", pt AS (SELECT dir, kind, horizon, count(*) AS n, avg(response) AS response FROM ok GROUP BY ALL) SELECT dir, kind, horizon, n, round(response,6) AS response, round(lo,6) AS lo, round(hi,6) AS hi FROM pt JOIN bi USING (dir, kind, horizon)")
def q81_propagation_both_ways(spark, sf):
    """Both directions, several horizons: mean response of events, interval over fights' means."""
    co, g = _co(spark, sf), ["dir", "kind", "horizon"]
    m = [eventstudy.moves(co, 0.03, (0, 1, 3), 3, lead=v).select(F.lit(d).alias("dir"), "*") for v, d in (("k", "K->P"), ("p", "P->K"))]
    m = m[0].unionByName(m[1]).where("response is not null")
    per = m.groupBy(*g, "fight").agg(F.avg("response").alias("v")).withColumn("one", F.lit(1))
    point = m.groupBy(*g).agg(F.count("*").alias("n"), F.avg("response").alias("response"))
    return rounded(point.join(stats.interval(stats.resampled(per, "v", "one", "fight", g), g), g), "response", "lo", "hi")


@query("WITH " + _CO + """, r AS (SELECT *, sum(dp) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS r1, sum(dp) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r4, lead(k_last,4) OVER (PARTITION BY fight ORDER BY bar) AS e FROM co),
 per AS (SELECT fight, sum(sign(dk)*r1) AS a, sum(sign(dk)*r4) AS b FROM r WHERE abs(dk)>=0.03 AND e IS NOT NULL AND r1 IS NOT NULL AND r4 IS NOT NULL GROUP BY fight)""" + boot_sql("per", "", "fight", "a", "b") + " SELECT round((SELECT sum(a)/sum(b) FROM per),4) AS speed, (SELECT count(*) FROM per) AS fights, round(lo,4) AS lo, round(hi,4) AS hi FROM bi")
def q82_speed_ratio_interval(spark, sf):
    w = bars.by("fight")
    r = _co(spark, sf).withColumns({"r1": F.sum("dp").over(w.rowsBetween(1, 1)), "r4": F.sum("dp").over(w.rowsBetween(1, 4)), "e": F.lead("k_last", 4).over(w)})
    r = r.where((F.abs("dk") >= 0.03) & F.col("e").isNotNull() & F.col("r1").isNotNull() & F.col("r4").isNotNull())
    per = r.groupBy("fight").agg(F.sum(F.signum("dk") * F.col("r1")).alias("a"), F.sum(F.signum("dk") * F.col("r4")).alias("b"))
    return stats.hash_bootstrap(per, "a", "b", "fight").select(F.round("point", 4).alias("speed"), F.col("n").alias("fights"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("WITH " + _GAPS + ", cl AS (SELECT kind, fight*1000000000000+start AS key, duration_min FROM ep WHERE NOT censored)" + boot_sql("cl", "kind", "key", "duration_min", median=True) + " SELECT kind, count(*) AS closed, round(median(duration_min),4) AS median_min, round(any_value(lo),4) AS lo, round(any_value(hi),4) AS hi FROM cl JOIN bi USING (kind) GROUP BY kind")
def q83_gap_median_interval(spark, sf):
    e = eventstudy.gap_episodes(_panel(spark, sf)).where("not censored").select("kind", (F.col("fight") * 1_000_000_000_000 + F.col("start")).alias("key"), "duration_min").withColumn("one", F.lit(1))
    point = e.groupBy("kind").agg(F.count("*").alias("closed"), F.percentile("duration_min", F.lit(0.5)).alias("median_min"))
    return rounded(point.join(stats.interval(stats.resampled(e, "duration_min", "one", "key", ["kind"], median=True), ["kind"]), "kind"), "median_min", "lo", "hi", digits=4)


# -- sides and windows --------------------------------------------------------
def _sql_words(c: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents({c})),'[^a-z ]','','g'),' +',' ','g')),' '), lambda x: x<>''))"


_SIDES = _XW + f""", tn AS (SELECT ticker, trim(nullif(regexp_extract(title,'^Will (.+?) (?:win|beat|defeat) ',1),'')) AS name, close_time FROM markets_k),
 pr AS (SELECT x.fight_id, x.pm_id, fk.d, fk.era, fk.tickers, fp.named, CASE WHEN len(fp.fighters_pm)>0 THEN fp.fighters_pm ELSE fp.outcomes END AS who FROM xw x JOIN fk USING (fight_id) JOIN fp USING (pm_id) WHERE x.match_confidence='exact'),
 tk AS (SELECT fight_id, unnest(tickers) AS ticker, unnest(range(len(tickers))) AS pos FROM pr), sc AS (SELECT pr.fight_id, tk.ticker, tk.pos, tn.close_time, coalesce(len(list_intersect({_sql_words("who[1]")}, {_sql_words("tn.name")})),0) AS s0, coalesce(len(list_intersect({_sql_words("who[2]")}, {_sql_words("tn.name")})),0) AS s1 FROM pr JOIN tk USING (fight_id) LEFT JOIN tn USING (ticker)),
 be AS (SELECT fight_id, arg_max(ticker,(s0,-pos)) AS t0, max(s0) AS m0, arg_max(ticker,(s1,-pos)) AS t1 FROM sc GROUP BY fight_id),
 sd AS (SELECT pr.*, m0, m0=0 AND len(tickers)>=2 AS flip, CASE WHEN m0=0 AND len(tickers)>=2 AND era='live' AND len(who)>=2 THEN t1 ELSE t0 END AS yes_ticker FROM pr JOIN be USING (fight_id)),
 cl AS (SELECT sd.fight_id, arg_min(sc.close_time, (sc.ticker<>sd.yes_ticker, sc.pos)) FILTER (sc.close_time IS NOT NULL) AS close FROM sd JOIN sc USING (fight_id) GROUP BY sd.fight_id)"""


def _sides(spark, sf):
    k = table(spark, sf, "fights_k").select("fight_id", F.try_to_date(F.substring("fight_id", 1, 8), "yyyyMMdd").alias("d"), "era", "tickers")
    p = _market_sides(spark, sf).select("pm_id", "named", F.when(F.size("fighters_pm") > 0, F.col("fighters_pm")).otherwise(F.col("outcomes")).alias("who"))
    pairs = _crosswalk(spark, sf).where("match_confidence = 'exact'").join(k, "fight_id").join(p, "pm_id")
    names = table(spark, sf, "markets_k").select("ticker", X.title_name(F.col("title")).alias("name"), "close_time")
    return match.sides(pairs, names, alt_era="live")


@query("WITH " + _SIDES + " SELECT sd.fight_id, sd.pm_id, yes_ticker, flip, CASE WHEN flip AND len(who)>=2 THEN who[2] ELSE who[1] END AS pm_outcome, m0::INT AS name_score, CASE WHEN len(named)>0 THEN 'named_outcome' ELSE 'slug_position' END AS side_method FROM sd")
def q84_yes_sides(spark, sf):
    """Which ticker and which outcome are the same side of a bout, and how that is known."""
    return _sides(spark, sf).select("fight_id", "pm_id", "yes_ticker", "flip", "pm_outcome", "name_score", "side_method")


@query("WITH " + _SIDES + ", te AS (SELECT sd.fight_id, epoch_us(coalesce(close, CAST(d AS TIMESTAMP) AT TIME ZONE 'UTC' + INTERVAL 30 HOUR))//1000000 - 3600 AS e FROM sd JOIN cl USING (fight_id)) SELECT fight_id, e - e % 300 AS t_end, e - e % 300 - 259200 AS t_start FROM te WHERE e IS NOT NULL")
def q85_fight_windows(spark, sf):
    """Window of a bout: 72 hours up to an hour before its market closes; without a closing time, 30 hours after its day began."""
    e = bars.floor_to(F.unix_seconds(F.coalesce("close", F.col("d").cast("timestamp") + F.expr("interval 30 hours"))) - 3600, 300)
    return _sides(spark, sf).select("fight_id", e.alias("t_end"), (e - 259200).alias("t_start")).where("t_end is not null")


@query("WITH " + _SIDES + " SELECT CASE WHEN len(named)>0 THEN 'named_outcome' ELSE 'slug_position' END AS side_method, count(*) AS fights, count_if(m0=0)::BIGINT AS no_overlap, count_if(flip)::BIGINT AS flipped FROM sd GROUP BY 1")
def q86_side_method_audit(spark, sf):
    return _sides(spark, sf).groupBy("side_method").agg(F.count("*").alias("fights"), F.count_if(F.col("name_score") == 0).alias("no_overlap"), F.count_if("flip").alias("flipped"))


_BOUNDS = ", bo AS (SELECT fight, lo + 10*3600 AS t0, hi - 20*3600 AS t1 FROM ends), gr AS (SELECT fight, unnest(generate_series(t0, t1 - 3600, 3600)) AS bar FROM bo WHERE t1 > t0)"


@query("WITH " + _VENUE + ", ends AS (SELECT fight, min(bar) lo, max(bar) hi FROM vb GROUP BY fight HAVING count(DISTINCT venue)=2)" + _BOUNDS + """, g AS (SELECT gr.fight, gr.bar, k.last kl, k.n kn, p.last pl, p.n pn FROM gr LEFT JOIN k USING (fight, bar) LEFT JOIN p USING (fight, bar)),
 f AS (SELECT *, last_value(kl IGNORE NULLS) OVER w AS kf, last_value(pl IGNORE NULLS) OVER w AS pf FROM g WINDOW w AS (PARTITION BY fight ORDER BY bar ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) SELECT fight, bar, round(kf,6) AS k_last, round(pf,6) AS pm_last, coalesce(kn,0) AS k_n, coalesce(pn,0) AS pm_n FROM f WHERE kf IS NOT NULL OR pf IS NOT NULL""")
def q87_panel_in_window(spark, sf):
    """The panel on each fight's own window, start inclusive, end exclusive; nothing from before is carried in."""
    k, p = _venue(spark, sf)
    ends = k.select("fight", "bar").unionByName(p.select("fight", "bar")).groupBy("fight").agg((F.min("bar") + 10 * HOUR).alias("lo"), (F.max("bar") - 20 * HOUR).alias("hi"))
    return rounded(bars.panel(k, p, HOUR, bounds=ends), "k_last", "pm_last").select("fight", "bar", "k_last", "pm_last", "k_n", "pm_n")


@query("WITH " + _VENUE + ", ends AS (SELECT fight, min(bar) lo, max(bar) hi FROM vb GROUP BY fight HAVING count(DISTINCT venue)=2)" + _BOUNDS + ", pb AS (SELECT vb.* FROM vb JOIN bo USING (fight) WHERE bar >= t1 AND bar < t1 + 5*3600) SELECT coalesce(k.fight, p.fight) AS fight, coalesce(k.bar, p.bar) AS bar, round(k.last,6) AS k_last, coalesce(k.n,0) AS k_n, round(p.last,6) AS pm_last, coalesce(p.n,0) AS pm_n FROM (SELECT * FROM pb WHERE venue='K') k FULL JOIN (SELECT * FROM pb WHERE venue='P') p USING (fight, bar)")
def q88_bars_after_window(spark, sf):
    """Bars after the window's end, as they are: no grid, no fill."""
    k, p = _venue(spark, sf)
    ends = k.select("fight", "bar").unionByName(p.select("fight", "bar")).groupBy("fight").agg((F.max("bar") - 20 * HOUR).alias("t1"))
    ends = ends.join(k.select("fight").distinct(), "fight", "left_semi").join(p.select("fight").distinct(), "fight", "left_semi")
    side = lambda d, n: d.join(ends, "fight").where((F.col("bar") >= F.col("t1")) & (F.col("bar") < F.col("t1") + 5 * HOUR)).select("fight", "bar", F.round("last", 6).alias(f"{n}_last"), F.col("n").alias(f"{n}_n"))
    return side(k, "k").join(side(p, "pm"), ["fight", "bar"], "full_outer").na.fill(0, ["k_n", "pm_n"])


# -- regressions --------------------------------------------------------------
_DRIFT = ", cal AS (SELECT DISTINCT ticker, epoch_us(CAST(card AS TIMESTAMP))//1000000 + 43200 AS t0, card FROM tape), dr AS (SELECT cal.ticker, cal.card, arg_max(price,(t,trade_id)) FILTER (t<=t0+14400) - arg_max(price,(t,trade_id)) FILTER (t<t0) AS x, arg_max(price,(t,trade_id)) FILTER (t<=t0+86400) - arg_max(price,(t,trade_id)) FILTER (t<=t0+14400) AS y FROM cal JOIN tape ON cal.ticker=tape.ticker AND t BETWEEN t0-21600 AND t0+86400 GROUP BY cal.ticker, cal.card, t0)"


@query("WITH " + TAPE_SQL + _DRIFT + """, lo AS (SELECT 'all' AS series, * FROM dr UNION ALL SELECT CAST(ticker AS VARCHAR), * FROM dr), o AS (SELECT series, card, x, y FROM lo WHERE x IS NOT NULL AND y IS NOT NULL),
 c AS (SELECT series, card, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY series)), b AS (SELECT *, sum(u*u) OVER w AS s, sum(u*v) OVER w/nullif(sum(u*u) OVER w,0) AS b FROM c WINDOW w AS (PARTITION BY series)),
 cs AS (SELECT series, card, any_value(n) n, any_value(s) s, any_value(b) b, sum(u*(v-b*u)) AS sc, sum(power((v-b*u)/(1-1.0/n-u*u/s),2)*u*u) AS h FROM b GROUP BY series, card)
 SELECT series, any_value(n) AS n, count(*) AS clusters, CASE WHEN count(*)>=5 THEN 'cluster' ELSE 'HC3' END AS errors, round(any_value(b),6) AS beta, round(CASE WHEN count(*)>=5 THEN sqrt(sum(sc*sc)*count(*)/(count(*)-1)*any_value(n)*1.0/nullif(any_value(n)-2,0)) ELSE sqrt(sum(h)) END/any_value(s),6) AS se FROM cs GROUP BY series""")
def q89_drift_regressions(spark, sf):
    """Later on earlier drift around events, pooled and by series: clustered errors from five clusters on, else HC3."""
    t = tape(spark, sf)
    cal = t.select(F.col("ticker").alias("tk"), "card", (F.unix_seconds(F.col("card").cast("timestamp")) + 43200).alias("t0")).distinct()
    j = asof.event_windows(cal, t.drop("card"), 21600, 86400).where("tk = ticker")
    at = F.struct("t", "trade_id")
    upto = lambda c: F.max_by("price", F.when(c, at))
    m = j.groupBy("ticker", "card", "t0").agg(upto(F.col("t") < F.col("t0")).alias("pre"), upto(F.col("t") <= F.col("t0") + 14400).alias("p4"), upto(F.col("t") <= F.col("t0") + 86400).alias("p24"))
    m = m.select("card", (F.col("p4") - F.col("pre")).alias("x"), (F.col("p24") - F.col("p4")).alias("y"), F.explode(F.array(F.lit("all"), F.col("ticker").cast("string"))).alias("series"))
    return rounded(stats.clustered_or_hc3(m, "x", "y", ["series"], "card"), "beta", "se")


@query("WITH " + _RET + ", d AS (SELECT ofi_z, dp_contemp, dp_1 FROM z WHERE ofi_z IS NOT NULL AND dp_contemp IS NOT NULL AND dp_1 IS NOT NULL), f AS (SELECT regr_slope(dp_contemp, ofi_z) b, regr_intercept(dp_contemp, ofi_z) a FROM d), r AS (SELECT dp_contemp - a - b*ofi_z AS shock, dp_1 FROM d, f) SELECT count(*) AS n, round(regr_slope(dp_1, shock),8) AS beta, round(corr(dp_1, shock),6) AS rho FROM r")
def q90_residual_shock(spark, sf):
    """Response to what a shock has beyond another one: its residual on that."""
    d = _ret(spark, sf).where("ofi_z is not null and dp_contemp is not null and dp_1 is not null")
    f = d.agg(F.regr_slope("dp_contemp", "ofi_z").alias("b"), F.regr_intercept("dp_contemp", "ofi_z").alias("a"))  # one row
    r = d.crossJoin(F.broadcast(f)).select((F.col("dp_contemp") - F.col("a") - F.col("b") * F.col("ofi_z")).alias("shock"), "dp_1")
    return r.agg(F.count("*").alias("n"), F.round(F.regr_slope("dp_1", "shock"), 8).alias("beta"), F.round(F.corr("dp_1", "shock"), 6).alias("rho"))


# -- ladders ------------------------------------------------------------------
@query("WITH " + TAPE_SQL + " SELECT ticker AS contract, t - t % 21600 AS at, CAST(floor(price*10) AS DOUBLE) AS strike, round(arg_max(price,(t,trade_id)),6) AS last, round(sum(price*size)/sum(size),6) AS vwap, round(sum(size),4) AS volume FROM tape GROUP BY ALL")
def q91_ladder_6h_last_vwap(spark, sf):
    t = tape(spark, sf).select(F.col("ticker").alias("contract"), bars.floor_to(F.col("t"), 21600).alias("date"), F.floor(F.col("price") * 10).cast("double").alias("strike"), "price", "size", F.struct("t", "trade_id").alias("ord"))
    return rounded(rounded(ladders.daily(t), "last", "vwap"), "volume", digits=4).withColumnRenamed("date", "at")


def _grid_sql(x: str) -> str:
    """The CTEs from masses to pmf over another repair, each under a name of its own."""
    pmf = _PMF[_PMF.index(", al AS") :].replace("middle AS p FROM mono", f"{x} AS p FROM mono")
    return re.sub(r"\b(al|ma|en|fu|filled|pmf)\b", rf"\1_{x}", pmf)


@query("WITH " + _MONO + "".join(map(_grid_sql, ("ltr", "rtl", "middle")))
 + ", mu AS (" + " UNION ALL ".join(f"SELECT '{x}' AS cleaning, contract, date, sum(strike*probability)/sum(probability) AS mu FROM pmf_{x} GROUP BY ALL" for x in ("ltr", "rtl", "middle")) + ") SELECT cleaning, contract, count(*) AS ladders, round(avg(mu),6) AS mean_of_means FROM mu GROUP BY ALL")
def q92_cleaning_grid(spark, sf):
    """The same ladders under each monotone repair, side by side."""
    m = ladders.monotone(_dense(spark, sf))
    each = [ladders.moments(ladders.pmf(m, x)).select(F.lit(x).alias("cleaning"), "contract", "mean") for x in ("ltr", "rtl", "middle")]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("cleaning", "contract").agg(F.count("*").alias("ladders"), F.round(F.avg("mean"), 6).alias("mean_of_means"))


_TAILS = _PMF + ", c AS (SELECT contract, date, strike, probability, sum(probability) OVER (PARTITION BY contract, date ORDER BY strike) AS cum, sum(probability) OVER (PARTITION BY contract, date) AS t FROM pmf), ta AS (SELECT contract, date, min(strike) FILTER (cum>=0.25*t-1e-9) AS p25, min(strike) FILTER (cum>=0.75*t-1e-9) AS p75, sum(probability) FILTER (strike>40) AS tail FROM c GROUP BY contract, date)"


@query("WITH " + _TAILS + ", a AS (SELECT date, p25 AS p25_af, tail AS tail_af FROM ta WHERE contract='AF'), n AS (SELECT date, p75 AS p75_no, tail AS tail_no FROM ta WHERE contract='NO'), r AS (SELECT date, tail AS tail_rf FROM ta WHERE contract='RF') SELECT date, p25_af, round(tail_af,6) AS tail_af, p75_no, round(tail_no,6) AS tail_no, round(tail_rf,6) AS tail_rf FROM a FULL JOIN n USING (date) FULL JOIN r USING (date)")
def q93_tails_merge(spark, sf):
    """Tails of three contracts side by side by date, whichever has one."""
    p = ladders.pmf(ladders.monotone(_dense(spark, sf)))
    w = Window.partitionBy("contract", "date")
    c = p.withColumns({"cum": F.sum("probability").over(w.orderBy("strike")), "t": F.sum("probability").over(w)})
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("t") - 1e-9, F.col("strike")))
    ta = c.groupBy("contract", "date").agg(at(0.25).alias("p25"), at(0.75).alias("p75"), F.round(F.sum(F.when(F.col("strike") > 40, F.col("probability"))), 6).alias("tail"))
    one = lambda k, **cols: ta.where(F.col("contract") == k).select("date", *[F.col(v).alias(n) for n, v in cols.items()])
    return one("AF", p25_af="p25", tail_af="tail").join(one("NO", p75_no="p75", tail_no="tail"), "date", "full_outer").join(one("RF", tail_rf="tail"), "date", "full_outer")


@query("WITH " + TAPE_SQL + ", e AS (SELECT fight, max(t) AS hi, arg_max(price,(t,trade_id)) AS fin FROM tape GROUP BY fight), b AS (SELECT tape.fight, h, taker_side, price, fin FROM tape JOIN e USING (fight), (VALUES (6),(12),(24)) v(h) WHERE t > hi - h*3600) SELECT fight, h AS hours, count(*) AS n, round(avg((taker_side='yes' AND fin>price)::INT)/nullif(avg((taker_side='yes')::INT),0),6) AS p_up_given_yes, round(avg(abs(fin-price)),6) AS distance FROM b GROUP BY ALL")
def q94_conditional_by_hours(spark, sf):
    t = tape(spark, sf)
    fin = t.groupBy("fight").agg(F.max("t").alias("hi"), F.max_by("price", F.struct("t", "trade_id")).alias("fin"))
    b = t.join(fin, "fight").withColumn("hours", F.explode(F.array(F.lit(6), F.lit(12), F.lit(24)))).where(F.col("t") > F.col("hi") - F.col("hours") * 3600)
    yes = F.col("taker_side") == "yes"
    up = F.avg((yes & (F.col("fin") > F.col("price"))).cast("int")) / F.nullif(F.avg(yes.cast("int")), F.lit(0.0))
    return b.groupBy("fight", "hours").agg(F.count("*").alias("n"), F.round(up, 6).alias("p_up_given_yes"), F.round(F.avg(F.abs(F.col("fin") - F.col("price"))), 6).alias("distance"))


@query("WITH " + _PMF + ", mu AS (SELECT contract, date, sum(strike*probability)/sum(probability) AS mu FROM pmf GROUP BY ALL) SELECT contract, date, round(mu,6) AS mean, round(mu - lag(mu) OVER (PARTITION BY contract ORDER BY date),6) AS change FROM mu")
def q95_moment_changes(spark, sf):
    m = ladders.moments(ladders.pmf(ladders.monotone(_dense(spark, sf))))
    return m.select("contract", "date", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.lag("mean").over(Window.partitionBy("contract").orderBy("date")), 6).alias("change"))


@query("WITH " + LADDER_SQL + ", en AS (SELECT contract, max(strike) AS strike FROM ladder GROUP BY contract) SELECT l.contract, count(*) AS n, max(l.strike) AS highest FROM ladder l ANTI JOIN en USING (contract, strike) GROUP BY l.contract")
def q96_without_end_bins(spark, sf):
    """Ladders without their last, open-ended bin."""
    li = ladder(spark, sf).select("contract", "strike")
    ends = li.groupBy("contract").agg(F.max("strike").alias("strike"))
    return li.join(ends, ["contract", "strike"], "left_anti").groupBy("contract").agg(F.count("*").alias("n"), F.max("strike").alias("highest"))


# -- joins, sorts, small forms ------------------------------------------------
_BLOCKS = "blocks AS (SELECT block_number, min(fetched_at) AS at FROM pm_trades WHERE block_number IS NOT NULL GROUP BY 1)"


@query("WITH " + _BLOCKS + """, tk AS (SELECT json_extract_string(clob_token_ids, '$[0]') AS token, id AS market, 'yes' AS side FROM markets_p UNION ALL SELECT json_extract_string(clob_token_ids, '$[1]'), id, 'no' FROM markets_p), u AS (SELECT token, min(market) AS market, min(side) AS side FROM tk WHERE token IS NOT NULL GROUP BY token)
 SELECT p.delivery_id, epoch_us(b.at)//1000000 AS at_s, coalesce(m.market, t.market) AS market, coalesce(m.side, t.side) AS side FROM pm_trades p JOIN blocks b USING (block_number) LEFT JOIN u m ON m.token=p.maker_asset_id LEFT JOIN u t ON t.token=p.taker_asset_id""")
def q97_block_times_and_tokens(spark, sf):
    """Fills with the time of their block and the market and side of whichever asset is a known token; a fill of an unknown block would drop out."""
    p = table(spark, sf, "pm_trades").where("block_number is not null").select("delivery_id", "block_number", "maker_asset_id", "taker_asset_id", "fetched_at")
    blocks = p.groupBy("block_number").agg(F.min("fetched_at").alias("at"))
    ids = X.json_list(F.col("clob_token_ids"))
    tokens = table(spark, sf, "markets_p").select(F.col("id").alias("market"), F.posexplode(ids).alias("k", "token")).where("k < 2 and token is not null")
    tokens = tokens.groupBy("token").agg(F.min("market").alias("market"), F.min(F.when(F.col("k") == 0, "yes").otherwise("no")).alias("side"))
    of = lambda c, n: tokens.select(F.col("token").alias(c), F.col("market").alias(f"m{n}"), F.col("side").alias(f"s{n}"))
    d = p.drop("fetched_at").join(blocks, "block_number").join(of("maker_asset_id", 1), "maker_asset_id", "left").join(of("taker_asset_id", 2), "taker_asset_id", "left")
    return d.select("delivery_id", F.unix_seconds("at").alias("at_s"), F.coalesce("m1", "m2").alias("market"), F.coalesce("s1", "s2").alias("side"))


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS f FROM orders WHERE o_orderstatus='F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS o FROM orders WHERE o_orderstatus='O' GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS p FROM orders WHERE o_orderstatus='P' GROUP BY 1), j AS (SELECT k, f, o, p FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)) SELECT count(*) AS keys, count_if(f IS NOT NULL AND o IS NOT NULL)::BIGINT AS complete_two, count_if(f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL)::BIGINT AS complete_three, sum(coalesce(f,0)+coalesce(o,0)+coalesce(p,0))::BIGINT AS orders FROM j")
def q98_full_outer_and_complete(spark, sf):
    """Three tables by key, whichever has it; the rows complete in two and in three."""
    o = table(spark, sf, "orders")
    one = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    j = one("F", "f").join(one("O", "o"), "k", "full_outer").join(one("P", "p"), "k", "full_outer")
    two, three = F.col("f").isNotNull() & F.col("o").isNotNull(), F.col("f").isNotNull() & F.col("o").isNotNull() & F.col("p").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.agg(F.count("*").alias("keys"), F.count_if(two).alias("complete_two"), F.count_if(three).alias("complete_three"), F.sum(zero("f") + zero("o") + zero("p")).alias("orders"))


@query("WITH o AS (SELECT market_id, outcome AS said, count(*) AS n FROM tape_api WHERE outcome IS NOT NULL GROUP BY ALL), m AS (SELECT id AS market_id, unnest(from_json(outcomes,'[\"VARCHAR\"]')) AS known FROM markets_p), e AS (SELECT o.*, m.known FROM o LEFT JOIN m ON m.market_id=o.market_id AND m.known=o.said), l AS (SELECT e.market_id, e.said, e.n, min(m.known) AS known, any_value(e.known) AS exact FROM e LEFT JOIN m ON m.market_id=e.market_id AND lower(m.known)=lower(e.said) GROUP BY ALL) SELECT market_id, said, n, coalesce(exact, known) AS known, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN known IS NOT NULL THEN 'case' ELSE 'none' END AS how FROM l")
def q99_case_fallback(spark, sf):
    """Outcomes met as they are written, else whatever their case."""
    said = table(spark, sf, "tape_api").where("outcome is not null").groupBy("market_id", F.col("outcome").alias("said")).agg(F.count("*").alias("n"))
    known = table(spark, sf, "markets_p").select(F.col("id").alias("market_id"), F.explode(X.json_list(F.col("outcomes"))).alias("known"))
    return match.case_fallback(said, known, ["market_id"], "said", "known")


@query("SELECT market_id, array_to_string(list_sort(list_distinct(list(outcome) FILTER (lower(outcome) NOT IN ('yes','no')))),'|') AS outcomes FROM tape_api GROUP BY market_id")
def q100_sorted_outcomes(spark, sf):
    """Distinct named outcomes of a market in order."""
    o = F.collect_set(F.when(~F.lower("outcome").isin("yes", "no"), F.col("outcome")))
    return table(spark, sf, "tape_api").groupBy("market_id").agg(F.array_join(F.array_sort(o), "|").alias("outcomes")).withColumn("outcomes", F.nullif("outcomes", F.lit("")))


@query("SELECT taker_side, coalesce(taker_book_side,'-') AS book, count(*) AS n, count_if(coalesce(taker_side = taker_outcome_side, false))::BIGINT AS agree FROM tape_live GROUP BY 1, 2")
def q101_cross_tab(spark, sf):
    """How two columns go together, and whether they agree."""
    return table(spark, sf, "tape_live").groupBy("taker_side", F.coalesce("taker_book_side", F.lit("-")).alias("book")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("taker_side") == F.col("taker_outcome_side"), F.lit(False))).alias("agree"))


@query("SELECT ticker, volume, title FROM markets_k WHERE volume IS NOT NULL ORDER BY volume DESC, ticker LIMIT 20")
def q102_largest_markets(spark, sf):
    """A top-20 report."""
    return table(spark, sf, "markets_k").where("volume is not null").select("ticker", "volume", "title").orderBy(F.desc("volume"), "ticker").limit(20)


@query("SELECT id, trim(nullif(regexp_extract(question,'^Will (.+?) (?:win|beat|defeat) ',1),'')) AS asked, regexp_matches(coalesce(slug,''),'(?i)(ufc|mma)') OR regexp_matches(coalesce(question,''),'(?i)(ufc|mma)') AS in_scope FROM markets_p")
def q103_titles_and_scope(spark, sf):
    hit = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("(?i)(ufc|mma)")
    return table(spark, sf, "markets_p").select("id", X.title_name(F.col("question")).alias("asked"), (hit("slug") | hit("question")).alias("in_scope"))


@query("WITH t AS (SELECT a.ticker, epoch_us(a.created_time)//1000000 AS t, epoch_us(m.close_time)//1000000 AS c FROM tape_archive a JOIN markets_k m USING (ticker) WHERE a.created_time IS NOT NULL AND m.close_time IS NOT NULL) SELECT ticker, count_if(c - t > 72*3600)::BIGINT AS early, count_if(c - t <= 72*3600)::BIGINT AS late FROM t GROUP BY ticker")
def q104_lag_to_expiry(spark, sf):
    t = table(spark, sf, "tape_archive").where("created_time is not null").select("ticker", F.unix_seconds("created_time").alias("t"))
    c = table(spark, sf, "markets_k").where("close_time is not null").select("ticker", F.unix_seconds("close_time").alias("c"))
    early = F.col("c") - F.col("t") > 72 * 3600
    # counted by ticker and second first, so a hot ticker meets its one closing time reduced
    return t.groupBy("ticker", "t").agg(F.count("*").alias("n")).join(c, "ticker").groupBy("ticker").agg(F.sum(F.when(early, F.col("n")).otherwise(0)).alias("early"), F.sum(F.when(~early, F.col("n")).otherwise(0)).alias("late"))


@query("SELECT ticker, CAST(regexp_extract(ticker,'T([0-9.]+)$',1) AS VARCHAR) AS tail, lower(trim(CAST(is_block_trade AS VARCHAR))) IN ('true','1','yes') AS block, count(*) AS n FROM tape_live GROUP BY ALL")
def q105_flags(spark, sf):
    return table(spark, sf, "tape_live").groupBy("ticker", F.regexp_extract("ticker", "T([0-9.]+)$", 1).alias("tail"), X.is_flag(F.col("is_block_trade").cast("string")).alias("block")).agg(F.count("*").alias("n"))



@query("WITH " + _XW + " SELECT x.fight_id, x.pm_id, len(list_filter(fk.a, lambda u: len(list_filter(fp.b, lambda v: length(u)>=4 AND length(v)>=4 AND (contains(u,v) OR contains(v,u))))>0))>0 AS contained FROM xw x JOIN fk USING (fight_id) JOIN fp USING (pm_id)")
def q106_contained_names(spark, sf):
    """Whether a name token of one side contains one of the other, for the pairs of the crosswalk."""
    k = table(spark, sf, "fights_k").select("fight_id", X.name_tokens(F.array_join("fighters_kalshi", " ")).alias("a"))
    p = _market_sides(spark, sf).select("pm_id", "b")
    return _crosswalk(spark, sf).where("pm_id is not null").join(k, "fight_id").join(p, "pm_id").select("fight_id", "pm_id", X.any_contained(F.col("a"), F.col("b")).alias("contained"))


@query("WITH " + _PANEL + " SELECT fight, bar, round(first_value(pm_vwap IGNORE NULLS) OVER (PARTITION BY fight ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),6) AS next_vwap FROM panel")
def q107_backward_fill(spark, sf):
    return _panel(spark, sf).select("fight", "bar", F.round(bars.backward_fill("pm_vwap"), 6).alias("next_vwap"))


@query("WITH " + LADDER_SQL + ", t AS (SELECT 'KX' || contract || '-25-T' || CAST(strike AS VARCHAR) AS ticker FROM ladder) SELECT ticker, TRY_CAST(regexp_extract(ticker,'-T([0-9]+\\.?[0-9]*)',1) AS DOUBLE) AS strike, count(*) AS n FROM t GROUP BY ALL")
def q108_strike_of_ticker(spark, sf):
    t = ladder(spark, sf).select(F.concat(F.lit("KX"), "contract", F.lit("-25-T"), F.col("strike").cast("string")).alias("ticker"))
    return t.groupBy("ticker", X.strike_of(F.col("ticker")).alias("strike")).agg(F.count("*").alias("n"))
