"""Queries p2 to p6: the general data-cleaning problems over the venues' tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelight.operators import delivery, drift, grid, stamps, units
from tapelight.sources.tables import table


# -- p2: schemas that drift ---------------------------------------------------
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a feed's fields from file to file."""
    return drift.changes(table(spark, sf, "raw_files")).select("feed", "file_seq", "field_name", "change_kind")


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All records as one typed table per venue (a struct column each): renamed fields joined, in one unit and form."""
    return drift.tables(table(spark, sf, "raw_files"))


# -- p3: units ----------------------------------------------------------------
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values not recorded in their column's own unit."""
    live = units.live_quantities(table(spark, sf, "tape_live").select("delivery_id", "yes_price_dollars", "no_price_dollars", "count_fp"))
    arch = units.archive_quantities(table(spark, sf, "tape_archive").select("delivery_id", "yes_price", "no_price"))
    pm = units.notional_quantities(table(spark, sf, "pm_trades").select("delivery_id", "price_yes", "size", "usdc_amount", "outcome", "maker_asset_id", "taker_asset_id", "maker_amount", "taker_amount"))
    entry = lambda name, scale, ok: F.struct(F.lit(name).alias("field_name"), F.when(ok, F.col(scale)).cast("int").alias("scale_exp"))
    fields = F.array(entry("yes_price_dollars", "price_scale", F.col("price_usd").isNotNull() & (F.col("price_scale") != 0)), entry("count_fp", "count_scale", F.col("contracts").isNotNull() & (F.col("count_scale") != 0)))
    live = live.select("delivery_id", F.explode(F.filter(fields, lambda f: f["scale_exp"].isNotNull())).alias("f")).select(F.lit("tape_live").alias("tape"), "delivery_id", "f.field_name", "f.scale_exp")
    arch = arch.where(F.col("price_scale") != -2).select(F.lit("tape_archive").alias("tape"), "delivery_id", F.lit("yes_price").alias("field_name"), F.col("price_scale").cast("int").alias("scale_exp"))
    pm = pm.where(F.col("usdc_scale") != 0).select(F.lit("pm_trades").alias("tape"), "delivery_id", F.lit("usdc_amount").alias("field_name"), F.col("usdc_scale").cast("int").alias("scale_exp"))
    return live.unionByName(arch).unionByName(pm)


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Per tape: how much was traded, in dollars and contracts, once every value is in its canonical unit."""
    live = units.live_quantities(table(spark, sf, "tape_live").select("yes_price_dollars", "no_price_dollars", "count_fp")).select(F.lit("tape_live").alias("tape"), "price_usd", "contracts", F.lit(None).cast("double").alias("usdc"))
    arch = units.archive_quantities(table(spark, sf, "tape_archive").select("yes_price", "no_price", "n_contracts")).select(F.lit("tape_archive").alias("tape"), "price_usd", F.col("n_contracts").cast("double").alias("contracts"), F.lit(None).cast("double").alias("usdc"))
    pm = units.notional_quantities(table(spark, sf, "pm_trades").select("price_yes", "size", "usdc_amount", "outcome", "maker_asset_id", "taker_asset_id", "maker_amount", "taker_amount")).select(F.lit("pm_trades").alias("tape"), F.col("price_yes").alias("price_usd"), F.col("size").alias("contracts"), "usdc")
    return live.unionByName(arch).unionByName(pm).groupBy("tape").agg(F.count("price_usd").alias("priced"), F.round(F.avg("price_usd"), 6).alias("mean_price_usd"), F.round(F.sum("contracts"), 2).alias("contracts"), F.round(F.sum("usdc"), 2).alias("usdc"))


# -- p4: messages delivered more than once ------------------------------------
def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    live = delivery.deliveries(table(spark, sf, "tape_live"), "tape_live", delivery.hex_id(F.col("trade_id")))
    arch = delivery.deliveries(table(spark, sf, "tape_archive"), "tape_archive", delivery.hex_id(F.col("trade_id")))
    key = F.concat(delivery.whole_id(F.col("market_id")), F.lit("|"), delivery.hex_id(F.col("tx_hash")), F.lit("|"), F.col("log_index").cast("string"))
    return live.unionByName(arch).unionByName(delivery.deliveries(table(spark, sf, "pm_trades"), "pm_trades", key))


def _ledger(spark: SparkSession, rows: DataFrame, share: float = 0.1) -> delivery.Ledger:
    """The tapes' history, then their latest ``share`` of the time span merged into it as a batch."""
    span = rows.groupBy("tape").agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi"))
    cut = {r["tape"]: r["hi"] - (r["hi"] - r["lo"]) * share for r in span.collect() if r["hi"]}  # a row per tape
    late = F.coalesce(*[F.when(F.col("tape") == t, F.col("fetched_at") > F.lit(at)) for t, at in cut.items()], F.lit(False)) if cut else F.lit(False)
    store = delivery.Ledger(spark)
    store.merge(rows.where(~F.coalesce(late, F.lit(True))))
    store.merge(rows.where(F.coalesce(late, F.lit(True))))
    return store


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries that are a later copy of their message."""
    rows = _deliveries(spark, sf)
    return delivery.copies(rows, _ledger(spark, rows).read())


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The delivery kept of each message, from the ledger."""
    return _ledger(spark, _deliveries(spark, sf)).read().select("tape", "delivery_id")


# -- p5: regular grid ---------------------------------------------------------
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    arch = units.archive_quantities(table(spark, sf, "tape_archive").select("delivery_id", "ticker", "created_time", "yes_price", "no_price", "n_contracts"))
    arch = arch.where(F.col("price_usd").isNotNull()).select(F.concat(F.lit("tape_archive|"), F.col("ticker")).alias("key"), F.col("created_time").alias("ts"), F.col("price_usd").alias("price"), F.col("n_contracts").cast("double").alias("qty"), F.col("delivery_id").cast("string").alias("tie"))
    api = table(spark, sf, "tape_api").where(F.col("price_yes").isNotNull() & ~F.isnan("price_yes"))
    api = api.select(F.concat(F.lit("tape_api|"), F.col("market_id")).alias("key"), F.col("ts_utc").alias("ts"), F.col("price_yes").alias("price"), F.col("size").alias("qty"), F.concat_ws("|", "tx_hash", "token_id").alias("tie"))
    rows = arch.unionByName(api).where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    return grid.counter_grid(grid.running_counter(rows, "key", "ts", F.col("qty"), "tie"), "key", "ts", "counter", "tie", "price")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Silent bars between the first and the last priced bar of each series."""
    key = F.split("series", r"\|", 2)
    return _grid(spark, sf).where(~F.col("covered")).select(key[0].alias("tape"), key[1].alias("series_key"), F.col("cell_s").alias("bar_s"))


def p5_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The full five-minute series: price carried over silent bars, contracts spread over them."""
    key = F.split("series", r"\|", 2)
    return _grid(spark, sf).select(key[0].alias("tape"), key[1].alias("series_key"), F.col("cell_s").alias("bar_s"), "covered", "n", F.round("filled_value", 6).alias("price"), F.round("increment", 6).alias("contracts"))


# -- p6: stamps ---------------------------------------------------------------
def _stamps(spark: SparkSession, sf: str, every: bool) -> DataFrame:
    homes = F.broadcast(table(spark, sf, "collectors"))  # a fixed table of eight collectors
    zones = stamps.known_zones(spark)
    tapes = []
    for tape, col in (("tape_live", "created_time"), ("pm_trades", "ts_utc")):
        rows = table(spark, sf, tape).select("delivery_id", F.col(col).alias("stamp"), "collector", "fetched_at")
        rows = rows.where(F.col("stamp").isNotNull())
        rows = rows if every else rows.where(~F.col("stamp").rlike(stamps.CANONICAL))
        rows = rows.select(F.lit(f"{tape}.{col}").alias("tbl"), F.col("delivery_id").cast("string").alias("rec_key"), "stamp", "collector", "fetched_at")
        tapes.append(rows)
    both = tapes[0].unionByName(tapes[1]).join(homes, "collector", "left")
    both = stamps.parse(both, "stamp", F.col("home_zone"), F.col("date_order"), F.col("fetched_at"), zones)
    out = both.select("tbl", "rec_key", F.floor(F.col("_t_us") / F.lit(1_000_000)).cast("bigint").alias("utc_s"))
    fights = table(spark, sf, "fights_k").where(F.col("event_date").isNotNull())
    fights = fights if every else fights.where(~F.col("event_date").rlike(stamps.CANONICAL_DATE))
    # the id starts with the date, which settles the order of an all-number one
    first = F.substring("fight_id", 5, 4)
    mdy = F.regexp_extract("event_date", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]", 1)
    dmy = F.regexp_extract("event_date", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]", 2)
    order = F.when(first == F.concat(F.lpad(mdy, 2, "0"), F.lpad(dmy, 2, "0")), "MDY").otherwise("DMY")
    fights = stamps.parse(fights.select("fight_id", "event_date", order.alias("ord")), "event_date", F.lit("UTC"), F.col("ord"), None, zones)
    fights = fights.select(F.lit("fights_k.event_date").alias("tbl"), F.col("fight_id").alias("rec_key"), (F.col("_t_day") * 86400).alias("utc_s"))
    return out.unionByName(fights).where(F.col("utc_s").isNotNull())


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps that denote an instant in another form than the canonical one."""
    split = F.split("tbl", r"\.")
    return _stamps(spark, sf, every=False).select(split[0].alias("tbl"), "rec_key", "utc_s")


def p6_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every stamp as canonical UTC text."""
    return _stamps(spark, sf, every=True).select("tbl", "rec_key", stamps.utc_text(F.col("utc_s") * 1_000_000).alias("utc"))


QUERIES = {f.__name__: f for f in (p2_found, p2_unified, p3_found, p3_canonical, p4_found, p4_kept, p5_found, p5_grid, p6_found, p6_all)}

def _hex_sql(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})),'^[^0-9a-z]*0x',''),'[^0-9a-f]','','g'),'^0+(.)','\\1'),'')"


_MESSAGES = f"""messages AS (SELECT 'tape_live' AS tape, {_hex_sql('trade_id')} AS k, delivery_id, fetched_at FROM tape_live UNION ALL SELECT 'tape_archive', {_hex_sql('trade_id')}, delivery_id, fetched_at FROM tape_archive
 UNION ALL SELECT 'pm_trades', CAST(TRY_CAST(trim(market_id) AS DOUBLE) AS BIGINT)::VARCHAR || '|' || {_hex_sql('tx_hash')} || '|' || log_index, delivery_id, fetched_at FROM pm_trades),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY tape, k, CASE WHEN k IS NULL THEN delivery_id END ORDER BY fetched_at NULLS LAST, delivery_id) AS rn FROM messages)"""
_PRICED = """priced AS (SELECT 'tape_archive' AS tape, ticker AS series_key, epoch_us(created_time)//300000000*300 AS bar FROM tape_archive WHERE yes_price IS NOT NULL AND ticker IS NOT NULL AND created_time IS NOT NULL
 UNION ALL SELECT 'tape_api', market_id, epoch_us(ts_utc)//300000000*300 FROM tape_api WHERE price_yes IS NOT NULL AND NOT isnan(price_yes) AND market_id IS NOT NULL AND ts_utc IS NOT NULL),
 span AS (SELECT tape, series_key, min(bar) lo, max(bar) hi FROM priced GROUP BY ALL), grid AS (SELECT tape, series_key, unnest(generate_series(lo, hi, 300)) AS bar_s FROM span)"""
#: Readings with the contracts each adds, spread over the cells since the reading before it by their share of that time.
_READ = """ra AS (SELECT 'tape_archive' AS tape, ticker AS series_key, epoch_us(created_time) AS t, CAST(delivery_id AS VARCHAR) AS tie, CASE WHEN yes_price IS NULL THEN NULL WHEN abs((yes_price+no_price)/1e2-1)<=0.0011 THEN yes_price/1e2
  WHEN abs((yes_price+no_price)/1e3-1)<=0.0011 THEN yes_price/1e3 WHEN abs((yes_price+no_price)/1e4-1)<=0.0011 THEN yes_price/1e4 WHEN abs(yes_price+no_price-1)<=0.0011 THEN CAST(yes_price AS DOUBLE)
  WHEN abs(yes_price)<=100 THEN yes_price/1e2 WHEN abs(yes_price)<=1000 THEN yes_price/1e3 WHEN abs(yes_price)<=10000 THEN yes_price/1e4 ELSE yes_price/1e2 END AS price, CAST(n_contracts AS DOUBLE) AS q FROM tape_archive
 UNION ALL SELECT 'tape_api', market_id, epoch_us(ts_utc), concat_ws('|', tx_hash, token_id), CASE WHEN NOT isnan(price_yes) THEN price_yes END, CASE WHEN NOT isnan(size) THEN size END FROM tape_api),
 rb AS (SELECT *, t//300000000 AS cell FROM ra WHERE price IS NOT NULL AND series_key IS NOT NULL AND t IS NOT NULL), rc AS (SELECT *, lag(t) OVER w AS pt, lag(cell) OVER w AS pc FROM rb WINDOW w AS (PARTITION BY tape, series_key ORDER BY t, tie)),
 sp AS (SELECT tape, series_key, unnest(generate_series(pc, cell)) AS ce, t, pt, coalesce(q,0) AS q, pc=cell AS inner_ FROM rc WHERE pt IS NOT NULL),
 inc AS (SELECT tape, series_key, ce, sum(CASE WHEN inner_ THEN q WHEN t=pt THEN 0 ELSE q*greatest(least((ce+1)*300000000, t)-greatest(ce*300000000, pt),0)/(t-pt) END) AS inc FROM sp GROUP BY ALL),
 own AS (SELECT tape, series_key, cell AS ce, count(*) AS n, arg_max(price,(t,tie)) AS last FROM rb GROUP BY ALL),
 al AS (SELECT tape, series_key, unnest(generate_series(min(cell), max(cell))) AS ce FROM rb GROUP BY tape, series_key)"""
ORACLE: dict[str, str] = {
    "p5_grid": "WITH " + _READ + " SELECT al.tape, al.series_key, al.ce*300 AS bar_s, own.n IS NOT NULL AS covered, coalesce(own.n,0) AS n, round(last_value(own.last IGNORE NULLS) OVER (PARTITION BY al.tape, al.series_key ORDER BY al.ce),6) AS price, round(coalesce(inc.inc,0),6) AS contracts FROM al LEFT JOIN own USING (tape, series_key, ce) LEFT JOIN inc USING (tape, series_key, ce)",
    "p4_found": "WITH " + _MESSAGES + " SELECT tape, delivery_id FROM ranked WHERE rn > 1",
    "p4_kept": "WITH " + _MESSAGES + " SELECT tape, delivery_id FROM ranked WHERE rn = 1",
    "p5_found": "WITH " + _PRICED + " SELECT tape, series_key, bar_s FROM grid g WHERE NOT EXISTS (SELECT 1 FROM priced p WHERE p.tape = g.tape AND p.series_key = g.series_key AND p.bar = g.bar_s)",
}
