"""Adapters that present the driver's star-schema tables as tapes, ladders and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelight.sources.tables import table


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """events as a trade tape of twenty tickers on two venues."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ticker = F.col("user_id") % 20
    return e.select(
        F.col("event_id").alias("trade_id"), ticker.alias("ticker"), F.floor(ticker / 2).cast("bigint").alias("fight"), F.to_date("ts").alias("card"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "K").otherwise("P").alias("venue"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("taker_side"), ((k + 0.5) / 100).alias("price"), F.col("value").alias("size"), F.unix_seconds("ts").alias("t"), "ts",
    )


TAPE_SQL = """tape AS (SELECT event_id AS trade_id, user_id % 20 AS ticker, (user_id % 20) // 2 AS fight, CAST(ts AS DATE) AS card,
  CASE WHEN event_type IN ('click','view','signup') THEN 'K' ELSE 'P' END AS venue, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS taker_side,
  (k + 0.5) / 100 AS price, value AS size, epoch_us(ts) // 1000000 AS t, ts FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as trades of strike ladders, one contract per flag and status, prices 1 to 99."""
    li = table(spark, sf, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("contract"), F.trunc("l_shipdate", "month").alias("date"), F.col("l_quantity").cast("double").alias("strike"),
        (1 + cents % 99).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"),
        F.struct(F.unix_seconds("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


LADDER_SQL = """ladder AS (SELECT l_returnflag || l_linestatus AS contract, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS strike,
  CAST(1 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 99 AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS size,
  (epoch_us(l_shipdate) // 1000000, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem)"""
