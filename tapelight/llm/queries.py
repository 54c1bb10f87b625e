"""Queries of the training-text operators: p1 and p7 to p9."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelight.llm import encoding, leaks, linkage, packing
from tapelight.operators import stamps
from tapelight.sources.tables import table

#: Folder of public tokenizer files; a parameter, never copied here.
TOKENIZERS = os.environ.get("TAPELIGHT_TOKENIZERS", "/opt/tokenizers")


def _bouts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    titles = table(spark, sf, "markets_k").select("ticker", "title")
    fk = table(spark, sf, "fights_k")
    titled = fk.select("fight_id", F.explode("tickers").alias("ticker")).join(titles, "ticker").groupBy("fight_id").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    fk = stamps.parse(fk.join(titled, "fight_id", "left"), "event_date", F.lit("UTC"), F.lit("DMY"))
    day = F.coalesce(F.when(F.col("fight_id").rlike(r"^20\d\d(0[1-9]|1[0-2])[0-3]\d"), F.unix_date(F.try_to_date(F.substring("fight_id", 1, 8), "yyyyMMdd"))).cast("bigint"), F.col("_t_day"))
    left = fk.select(F.col("fight_id").alias("id"), F.array("fighters_kalshi").alias("lists"), "titles", F.array_compact(F.array(day)).alias("days"))
    mp = table(spark, sf, "markets_p").select(F.col("id").alias("pm_id"), "question", "end_date")
    fp = table(spark, sf, "fights_p").join(mp, "pm_id", "left")
    slug = F.unix_date(F.try_to_date(F.regexp_extract("pm_slug", r"(20\d\d-\d\d-\d\d)", 1), "yyyy-MM-dd"))
    stated = F.array_distinct(F.array_compact(F.array(F.unix_date("pm_fight_date"), slug)))
    closing = F.unix_date(F.to_date(F.col("end_date") - F.expr("interval 20 hours")))
    days = F.when(F.size(stated) > 0, stated).otherwise(F.array_compact(F.array(closing)))
    right = fp.select(F.col("pm_id").alias("id"), F.array("fighters_pm", "outcomes").alias("lists"), F.array("question", F.regexp_replace(F.regexp_replace("pm_slug", r"^(will|ufc)-|-in-mma-bout.*$", ""), "-(vs|beat)-", " vs ")).alias("titles"), F.transform(days, lambda d: d.cast("bigint")).alias("days"))
    return linkage.bouts(left, around=1, moved=21), linkage.bouts(right, around=0)


def p1_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each market with the fight it is about, and a confidence."""
    return linkage.link(*_bouts(spark, sf)).select(F.col("k").alias("fight_id"), F.col("p").alias("pm_id"), "confidence")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The matched pairs."""
    return p1_matches(spark, sf).select("fight_id", "pm_id")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every text or piece of one with its container of 2,048 tokens."""
    return packing.packed(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share twelve consecutive words with a test item."""
    return leaks.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were decoded with the wrong encoding, in whole or part."""
    return p9_restored(spark, sf).select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return encoding.repaired(documents, encoding.train(documents)).where("affected").select("doc_id", "restored", "chains")


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p7_containers, p8_found, p9_found, p9_restored)}
ORACLE: dict[str, str] = {}
