"""Scans, sinks and offline-testable API sources.

Readers take explicit schemas, so nothing is inferred over the data; filters
and projections are left to Catalyst, which pushes them into parquet.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parquet_tree(spark: SparkSession, path: str, schema: str | None = None, glob: str | None = None, lenient: bool = False) -> DataFrame:
    """All parquet files under ``path``; ``glob`` picks file names, ``lenient`` passes over corrupt files."""
    r = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", lenient)
    r = r.option("pathGlobFilter", glob) if glob else r
    return (r.schema(schema) if schema else r).parquet(path)


def dated(spark: SparkSession, path: str, days: Sequence[str], column: str = "date") -> DataFrame:
    """Only the needed days of a folder partitioned by date: partition pruning, no listing of the rest's files."""
    return spark.read.parquet(path).where(F.col(column).isin(*days))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, malformed ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def text_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One value per line, blanks and repeats left out."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def append_by_date(df: DataFrame, path: str, ts: str = "created_time") -> None:
    """Append to a folder partitioned by trade date."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def publish(spark: SparkSession, df: DataFrame, path: str, version: str) -> str:
    """Write a new version beside the old ones and swap the pointer file; refuses a version that exists."""
    target = f"{path}/v={version}"
    df.write.mode("errorifexists").parquet(target)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    fs = p.getFileSystem(conf)
    out = fs.create(p, True)
    out.write(bytearray(version.encode()))
    out.close()
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/v={version}")


def one_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as markdown; refuses more than ``most`` rows rather than cutting them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(df.columns), ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]])


def latex(df: DataFrame, most: int = 200) -> str:
    """A report table as a LaTeX tabular."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    esc = lambda v: ("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("%", r"\%")
    body = " \\\\\n".join(" & ".join(map(esc, r)) for r in [df.columns, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


class Retry:
    """Call again after a busy answer, waiting twice as long each time."""

    def __init__(self, tries: int = 5, first: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.tries, self.first, self.sleep = tries, first, sleep

    def __call__(self, call: Callable[[], tuple[int, str]]) -> str:
        for k in range(self.tries):
            status, body = call()
            if status == 200:
                return body
            if status not in (429, 500, 502, 503) or k == self.tries - 1:
                raise RuntimeError(f"status {status}")
            self.sleep(self.first * 2**k)
        raise RuntimeError("no tries")


def pages(fetch: Callable[[str | None], tuple[int, str]], retry: Retry, items: str, until: Callable[[dict], bool] = lambda x: False) -> Iterator[dict]:
    """Items of a cursor-paged API, page by page; stops at the last page or the first item that ``until`` knows."""
    cursor: str | None = None
    while True:
        body = json.loads(retry(lambda: fetch(cursor)))  # noqa: B023
        for item in body.get(items, []):
            if until(item):
                return
            yield item
        cursor = body.get("cursor")
        if not cursor:
            return


def signed(sign: Callable[[bytes], bytes], key: str, method: str, path: str, at_ms: int) -> dict[str, str]:
    """Headers of a signed request: ``sign`` (the caller's private key) over time, method and path without query."""
    import base64

    text = f"{at_ms}{method.upper()}{path.split('?')[0]}"
    return {"ACCESS-KEY": key, "ACCESS-TIMESTAMP": str(at_ms), "ACCESS-SIGNATURE": base64.b64encode(sign(text.encode())).decode()}


def offset_pages(fetch: Callable[[int], tuple[int, str]], retry: Retry, size: int, until: Callable[[dict], bool] = lambda x: False) -> Iterator[dict]:
    """Items of an API paged by offset, newest first; stops at a page that isn't full or the first item that ``until`` knows."""
    at = 0
    while True:
        items = json.loads(retry(lambda: fetch(at)))  # noqa: B023
        for item in items:
            if until(item):
                return
            yield item
        if len(items) < size:
            return
        at += size


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Daily candles of recorded API answers: one row per market and period; fields an answer lacks are null."""
    side = "struct<open:double,high:double,low:double,close:double>"
    schema = f"struct<market_ticker:string,candlesticks:array<struct<end_period_ts:bigint,yes_bid:{side},yes_ask:{side},price:{side},volume:bigint,open_interest:bigint>>>"
    d = df.select(F.from_json(payload, schema).alias("p")).select("p.market_ticker", F.explode("p.candlesticks").alias("c"))
    sides = [F.col(f"c.{s}.{f}").alias(f"{s}_{f}") for s in ("yes_bid", "yes_ask", "price") for f in ("open", "high", "low", "close")]
    return d.select("market_ticker", F.timestamp_seconds("c.end_period_ts").alias("end_period_utc"), *sides, "c.volume", "c.open_interest")


class PagedReader(DataSourceReader):
    """One partition per market; pages come from files named MARKET.N.json in ``path`` (a recorded API)."""

    def __init__(self, options: dict, schema):
        self.path, self.markets, self.names = options["path"], options["markets"].split(","), [f.name for f in schema.fields]

    def partitions(self):
        return [InputPartition(m) for m in self.markets]

    def read(self, partition):
        from pathlib import Path

        def fetch(cursor: str | None) -> tuple[int, str]:
            at = Path(self.path) / f"{partition.value}.{cursor or 0}.json"
            return (200, at.read_text()) if at.exists() else (200, "{}")

        for item in pages(fetch, Retry(), "trades"):
            yield tuple(item.get(n) if item.get(n) is None or isinstance(item.get(n), str) else json.dumps(item[n]) for n in self.names)


class PagedTrades(DataSource):
    """format("paged_trades"): cursor-paged trades of markets, a market per task, all columns text."""

    @classmethod
    def name(cls) -> str:
        return "paged_trades"

    def schema(self) -> str:
        return "trade_id string, ticker string, created_time string, taker_side string, count_fp string, yes_price_dollars string"

    def reader(self, schema):
        return PagedReader(self.options, schema)
