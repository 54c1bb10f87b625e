"""At-least-once deliveries -> exactly one copy per message, kept in a ledger.

A ledger holds the single winner of every message in partitions by tape and
month of receipt, and an identifier index: the 64-bit hashes of message keys
with the partition they went to, in ``buckets`` hash buckets. A merge

1. reduces the incoming batch to one row per message, once,
2. looks its hashes up in the index, of which only the buckets the batch
   touches are read; that names the affected historical partitions (a hash
   collision or an entry that has been overtaken only names one too many),
3. combines those partitions with the incoming rows and recomputes the
   winners on the full keys,
4. writes the affected partitions as a new version, appends the batch's
   hashes to the index and publishes the next manifest.

A version's folder has a name of its own, and a manifest is put in place by a
rename that fails if another writer was first: then the merge starts again
from that writer's state. So a reader sees all of a merge or nothing, no
merge is lost, and one that died half way leaves only folders that no
manifest names, wherever it died; it is simply run again.

Partitions that no incoming message touches are neither read nor rewritten.
The number of files of a partition follows its size (rebalanced writes). The
winner is the earliest receipt, ties to the smallest delivery id, a minimum,
so partial aggregation reduces hot messages before the shuffle, and merging a
batch twice changes nothing.

Defined results: a row whose identifier is null in any part can't be told
from another message, so it stays as it is, known by its delivery id, and is
never a copy; a null receipt time counts as latest. An empty batch is no
change.
"""

from __future__ import annotations

import functools
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelight.session import delete, discard, scratch, written

SCHEMA = "tape string, msg_key string, delivery_id bigint, fetched_at timestamp"


def hex_id(c: Column) -> Column:
    """Canonical form of a hexadecimal id: case, braces, dashes, blanks, a 0x prefix and leading zeros don't count."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[^0-9a-z]*0x", ""), "[^0-9a-f]", "")
    return F.when(t != "", F.regexp_replace(t, "^0+(?=.)", ""))


def whole_id(c: Column) -> Column:
    """Canonical form of a whole-number id: blanks, sign, leading zeros, grouping and a zero fraction don't count."""
    t = F.regexp_extract(F.regexp_replace(c, r"[\s,_+']", ""), r"^0*(\d+?)(?:\.0*)?$", 1)
    return F.when(t != "", t)


def deliveries(df: DataFrame, tape: str, key: Column) -> DataFrame:
    """The narrow rows a ledger works on."""
    return df.select(F.lit(tape).alias("tape"), key.alias("msg_key"), "delivery_id", "fetched_at")


def winners(df: DataFrame) -> DataFrame:
    """One row per (tape, msg_key): earliest receipt, then smallest delivery id; rows without key each stay."""
    never = F.lit("9999-12-31").cast("timestamp")
    first = F.min(F.struct(F.coalesce(F.col("fetched_at"), never).alias("t"), F.col("delivery_id").alias("d")))
    alone = F.when(F.col("msg_key").isNull(), F.col("delivery_id"))
    return df.groupBy("tape", "msg_key", alone.alias("alone")).agg(first.alias("w")).select("tape", "msg_key", F.col("w.d").alias("delivery_id"), F.col("w.t").alias("fetched_at"))


class Conflict(RuntimeError):
    """Another writer published first."""


class Ledger:
    """Exactly-once store in ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str | None = None, grain: str = "yyyyMM", buckets: int = 64, runs: int = 16):
        """``grain`` is the date pattern of a partition; the index has ``buckets`` and is rewritten as one when it has grown to ``runs`` appended pieces."""
        self.spark, self.path, self.grain, self.buckets, self.runs = spark, path or scratch(spark, "ledger"), grain, buckets, runs
        self.fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def manifest(self) -> dict:
        """{"version": n, "parts": {part: folder}, "index": [folder]}; one entry per month and tape, so its size follows the calendar only."""
        if not self.fs.exists(self._hadoop(self.path)):
            return {"version": 0, "parts": {}, "index": []}
        names = [f.getPath().getName() for f in self.fs.listStatus(self._hadoop(self.path))]
        last = max((n for n in names if n.startswith("manifest-") and n.endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "parts": {}, "index": []}
        stream = self.fs.open(self._hadoop(f"{self.path}/{last}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Publish, if no other writer has published this version."""
        new, at = self._hadoop(f"{self.path}/{uuid.uuid4().hex}.tmp"), self._hadoop(f"{self.path}/manifest-{manifest['version']:012d}.json")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(new, at, options)
        except Py4JJavaError as e:
            self.fs.delete(new, False)
            if self.fs.exists(at):
                raise Conflict(at.getName()) from e
            raise

    def _part(self) -> Column:
        return F.concat_ws("-", "tape", F.date_format("fetched_at", self.grain))

    def _read(self, parts: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/winners/{v}/part={p}" for p, v in parts.items()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _affected(self, incoming: DataFrame, manifest: dict) -> list[str]:
        """The partitions that hold a message of ``incoming``, and those that its rows are new to."""
        touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # at most ``buckets``
        paths = [p for v in manifest["index"] for b in touched if self.fs.exists(self._hadoop(p := f"{self.path}/index/{v}/bucket={b}"))]
        # at most one name per tape and month comes to the driver
        named = incoming.select("part").distinct()
        if paths:
            named = named.union(self.spark.read.schema("h bigint, part string").parquet(*paths).join(incoming.select("h"), "h", "left_semi").select("part").distinct()).distinct()
        return sorted({r[0] for r in named.collect()} & set(manifest["parts"]))

    def _write(self, rows: DataFrame, folder: str) -> list[str]:
        """Write winners by partition, as many files each as its size takes; returns the partitions."""
        rows.withColumn("part", self._part()).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/winners/{folder}")
        found = self.fs.listStatus(self._hadoop(f"{self.path}/winners/{folder}"))
        return sorted(s.getPath().getName()[5:] for s in found if s.getPath().getName().startswith("part="))

    def _index(self, incoming: DataFrame, known: list[str], folder: str) -> list[str]:
        """The index with the batch's hashes appended; all pieces become one when there are many."""
        rows = incoming.select("h", "part", "bucket")
        if len(known) + 1 >= self.runs:
            old = [self.spark.read.schema("h bigint, part string, bucket int").parquet(f"{self.path}/index/{v}") for v in known]
            rows = functools.reduce(DataFrame.unionByName, old, rows).distinct()
            known = []
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/index/{folder}")
        return [*known, folder]

    def merge(self, batch: DataFrame) -> list[str]:
        """Merge a batch of ``deliveries`` rows; returns the partitions that were written."""
        h = F.xxhash64("tape", "msg_key", F.when(F.col("msg_key").isNull(), F.col("delivery_id")))
        incoming = written(winners(batch).withColumns({"h": h, "part": self._part(), "bucket": F.pmod(h, F.lit(self.buckets)).cast("int")}), "incoming")
        narrow = incoming.select("tape", "msg_key", "delivery_id", "fetched_at")
        try:
            while True:
                manifest = self.manifest()
                version = manifest["version"] + 1
                folder = f"v={version}-{uuid.uuid4().hex[:12]}"
                affected = self._affected(incoming, manifest) if manifest["parts"] else []
                rows = winners(self._read({p: manifest["parts"][p] for p in affected}).unionByName(narrow)) if affected else narrow
                parts = self._write(rows, folder)
                index = self._index(incoming, manifest["index"], folder)
                kept = {p: v for p, v in manifest["parts"].items() if p not in affected}
                try:
                    self._commit({"version": version, "parts": kept | dict.fromkeys(parts, folder), "index": index})
                    return parts
                except Conflict:
                    for kind in ("winners", "index"):
                        delete(self.spark, f"{self.path}/{kind}/{folder}")
        finally:
            discard(incoming)

    def read(self) -> DataFrame:
        """All winners."""
        return self._read(self.manifest()["parts"])

    def sweep(self) -> None:
        """Delete the folders that the current manifest doesn't name, and older manifests; run it when no reader or writer is at work."""
        m = self.manifest()
        for kind, named in (("winners", set(m["parts"].values())), ("index", set(m["index"]))):
            if self.fs.exists(self._hadoop(f"{self.path}/{kind}")):
                for f in self.fs.listStatus(self._hadoop(f"{self.path}/{kind}")):
                    if f.getPath().getName() not in named:
                        self.fs.delete(f.getPath(), True)
        for f in self.fs.listStatus(self._hadoop(self.path)):
            if f.getPath().getName().startswith("manifest-") and f.getPath().getName() != f"manifest-{m['version']:012d}.json":
                self.fs.delete(f.getPath(), False)


def copies(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Deliveries that aren't the winner of their message; rows without identifier are no copies."""
    w = kept.select("tape", "delivery_id")
    return rows.where(F.col("msg_key").isNotNull()).select("tape", "delivery_id").join(w, ["tape", "delivery_id"], "left_anti")
