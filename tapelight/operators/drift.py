"""Schemas that drift between files: every field change reported, all records read into one table.

Each file of a feed is compared with the one before it. Columns are
profiled in parts that add up (JSON types, share of numbers, magnitude, text
length, smallest value hashes), so no task holds a file. Renames are found
by bipartite matching between the fields that vanished and those that
appeared: an edge's weight is the agreement of the values themselves where
the newer file repeats records of the older one (the records are lined up by
the values they share, since ids may be renamed too; agreement tolerates
another type, a power-of-ten unit and another way to write an instant), else
the similarity of the sketches, with name similarity to break ties. The best
assignment (Hungarian method) keeps only edges above a threshold.

Types carry on from file to file in windows over the profiles: a file with
only nulls keeps the type known before, a field that returns is only added.

Scale: only files of which fields vanished and appeared send records on, and
only those that share a telling value (one of at most four records a side)
with the other file, found by equality of value hashes; lining them up is
linear in them. Windows per feed and field run over one row per file.
Field-name lineages (schema-sized) are joined on the driver.

Defined results: records without feed, file number or payload, and payloads
that aren't one JSON object, are left out of the comparison; a feed's first
file has no changes; an empty table gives an empty report.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelight.operators import stamps
from tapelight.session import written


def load(payload: str) -> dict | None:
    try:
        d = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return d if isinstance(d, dict) else None


def kind(v) -> str | None:
    """JSON type; a number is integer without decimal point."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "integer", float: "number", list: "array", dict: "object"}[type(v)]


_INSTANT = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?")


def canon(v):
    """A value in one form: numbers as (magnitude-free) floats, instants as epoch seconds, the rest as text."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return ("n", float(v)) if abs(v) < 1e300 else ("s", str(v))
    if isinstance(v, str):
        t = v.strip()
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", t, re.I):
            return ("n", float(t)) if len(t) < 300 else ("s", t)
        if _INSTANT.fullmatch(t):
            try:
                d = datetime.fromisoformat(t.replace("Z", "+00:00"))
                return ("n", (d.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() - (d.utcoffset().total_seconds() if d.utcoffset() else 0))
            except ValueError:
                pass
        return ("s", t.lower())
    return ("s", json.dumps(v, sort_keys=True))


def numeric(pairs: list[tuple]) -> list[tuple[float, float]]:
    """The pairs of canonical values of which both are numbers or instants."""
    return [(a[1], b[1]) for a, b in pairs if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "n"]


def power(numbers: list[tuple[float, float]]) -> int | None:
    """The power of ten that leads from the first of each pair to the second; None if nothing tells."""
    ratios = sorted(math.log10(b / a) for a, b in numbers if a * b > 0)
    return round(ratios[len(ratios) // 2]) if ratios else None


def agreement(old: list, new: list) -> float | None:
    """Share of lined-up values that are the same quantity; None if no pair has two values.

    Numbers agree when one power of ten explains all pairs; the share then counts pairs within rounding.
    """
    pairs = [(canon(a), canon(b)) for a, b in zip(old, new) if a is not None and b is not None]
    if not pairs:
        return None
    equal = sum(a == b for a, b in pairs) / len(pairs)
    numbers = numeric(pairs)
    if len(numbers) == len(pairs) and equal < 1:
        p = power(numbers)
        if p is not None:
            scaled = sum(math.isclose(a * 10.0**p, b, rel_tol=2e-4, abs_tol=1e-9) for a, b in numbers) / len(numbers)
            # several records must tell the same story where only the scale links them
            equal = max(equal, scaled if p == 0 or len({a for a, _ in numbers}) > 1 else 0.6 * scaled)
    return equal


def magnitude(x: float) -> float:
    return math.log10(abs(x) + 1e-9)


def likeness(a: dict, b: dict) -> float:
    """Similarity of two value sketches in [0, 1]."""
    share = lambda s: s["numeric"] / max(1, s["n"])
    scale = 1 / (1 + abs(a["magnitude"] / a["numeric"] - b["magnitude"] / b["numeric"])) if a["numeric"] and b["numeric"] else 0.5
    x, y = (s["chars"] / max(1, s["texts"]) for s in (a, b))
    shared = len(set(a["bottom"]) & set(b["bottom"])) / max(1, min(len(a["bottom"]), len(b["bottom"])))
    return 0.35 * (1 - abs(share(a) - share(b))) + 0.15 * scale + 0.2 * (1 - abs(x - y) / max(x, y, 1)) + 0.3 * shared


def names_alike(a: str, b: str) -> float:
    """Overlap of name parts, camel and snake case alike; 1 for the same parts."""
    parts = lambda s: {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", s)}
    x, y = parts(a), parts(b)
    return len(x & y) / max(1, len(x | y))


#: A value that more records of a file have tells nothing about which two are the same.
TELLING = 4


def _places(side: list[set]) -> dict:
    out: dict = {}
    for k, vs in enumerate(side):
        for v in vs:
            out.setdefault(v, []).append(k)
    return out


def line_up(old: list[dict], new: list[dict]) -> list[tuple[dict, dict]]:
    """Repeated records, lined up: the tail of the older file against the head of the newer one at the overlap where values agree best.

    Where no overlap fits (records out of order), each new record goes with
    the old one it shares the most telling values with.
    """
    values = lambda r: {v for v in map(canon, r.values()) if isinstance(v, tuple)}
    a, b = [values(r) for r in old], [values(r) for r in new]
    places = lambda side: {v: ks for v, ks in _places(side).items() if len(ks) <= TELLING}
    # every telling value that both sides have votes for the overlap at which its records meet
    here, votes = places(a), {}
    for v, js in places(b).items():
        for i in here.get(v, ()):
            for j in js:
                k = len(a) - i + j
                votes[k] = votes.get(k, 0) + 1
    best, size = 0.0, 0
    for k, n in sorted(votes.items()):
        if 2 * n >= max(votes.values()) and k <= min(len(a), len(b)):
            score = sum(len(x & y) / max(1, min(len(x), len(y))) - 0.4 for x, y in zip(a[-k:], b[:k]))
            if score > best:
                best, size = score, k
    if size:
        return list(zip(old[-size:], new[:size]))
    where = _places(a)
    spread: dict = {}
    for vs in b:
        for v in vs:
            spread[v] = spread.get(v, 0) + 1
    shared: dict[tuple[int, int], float] = {}
    for j, vs in enumerate(b):
        for v in vs:
            if len(where.get(v, ())) <= TELLING and spread[v] <= TELLING:
                for k in where.get(v, ()):
                    shared[k, j] = shared.get((k, j), 0) + 1 / (len(where[v]) * spread[v])
    out, left, right = [], set(), set()
    for (k, j), n in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
        if n >= 1.5 and k not in left and j not in right:
            left.add(k)
            right.add(j)
            out.append((old[k], new[j]))
    return out


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching (Hungarian method with potentials), rows to columns."""
    if not weights or not weights[0]:
        return []
    flip = len(weights) > len(weights[0])
    w = [list(c) for c in zip(*weights)] if flip else weights
    n, m = len(w), len(w[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, back, done = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0], i0, delta, j1 = True, match[j0], math.inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    cur = -w[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], back[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    out = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in out] if flip else out


def renames(gone: dict[str, dict], come: dict[str, dict], pairs: list[tuple[dict, dict]], by_values: float = 0.75, by_sketch: float = 0.8) -> dict[str, str]:
    """{new name: old name} between two files, from the sketches of fields that vanished and appeared and the repeated records."""
    weights = []
    for g in gone:
        row = []
        for c in come:
            both = [(x.get(g), y.get(c)) for x, y in pairs]
            same = agreement([x for x, _ in both], [y for _, y in both])
            alike = names_alike(g, c)
            if same is not None:
                row.append(2 * same + 0.2 * alike if same >= by_values else -1.0)
            else:
                # no repeated record has both values: a value that was there and is gone, or the other way, speaks against
                one_sided = sum((x is None) != (y is None) for x, y in both)
                s = likeness(gone[g], come[c])
                row.append(s + 0.2 * alike if one_sided == 0 and s + 0.2 * alike >= by_sketch and alike > 0 else -1.0)
        weights.append(row)
    old, new = list(gone), list(come)
    return {new[j]: old[i] for i, j in assign(weights) if weights[i][j] > 0}


KINDS = ("array", "boolean", "integer", "number", "object", "string")
_SUMS = ("n", *KINDS, "numeric", "magnitude", "texts", "chars")
_BOTTOM = 16
_PARTS = "feed string, file_seq int, field_name string, n bigint, " + ", ".join(f"`{k}` bigint" for k in KINDS) + ", numeric bigint, magnitude double, texts bigint, chars bigint, bottom array<bigint>"


def value_hash(v) -> int:
    """64 bits of a canonical value, the same in every process."""
    return xxhash.xxh64_intdigest(str(v)) - (1 << 63)


def _profiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Profiles of what a batch holds of each (file, field); a row without field counts a file's readable records."""
    for b in batches:
        sums: dict[tuple, list] = {}
        hashes: dict[tuple, set[int]] = {}
        for feed, seq, payload in zip(b["feed"], b["file_seq"], b["payload"]):
            r = load(payload)
            at = sums.setdefault((feed, seq, None), [0] * len(_SUMS))
            at[0] += r is not None
            for f, v in (r or {}).items():
                at = sums.setdefault((feed, seq, f), [0] * len(_SUMS))
                if v is None:
                    continue
                at[0] += 1
                at[1 + KINDS.index(kind(v))] += 1
                c = canon(v)
                if isinstance(c, tuple):
                    if c[0] == "n":
                        at[7] += 1
                        at[8] += magnitude(c[1])
                    else:
                        at[9] += 1
                        at[10] += len(c[1])
                hashes.setdefault((feed, seq, f), set()).add(value_hash(c))
        rows = [(*k, *v, sorted(hashes.get(k, ()))[:_BOTTOM]) for k, v in sums.items()]
        yield pd.DataFrame(rows, columns=["feed", "file_seq", "field_name", *_SUMS, "bottom"])


def profiles(files: DataFrame) -> DataFrame:
    """One row per (feed, file_seq, field_name) with its sketch and JSON type ``kind``; field_name null counts the file's readable records."""
    rows = _usable(files).select("feed", "file_seq", "payload").mapInPandas(_profiled, _PARTS)
    bottom = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bottom")))), 1, _BOTTOM)
    rows = rows.groupBy("feed", "file_seq", "field_name").agg(*[F.sum(c).alias(c) for c in _SUMS], bottom.alias("bottom"))
    # number if any value has a decimal point, else the most frequent type
    most = F.array_min(F.filter(F.array(*[F.struct((-F.col(k)).alias("n"), F.lit(k).alias("kind")) for k in KINDS]), lambda x: x["n"] < 0))["kind"]
    return rows.withColumn("kind", F.when((F.col("number") > 0) & (F.col("number") + F.col("integer") == F.col("n")), "number").otherwise(most))


def _usable(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("feed").isNotNull() & F.col("file_seq").isNotNull() & F.col("payload").isNotNull())
    return rows.select("feed", F.col("file_seq").cast("int").alias("file_seq"), F.coalesce("line_no", F.lit(0)).alias("line_no"), "rec_no", "payload")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        values = [{value_hash(v) for v in map(canon, (load(p) or {}).values()) if isinstance(v, tuple)} for p in b["payload"]]
        yield b.assign(hashes=[sorted(v) for v in values])


_MATCHED = "feed string, idx bigint, field_name string, came_from string, scale_exp int"


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Renames of one pair of files after another; the rows of a pair follow each other, its records in order of file and line."""
    rows = (dict(zip(b.columns, r)) for b in batches for r in zip(*(b[c] for c in b.columns)))
    for (feed, idx), group in itertools.groupby(rows, key=lambda r: (r["feed"], r["idx"])):
        fields, records = {True: {}, False: {}}, {True: [], False: []}
        for r in group:
            if r["payload"] is None:
                fields[r["older"]][r["field_name"]] = r
            elif (d := load(r["payload"])) is not None:
                records[r["older"]].append(d)
        gone, come = (dict(sorted(fields[o].items())) for o in (True, False))
        pairs = line_up(records[True], records[False])
        out = []
        for f, g in renames(gone, come, pairs).items():
            out.append((feed, idx, f, g, power(numeric([(canon(x.get(g)), canon(y.get(f))) for x, y in pairs]))))
        yield pd.DataFrame(out, columns=["feed", "idx", "field_name", "came_from", "scale_exp"]).astype({"scale_exp": "Int32"})


def compared(files: DataFrame) -> DataFrame:
    """Each file's fields against the file before: state same, added, renamed (``came_from``, ``scale_exp``) or removed, and JSON type."""
    seen = written(profiles(files), "profiles")
    along = W.partitionBy("feed").orderBy("file_seq")
    order = seen.where("field_name is null").select("feed", "file_seq", F.col("n").alias("valid"), F.row_number().over(along).cast("bigint").alias("idx"), F.coalesce(F.lag("n").over(along), F.lit(0)).alias("before"))
    sketch = F.struct("n", "numeric", "magnitude", "texts", "chars", "bottom").alias("sketch")
    now = seen.where("field_name is not null").join(order.select("feed", "file_seq", "idx"), ["feed", "file_seq"]).select("feed", "idx", "field_name", "kind", sketch)
    was = now.select("feed", (F.col("idx") + 1).alias("idx"), "field_name", F.lit(True).alias("had"), F.col("sketch").alias("old_sketch"))
    both = now.withColumn("has", F.lit(True)).join(was, ["feed", "idx", "field_name"], "full_outer").join(order, ["feed", "idx"])
    state = F.when(F.col("has").isNull(), F.when(F.col("valid") > 0, "removed")).when(F.col("had").isNull() & (F.col("before") > 0), "added").otherwise("same")
    both = written(both.withColumn("state", state).where("state is not null"), "fields")
    moved = _renamed(files, both, order)
    came = both.where("state <> 'removed'").join(moved, ["feed", "idx", "field_name"], "left")
    came = came.withColumn("state", F.when(F.col("came_from").isNotNull(), "renamed").otherwise(F.col("state")))
    went = both.where("state = 'removed'").join(moved.select("feed", "idx", F.col("came_from").alias("field_name")), ["feed", "idx", "field_name"], "left_anti")
    cols = ["feed", "file_seq", "idx", "field_name", "kind", "came_from", "state", "scale_exp"]
    return came.select(*cols).unionByName(went.select("feed", "file_seq", "idx", "field_name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("came_from"), "state", F.lit(None).cast("int").alias("scale_exp")))


def _renamed(files: DataFrame, both: DataFrame, order: DataFrame) -> DataFrame:
    """(feed, idx, field_name, came_from, scale_exp) of the files that both lost and gained fields."""
    changed = both.where("state in ('added', 'removed')").withColumn("older", F.col("state") == "removed")
    pairs = changed.groupBy("feed", "idx").agg(F.count_if("older").alias("gone"), F.count("*").alias("all")).where("gone > 0 and gone < all").select("feed", "idx")
    fields = changed.join(pairs, ["feed", "idx"], "left_semi").select("feed", "idx", "older", "field_name", F.coalesce("sketch", "old_sketch").alias("sketch"))
    fields = fields.select("feed", "idx", "older", "field_name", "sketch.*")
    # a file is read as the newer of its pair and as the older of the next
    places = order.select("feed", "file_seq", "idx")
    roles = places.select("feed", "file_seq", F.explode(F.array(F.struct("idx", F.lit(False).alias("older")), F.struct((F.col("idx") + 1).alias("idx"), F.lit(True).alias("older")))).alias("r")).select("feed", "file_seq", "r.*")
    records = _usable(files).join(roles.join(pairs, ["feed", "idx"], "left_semi"), ["feed", "file_seq"]).select("feed", "idx", "older", "line_no", "rec_no", "payload")
    records = written(records.mapInPandas(_hashed, "feed string, idx bigint, older boolean, line_no bigint, rec_no bigint, payload string, hashes array<bigint>"), "records")
    # records that share a telling value with the other file
    each = records.select("feed", "idx", "older", "line_no", "rec_no", F.explode("hashes").alias("h"))
    telling = each.groupBy("feed", "idx", "h").agg(F.count_if("older").alias("o"), F.count_if(~F.col("older")).alias("n")).where(F.col("o").between(1, TELLING) & F.col("n").between(1, TELLING))
    shared = each.join(telling, ["feed", "idx", "h"], "left_semi").select("feed", "idx", "older", "line_no", "rec_no").distinct()
    on = [records[c].eqNullSafe(shared[c]) for c in ("feed", "idx", "older", "line_no", "rec_no")]
    rows = fields.unionByName(records.join(shared, functools.reduce(lambda x, y: x & y, on), "left_semi").drop("hashes"), allowMissingColumns=True)
    rows = rows.repartition("feed", "idx").sortWithinPartitions("feed", "idx", "older", "line_no", "rec_no")
    return written(rows.mapInPandas(_matched, _MATCHED), "renames")


def changes(files: DataFrame) -> DataFrame:
    """(feed, file_seq, field_name, change_kind, came_from, json_type, scale_exp): added, removed, renamed, retyped.

    ``json_type`` is the field's type from here on; a renamed field's new values are the old ones x 10^scale_exp, null if the repeated records don't tell.
    """
    # read by several joins below: the comparison runs once
    c = written(compared(files), "drift")
    state = c.where("state <> 'removed'")
    along = W.partitionBy("feed", "field_name").orderBy("idx")
    known = lambda s: s.withColumn("known", F.last("kind", ignorenulls=True).over(along))
    # a renamed field without a value in its first file goes on with the old name's type
    first = known(state)
    was = first.select("feed", (F.col("idx") + 1).alias("idx"), F.col("field_name").alias("prev_name"), F.col("known").alias("was"))
    prev_name = F.coalesce("came_from", F.when(F.col("state") == "same", F.col("field_name")))
    carried = first.withColumn("prev_name", prev_name).join(was, ["feed", "idx", "prev_name"], "left").withColumn("kind", F.coalesce("kind", "was"))
    second = known(carried.drop("known", "was"))
    was = second.select("feed", (F.col("idx") + 1).alias("idx"), F.col("field_name").alias("prev_name"), F.col("known").alias("was"))
    typed = second.join(was, ["feed", "idx", "prev_name"], "left")
    retyped = typed.where("idx > 1 and state <> 'added' and kind <> was").select("feed", "file_seq", "field_name", F.lit("retyped").alias("change_kind"), "came_from", F.col("kind").alias("json_type"), "scale_exp")
    others = c.where("idx > 1 and state <> 'same'").select("feed", "file_seq", "field_name", F.col("state").alias("change_kind"), "came_from", F.col("kind").alias("json_type"), "scale_exp")
    return others.unionByName(retyped)


Name = tuple[str, str]  # venue, field name


def lineages(moves: list[tuple[str, str, str, int, int | None]], together: set[tuple[str, str, str]] = frozenset()) -> dict[Name, tuple[str, int]]:
    """{(venue, name): (canonical name, power of ten)} from (venue, old name, new name, places, power of ten) moves.

    Names that ever followed one another are one column, called by its first name used most, one that says dollars before others; a name's
    values are the column's x 10^power. Of contradicting powers the one seen in most places holds, any known before an unknown one.
    Names that a record has both of, with values (``together``: venue and the two), are two columns: no move merges them, however long the way.
    """
    group: dict[Name, dict[Name, int]] = {}
    starts: dict[Name, int] = {}
    for venue, old, new, n, p in sorted(moves, key=lambda m: (m[4] is None, -m[3], m[:3], m[4] or 0)):
        x, y = (venue, old), (venue, new)
        starts[x] = starts.get(x, 0) + n
        a, b = group.setdefault(x, {x: 0}), group.setdefault(y, {y: 0})
        if a is not b and not any((venue, v, w) in together or (venue, w, v) in together for _, v in a for _, w in b):
            by = a[x] + (p or 0) - b[y]
            a.update({z: e + by for z, e in b.items()})
            group.update({z: a for z in b})
    out = {}
    for x, g in group.items():
        head = max(g, key=lambda y: (bool(_DOLLARS.search(y[1])), starts.get(y, 0), y[1]))
        out[x] = (head[1], g[x] - g[head])
    return out


_DOLLARS = re.compile(r"dollars|usd", re.I)
_NUMERAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
_CODE = r"^\s*[+-]?(0\d.*|\d{19,}.*)$"  # leading zeros or more digits than a number holds: an identifier


def profile(records: DataFrame) -> dict[Name, dict[str, int]]:
    """Per venue and field name, how many values are written how; one aggregate, schema-sized."""
    rows = records.select(F.coalesce("venue", F.lit("unknown")).alias("venue"), F.explode("entries").alias("e")).select("venue", F.col("e.key").alias("name"), F.col("e.value").alias("v"))
    tests = {"numerals": F.col("v").rlike(_NUMERAL), "whole": F.col("v").rlike(_WHOLE), "codes": F.col("v").rlike(_CODE), "instants": F.trim("v").rlike(f"^(?:{_INSTANT.pattern})$"), "booleans": F.col("v").isin("true", "false")}
    rows = rows.groupBy("venue", "name").agg(F.count("v").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return {(r["venue"], r["name"]): {k: r[k] for k in ("n", *tests)} for r in rows.collect()}


def side_by_side(records: DataFrame, moves: list[tuple]) -> set[tuple[str, str, str]]:
    """(venue, name, name) of moved names of which one record has values of both; one aggregate, schema-sized."""
    moved = sorted({n for m in moves for n in m[1:3]})
    if not moved:
        return set()
    held = F.array_distinct(F.transform(F.filter("entries", lambda e: e["value"].isNotNull() & e["key"].isin(moved)), lambda e: e["key"]))
    rows = records.groupBy("venue", F.array_sort(held).alias("held")).count().where(F.size("held") > 1)
    rows = rows.select("venue", F.explode("held").alias("a"), "held").select("venue", "a", F.explode("held").alias("b")).where("a < b").distinct()
    return {tuple(r) for r in rows.collect()}


def schema_of(seen: dict[Name, dict[str, int]], names: dict[Name, tuple[str, int]], most: float = 0.9) -> tuple[dict[Name, tuple[str, int]], dict[Name, str]]:
    """({(venue, name): (column, power of ten)}, {(venue, column): SQL type}): a column has the type that ``most`` of its values can be read as, else it is text."""
    members: dict[Name, list[Name]] = {}
    for x in seen:
        members.setdefault((x[0], names.get(x, (x[1], 0))[0]), []).append(x)
    placed, types = {}, {}
    for column, xs in members.items():
        power_of = {x: names.get(x, (x[1], 0))[1] for x in xs}
        s = {k: sum(seen[x][k] for x in xs) for k in seen[xs[0]]}
        least = most * s["n"]
        kind = "string"
        if s["n"] and s["booleans"] >= least:
            kind = "boolean"
        elif s["n"] and s["instants"] >= 0.05 * s["n"] and s["instants"] + s["numerals"] >= least:
            kind = "timestamp"
            # the name with written-out instants counts in seconds
            base = power_of[max(xs, key=lambda x: (seen[x]["instants"], x))]
            power_of = {x: p - base for x, p in power_of.items()}
        elif s["n"] and not s["codes"] and s["numerals"] >= least:
            kind = "bigint" if s["whole"] == s["numerals"] and not any(power_of.values()) else "double"
        types[column] = kind
        placed |= {x: (column[1], power_of[x] if kind in ("timestamp", "double") else 0) for x in xs}
    return placed, types


def _read(value: Column, kind: Column, exp: Column) -> Column:
    """``value`` in its column's one form, as text that casts to the column's type; null if it can't be read so."""
    text = F.trim(value)
    number = F.when(value.rlike(_NUMERAL), F.when(exp == 0, text.try_cast("double")).otherwise(F.round(text.try_cast("double") * F.pow(F.lit(10.0), -exp), 12)))
    zoneless = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?$")
    written_out = F.concat(text, F.when(zoneless, "Z").otherwise("")).try_cast("timestamp")
    at = F.when(value.rlike(_NUMERAL), F.round(number * 1e6).try_cast("bigint")).otherwise(F.unix_micros(written_out))
    return (
        F.when(kind == "timestamp", stamps.utc_text(at))
        .when(kind == "double", number.cast("string"))
        .when(kind == "bigint", text.try_cast("bigint").cast("string"))
        .when(kind == "boolean", F.when(text.isin("true", "false"), text))
        .otherwise(value)
    )


def _unified(files: DataFrame, known: DataFrame | None, support: int) -> tuple[DataFrame, dict[Name, str]]:
    venues = files.select("feed", "venue").where("feed is not null and venue is not null").distinct()
    report = changes(files) if known is None else known
    moves = report.where("change_kind = 'renamed'").join(venues, "feed").groupBy("venue", "came_from", "field_name", "scale_exp").agg(F.count("*").alias("n"))
    moves = moves.withColumn("places", F.sum("n").over(W.partitionBy("venue", "came_from", "field_name"))).where(F.col("places") >= support)
    moves = [(r["venue"], r["came_from"], r["field_name"], r["n"], r["scale_exp"]) for r in moves.collect()]  # schema-sized
    records = files.where("payload is not null").withColumn("entries", F.map_entries(F.from_json("payload", "map<string,string>")))
    names, types = schema_of(profile(records), lineages(moves, side_by_side(records, moves)))
    spec = {f"{venue}|{name}": (to, exp, types[venue, to]) for (venue, name), (to, exp) in names.items()}
    entries = [x for k, (to, exp, kind) in spec.items() for x in (F.lit(k), F.struct(F.lit(to).alias("to"), F.lit(exp).alias("exp"), F.lit(kind).alias("kind")))]
    known_as = F.create_map(*entries) if entries else F.lit(None).cast("map<string,struct<to:string,exp:int,kind:string>>")
    placed = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("raw"), F.try_element_at(known_as, F.concat(F.coalesce("venue", F.lit("unknown")), F.lit("|"), e["key"])).alias("as")))
    read = F.transform("placed", lambda e: F.struct(e["as"]["to"].alias("key"), _read(e["raw"], e["as"]["kind"], e["as"]["exp"]).alias("value"), e["raw"].alias("raw"), e["key"].alias("name")))
    # of several values for a column the first that can be read
    value_of = lambda k: F.get(F.filter("read", lambda e: (e["key"] == k) & e["value"].isNotNull()), F.lit(0))["value"]
    fields = F.map_from_entries(F.transform(F.array_distinct(F.transform("read", lambda e: e["key"])), lambda k: F.struct(k.alias("key"), value_of(k).alias("value"))))
    lost = F.filter("read", lambda e: e["raw"].isNotNull() & ~e["value"].eqNullSafe(F.try_element_at("fields", e["key"])) | (e["raw"].isNotNull() & e["value"].isNull()))
    unread = F.transform(lost, lambda e: F.struct(e["name"].alias("field_name"), e["raw"].alias("value")))
    rows = records.withColumn("placed", placed).withColumn("read", read).withColumn("fields", fields)
    return rows.select(F.coalesce("venue", F.lit("unknown")).alias("_v"), "venue", "rec_no", "feed", "file_seq", "fields", unread.alias("unread")), types


def unified(files: DataFrame, known: DataFrame | None = None, support: int = 1) -> DataFrame:
    """(venue, rec_no, feed, file_seq, fields map<string,string>, unread array<struct<field_name,value>>): every record under its venue's canonical column names.

    Each value is in its column's one form: numbers in the column's unit, instants as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``; one that can't be
    read so, or clashes with another value of its record, stands as it was in ``unread``. ``known`` is a report of changes(); moves seen in fewer than ``support``
    places don't merge names.
    """
    return _unified(files, known, support)[0].drop("_v")


def tables(files: DataFrame, known: DataFrame | None = None, support: int = 1) -> DataFrame:
    """unified() with one struct of typed columns per venue in place of ``fields``, null in other venues' rows; ``venue.*`` is that venue's table.

    Types are bigint, double, timestamp, boolean, and string for the rest (identifiers of more than 18 digits too).
    """
    rows, types = _unified(files, known, support)
    structs = [
        F.when(F.col("_v") == v, F.struct(*[F.try_element_at("fields", F.lit(c)).try_cast(kind).alias(c) for (w, c), kind in sorted(types.items()) if w == v])).alias(v)
        for v in sorted({v for v, _ in types})
    ]
    return rows.select("venue", "rec_no", "feed", "file_seq", *structs, "unread")
