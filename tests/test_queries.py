"""Every registered query with SQL against DuckDB at the smallest scale."""

import glob
import json
import math
import os
import re
from datetime import date, datetime

import duckdb
import pytest

from tapelight.operators import drift, ladders
from tapelight.plans import catalogue, survey, training  # noqa: F401
from tests.conftest import SF

QUERIES, ORACLE = catalogue.QUERIES | training.QUERIES, catalogue.ORACLE | training.ORACLE


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d") if (v.hour, v.minute) == (0, 0) else v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, date):
        return v.strftime("%Y-%m-%d")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v) + 0.0:.4f}".replace("-0.0000", "0.0000")
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(shown(v) for v in r) for r in df.select(*cols).collect())
    rel = db.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    theirs = sorted(tuple(shown(r[k]) for k in at) for r in rel.fetchall())
    assert ours == theirs


def table(db, sql):
    return db.sql(sql).fetchall()


def test_the_queries_without_sql_are_these():
    assert set(QUERIES) - set(ORACLE) == {"q42_swap_fixpoint", "q73_p_values", "p2_found", "p2_unified", "p3_found", "p3_canonical", "p6_found", "p6_all"}


def test_q42_against_the_rule(spark):
    from tests.test_ladders import rule

    b = ladders.bins(ladders.monotone(catalogue._dense(spark, SF)))
    by: dict = {}
    for r in b.orderBy("contract", "date", "strike").collect():
        by.setdefault((r.contract, r.date), []).append((r.strike, r.price, r.mass))
    want = {}
    for k, rows in by.items():
        masses = rule([p for _, p, _ in rows], [m for _, _, m in rows])
        want |= {(*k, s): round(100 * m / sum(masses), 4) for (s, _, _), m in zip(rows, masses)}
    got = {(r.contract, r.date, r.strike): round(r.probability, 4) for r in QUERIES["q42_swap_fixpoint"](spark, SF).collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in got)


def test_q73_p_values(spark):
    r = QUERIES["q73_p_values"](spark, SF).collect()
    assert len(r) == 1 and r[0].p == pytest.approx(math.erfc(abs(r[0].t) / math.sqrt(2)))


def test_p2_fields_that_came_and_went(spark, db):
    fields: dict = {}
    for feed, seq, payload in table(db, "select feed, file_seq, payload from raw_files where feed is not null and file_seq is not null and payload is not null"):
        fields.setdefault((feed, seq), set()).update(json.loads(payload))
    want = set()
    for feed in {f for f, _ in fields}:
        seqs = sorted(s for f, s in fields if f == feed)
        for a, b in zip(seqs, seqs[1:]):
            want |= {(feed, b, x, "new") for x in fields[feed, b] - fields[feed, a]} | {(feed, b, x, "old") for x in fields[feed, a] - fields[feed, b]}
    rows = drift.changes(training.table(spark, SF, "raw_files")).collect()
    got = {(r.feed, r.file_seq, r.field_name, "new") for r in rows if r.change_kind in ("added", "renamed")}
    got |= {(r.feed, r.file_seq, r.came_from if r.change_kind == "renamed" else r.field_name, "old") for r in rows if r.change_kind in ("removed", "renamed")}
    assert want and got == want
    assert {(r.feed, r.file_seq, r.field_name, r.change_kind) for r in rows} == {tuple(r) for r in QUERIES["p2_found"](spark, SF).collect()}


def test_p2_unified_has_every_record(spark, db):
    df = QUERIES["p2_unified"](spark, SF)
    assert sorted(r.rec_no for r in df.select("rec_no").collect()) == sorted(r[0] for r in table(db, "select rec_no from raw_files where payload is not null"))
    kinds = dict(df.select("kalshi.*").dtypes)
    assert "double" in kinds.values() and "timestamp" in kinds.values()


def test_p3_archive_by_complement(spark, db):
    told = {d: int(math.log10(y + n)) for d, y, n in table(db, "select delivery_id, yes_price, no_price from tape_archive where yes_price + no_price in (1, 100, 1000, 10000)")}
    got = {r.delivery_id: r.scale_exp for r in QUERIES["p3_found"](spark, SF).where("tape = 'tape_archive'").collect()}
    assert {d: -k for d, k in told.items() if k != 2} == {d: e for d, e in got.items() if d in told}
    assert {r.tape for r in QUERIES["p3_canonical"](spark, SF).where("mean_price_usd between 0 and 1").collect()} == {"tape_live", "tape_archive", "pm_trades"}


def test_p6_iso_stamps(spark, db):
    from datetime import timezone

    def told(text):
        try:
            d = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        except ValueError:
            return None
        return math.floor(d.timestamp()) if d.tzinfo and "T" in text and len(text) > 18 else None

    canonical = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z")
    want = {("tape_live", str(k)): v for k, t in table(db, "select delivery_id, created_time from tape_live where created_time is not null") if not canonical.fullmatch(t) and (v := told(t)) is not None}
    got = {(r.tbl, r.rec_key): r.utc_s for r in QUERIES["p6_found"](spark, SF).collect()}
    assert len(want) > 10 and {k: got.get(k) for k in want} == want
    every = {(r.tbl, r.rec_key): r.utc for r in QUERIES["p6_all"](spark, SF).collect()}
    for (t, k), v in got.items():
        name = {"tape_live": "tape_live.created_time", "pm_trades": "pm_trades.ts_utc", "fights_k": "fights_k.event_date"}[t]
        assert every[name, k] == datetime.fromtimestamp(v, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
