"""The registered queries of the training-text operators on whole tables of the smallest scale."""

import duckdb

from tapelight.llm import encoding, leaks, linkage, queries
from tests.conftest import SF


def table(name, columns="*"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def test_p1(spark):
    got = queries.p1_matches(spark, SF).collect()
    fights, markets = dict(table("fights_k", "fight_id, fighters_kalshi")), {r[0] for r in table("fights_p", "pm_id")}
    assert got and len({r.pm_id for r in got}) == len(got) and all(r.fight_id in fights and r.pm_id in markets and 0.5 <= r.confidence <= 1 for r in got)
    assert {(r.fight_id, r.pm_id) for r in got} == {tuple(r) for r in queries.p1_found(spark, SF).collect()}
    # whoever has both full names of a fight on its day is its market
    names = lambda x: {" ".join(linkage.tokens(n)) for n in x or [] if n}
    sure = {(f, p) for p, who, day in table("fights_p", "pm_id, fighters_pm, pm_fight_date") for f, x in fights.items() if len(names(x)) == 2 and names(x) == names(who) and day and f.startswith(day.strftime("%Y%m%d"))}
    assert sure and sure <= {(r.fight_id, r.pm_id) for r in got}


def test_p7(spark):
    out = queries.p7_containers(spark, SF).toPandas()
    assert out.groupby("container")["length"].sum().max() <= 2048 and not out.duplicated(["doc_id", "piece"]).any()
    assert set(out.doc_id) == {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/documents.parquet' where text <> ''").fetchall()}
    assert out.container.nunique() <= -(-out.length.sum() // 2048) + 2


def test_p8(spark):
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leaks.words_of(t or "")] for k in range(len(w) - 11)}
    items = [(i, grams(t)) for i, t in table("eval_items", "item_id, text")]
    want = {(d, i) for d, t in table("documents", "doc_id, text") for g in [grams(t)] for i, x in items if g & x}
    assert want <= {tuple(r) for r in queries.p8_found(spark, SF).collect()}


def test_p9(spark):
    texts = {d: t for d, t in table("documents", "doc_id, text")}
    rows = queries.p9_restored(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in queries.p9_found(spark, SF).collect()}
    assert {d for d, t in texts.items() if t and encoding.LOST in t} <= {r.doc_id for r in rows}
    for r in rows:
        assert r.chains or encoding.LOST in texts[r.doc_id] or encoding._CONTROL.search(r.restored)
        assert bool(r.chains) == (r.restored != texts[r.doc_id])
