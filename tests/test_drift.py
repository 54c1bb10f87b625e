import json

from tapelight.operators import drift


def base(i):
    return {"id": f"abc{i:04d}-ff", "price": 0.25 + i / 100, "qty": 10 + i, "at": f"2026-01-01T00:0{i % 10}:00Z"}


def feed(spark, files, name="f"):
    rows, n = [], 0
    for k, records in enumerate(files, 1):
        for j, r in enumerate(records, 1):
            n += 1
            rows.append((n, name, "kalshi", k, j, r if isinstance(r, str) else json.dumps(r), "clash"))
    return spark.createDataFrame(rows, "rec_no bigint, feed string, venue string, file_seq int, line_no int, payload string, idx string")


def found(spark, files):
    return {tuple(r) for r in drift.changes(feed(spark, files)).select("file_seq", "field_name", "change_kind").collect()}


def test_renames_units_types(spark):
    rename = lambda r: {"trade": r["id"], "cents": str(round(r["price"] * 100, 2)), "qty": float(r["qty"]), "ts": r["at"]}
    a = [base(i) for i in range(6)]
    b = [rename(base(i)) for i in range(4, 9)]
    got = found(spark, [a, b])
    assert got == {(2, "trade", "renamed"), (2, "cents", "renamed"), (2, "cents", "retyped"), (2, "qty", "retyped"), (2, "ts", "renamed")}


def test_added_removed_nulls_and_return(spark):
    a = [base(i) | {"x": i} for i in range(5)]
    b = [base(i) | {"x": None} for i in range(3, 8)]
    c = [base(i) | {"x": "s"} for i in range(6, 9)]
    d = [base(i) for i in range(7, 12)]
    e = [base(i) | {"x": 1.5} for i in range(10, 14)]
    assert found(spark, [a, b, c, d, e]) == {(3, "x", "retyped"), (4, "x", "removed"), (5, "x", "added")}


def test_vanished_and_new_at_once_are_no_rename(spark):
    a = [base(i) | {"seq": 9000 + 7 * i} for i in range(6)]
    b = [base(i) | {"fee": i % 2} for i in range(3, 9)]
    assert found(spark, [a, b]) == {(2, "seq", "removed"), (2, "fee", "added")}


def test_bad_payloads_and_empty(spark):
    got = found(spark, [[base(1), "not json", "[1]"], [base(1), base(2)]])
    assert got == set()
    assert drift.changes(feed(spark, [[base(1)]]).where("false")).count() == 0


def test_unified(spark):
    a = [base(i) for i in range(5)]
    b = [{"uid": base(i)["id"], **{k: v for k, v in base(i).items() if k != "id"}} for i in range(3, 8)]
    got = drift.unified(feed(spark, [a, b])).collect()
    assert all(set(r.fields) == {"id", "price", "qty", "at"} for r in got) and len(got) == 10


def test_unified_is_typed_in_one_unit(spark):
    from datetime import datetime

    epoch = lambda r: int(datetime.fromisoformat(r["at"]).timestamp())
    code = lambda i: "9" * 40 + str(i)
    a = [base(i) | {"price_dollars": base(i)["price"], "asset": code(i)} for i in range(6)]
    b = [{"id": base(i)["id"], "cents": f"{100 * base(i)['price']:.4f}", "qty": f"{base(i)['qty']}.50", "ts": epoch(base(i)), "asset": int(code(i)), "price": base(i)["price"]} for i in range(3, 9)]
    df = drift.tables(feed(spark, [a, b]))
    assert dict(df.select("kalshi.*").dtypes) == {"id": "string", "price": "double", "price_dollars": "double", "qty": "double", "at": "timestamp", "asset": "string"}
    rows = df.selectExpr("file_seq", "kalshi.*", "string(kalshi.at) as t").orderBy("file_seq", "id").collect()
    assert [(r.price_dollars, r.t, r.asset) for r in rows] == [(base(i)["price"], base(i)["at"].replace("T", " ")[:-1], code(i)) for k in ((0, 6), (3, 9)) for i in range(*k)]
    assert [r.qty for r in rows] == [10.0 + i for i in range(6)] + [10.5 + i for i in range(3, 9)]


def test_values_that_do_not_fit_the_type_stay(spark):
    rows = [base(i) for i in range(20)] + [base(20) | {"price": "n/a"}]
    got = [r for r in drift.tables(feed(spark, [rows])).collect() if r.unread]
    assert [(r.kalshi.price, r.unread) for r in got] == [(None, [("price", "n/a")])]


def test_two_names_of_one_column_in_a_record(spark):
    a = [base(i) for i in range(5)]
    swap = lambda i: {"uid": base(i)["id"], **{k: v for k, v in base(i).items() if k != "id"}}
    b = [swap(i) for i in range(3, 8)]
    # the old name stays on as a null: one column, the value is kept
    late = [{"id": None} | swap(9)]
    got = drift.unified(feed(spark, [a, b]).unionByName(feed(spark, [late], "g"))).where("feed = 'g'").collect()
    assert [(r.fields["id"], r.unread) for r in got] == [(base(9)["id"], [])]
    # both with values: two columns
    late = [{"id": "other"} | swap(9)]
    got = drift.unified(feed(spark, [a, b]).unionByName(feed(spark, [late], "g"))).where("feed = 'g'").collect()
    assert [(r.fields["id"], r.fields["uid"]) for r in got] == [("other", base(9)["id"])]
    # a key twice in one object: the first stands, the other is reported
    got = drift.unified(feed(spark, [['{"x": 1, "x": 2}']])).collect()
    assert [(r.fields, r.unread) for r in got] == [({"x": "1"}, [("x", "2")])]


def test_assignment_is_optimal():
    import itertools
    import random

    r = random.Random(1)
    for n, m in ((2, 3), (3, 3), (4, 2), (1, 4)):
        w = [[r.random() for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in drift.assign(w))
        rows, cols = (range(n), range(m))
        best = max(sum(w[i][j] for i, j in zip(rows, p)) for p in itertools.permutations(cols, n)) if n <= m else max(sum(w[i][j] for j, i in enumerate(p)) for p in itertools.permutations(rows, m))
        assert abs(got - best) < 1e-9
