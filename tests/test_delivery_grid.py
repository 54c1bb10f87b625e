import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapelight.operators import delivery, grid

T0, EPOCH = datetime(2025, 1, 30), datetime(1970, 1, 1)


def rows(spark, data):
    return spark.createDataFrame(data, "tape string, msg_key string, delivery_id bigint, fetched_at timestamp")


def test_identifiers(spark):
    df = spark.createDataFrame([("{E9E5-12E3}", "03000465.0"), ("0xe9e512e3", " 3000465 "), ("0000e9e512e3", "3000465"), (None, None), ("", "x")], "h string, n string")
    got = [tuple(r) for r in df.select(delivery.hex_id(F.col("h")), delivery.whole_id(F.col("n"))).collect()]
    assert got[0] == got[1] == got[2] == ("e9e512e3", "3000465") and got[3] == (None, None) and got[4] == (None, None)


def test_ledger_against_brute_force(spark):
    r = random.Random(5)
    data = [("a", f"k{r.randrange(40)}" if r.random() > 0.05 else None, i, T0 + timedelta(days=r.randrange(90)) if r.random() > 0.03 else None) for i in range(400)]
    data += [("a", "hot", 1000 + i, T0 + timedelta(days=3)) for i in range(150)]  # ties: the smallest id wins
    store = delivery.Ledger(spark)
    cut = T0 + timedelta(days=60)
    store.merge(rows(spark, [d for d in data if d[3] and d[3] < cut]))
    before = store.manifest()["parts"]
    written = store.merge(rows(spark, [d for d in data if not d[3] or d[3] >= cut]))
    again = store.merge(rows(spark, data[:50]))
    best = {}
    for _, k, i, t in data:
        if k is not None:
            best[k] = min(best.get(k, (datetime(9999, 12, 31), 10**9)), (t or datetime(9999, 12, 31), i))
    got = sorted((x.msg_key or "", x.delivery_id) for x in store.read().collect())
    # rows without identifier are all kept, once
    assert got == sorted([(k, i) for k, (_, i) in best.items()] + [("", i) for _, k, i, _ in data if k is None])
    lost = {x.delivery_id for x in delivery.copies(rows(spark, data), store.read()).collect()}
    assert lost == {i for _, k, i, _ in data if k is not None and best[k][1] != i}
    assert before and written and again


def test_untouched_partitions_keep_their_version(spark):
    store = delivery.Ledger(spark)
    store.merge(rows(spark, [("a", "x", 1, T0), ("a", "y", 2, T0 + timedelta(days=200))]))
    store.merge(rows(spark, [("a", "y", 3, T0 + timedelta(days=201))]))
    versions = store.manifest()["parts"]
    assert versions["a-202501"].startswith("v=1-") and versions["a-202508"].startswith("v=2-")
    assert store.merge(rows(spark, [])) == []
    assert store.read().count() == 2


def test_a_merge_that_died_is_run_again(spark, monkeypatch):
    store = delivery.Ledger(spark)
    store.merge(rows(spark, [("a", "x", 2, T0)]))
    late = rows(spark, [("a", "x", 1, T0 - timedelta(days=40)), ("a", "y", 3, T0)])
    for step in ("_commit", "_index"):
        with monkeypatch.context() as m:
            m.setattr(delivery.Ledger, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            try:
                store.merge(late)
            except OSError:
                pass
        assert [(r.msg_key, r.delivery_id) for r in store.read().collect()] == [("x", 2)]
    store.merge(late)
    assert sorted((r.msg_key, r.delivery_id) for r in store.read().collect()) == [("x", 1), ("y", 3)]
    store.sweep()
    assert sorted((r.msg_key, r.delivery_id) for r in store.read().collect()) == [("x", 1), ("y", 3)]


def test_of_two_writers_none_is_lost(spark, monkeypatch):
    store = delivery.Ledger(spark)
    other = delivery.Ledger(spark, store.path)
    store.merge(rows(spark, [("a", "x", 2, T0)]))
    commit, raced = delivery.Ledger._commit, []

    def slow(self, manifest):
        if not raced:
            raced.append(1)
            other.merge(rows(spark, [("a", "x", 1, T0 - timedelta(days=1)), ("b", "z", 9, T0)]))
        commit(self, manifest)

    monkeypatch.setattr(delivery.Ledger, "_commit", slow)
    store.merge(rows(spark, [("a", "x", 3, T0 - timedelta(hours=1)), ("a", "y", 4, T0)]))
    assert sorted((r.tape, r.msg_key, r.delivery_id) for r in store.read().collect()) == [("a", "x", 1), ("a", "y", 4), ("b", "z", 9)]
    assert store.manifest()["version"] == 3


def test_index_pieces_become_one(spark):
    store = delivery.Ledger(spark, runs=3, buckets=4)
    for k in range(5):
        store.merge(rows(spark, [("a", f"m{k}", k, T0 + timedelta(days=35 * k)), ("a", "m0", 100 + k, T0 + timedelta(days=35 * k))]))
    assert len(store.manifest()["index"]) < 3
    assert sorted((r.msg_key, r.delivery_id) for r in store.read().collect()) == [(f"m{k}", k) for k in range(5)]


def test_counter_grid_against_brute_force(spark):
    r = random.Random(3)
    data = []
    for s in ("a", "b"):
        t, c = 1_700_000_000, 0.0
        for i in range(60):
            t += r.choice([0, 5, 40, 299, 300, 301, 1500, 4000])
            c = r.randrange(3) if r.random() < 0.08 else c + r.randrange(5)
            data.append((s, EPOCH + timedelta(seconds=t), float(c), i, 0.5))
    data += [("a", None, 1.0, 900, 0.1), (None, T0, 1.0, 901, 0.1), ("a", T0, None, 902, 0.1), ("b", T0, float("nan"), 903, 0.1), ("one", T0, 4.0, 0, 0.2)]
    df = spark.createDataFrame(data, "key string, ts timestamp, c double, tie int, v double").withColumn("cell", F.lit("clash"))
    got = {(x.series, x.cell_s): x for x in grid.counter_grid(df, "key", "ts", "c", "tie", "v").collect()}
    for s in ("a", "b"):
        read = sorted(((d[1] - datetime(1970, 1, 1)).total_seconds(), d[3], d[2]) for d in data if d[0] == s and d[1] and d[2] is not None and d[2] == d[2])
        want: dict[int, float] = {}
        for (t0, _, c0), (t1, _, c1) in zip(read, read[1:]):
            inc = c1 if c1 < c0 else c1 - c0
            cell = int(t0 // 300) * 300
            while cell <= t1:
                share = max(0, min(t1, cell + 300) - max(t0, cell)) / (t1 - t0) if t1 > t0 else float(cell == int(t1 // 300) * 300)
                # inside one cell the whole increment stays there
                want[cell] = want.get(cell, 0) + inc * share
                cell += 300
        lo, hi = int(read[0][0] // 300) * 300, int(read[-1][0] // 300) * 300
        cells = {c for k, c in got if k == s}
        assert cells == set(range(lo, hi + 300, 300))
        busy = {int(t // 300) * 300 for t, _, _ in read}
        assert {c for c in cells if got[s, c].covered} == busy
        for c in cells:
            assert abs(got[s, c].increment - want.get(c, 0)) < 1e-6, (s, c)
        assert sum(got[s, c].resets for c in cells) == sum(b[2] < a[2] for a, b in zip(read, read[1:]))
    assert sum(1 for k, _ in got if k == "one") == 1
    assert grid.counter_grid(df.where("false"), "key", "ts", "c", "tie", "v").count() == 0


def test_running_counter(spark):
    df = spark.createDataFrame([("a", EPOCH + timedelta(seconds=1000 + 100 * i), float(i) if i % 4 else None, i) for i in range(12)], "key string, ts timestamp, q double, tie int")
    got = [x.counter for x in grid.running_counter(df, "key", "ts", F.col("q"), "tie").orderBy("tie").collect()]
    total, want = 0.0, []
    for i in range(12):
        total += float(i) if i % 4 else 0
        want.append(total)
    assert got == want
