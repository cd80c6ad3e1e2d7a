import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import incremental as N

COLUMNS = "name string, load_order int, file string, line int, value int"
KEY, ORDER = ["name"], ["load_order", "file", "line"]


def definitions(rng, files):
    rows = []
    for f in files:
        load_order = rng.randrange(5)
        rows += [(rng.choice(["a", "b", "c", "d", None, f"only_{f}"]), load_order, f, i, rng.randrange(100)) for i in range(rng.randint(0, 6))]
    return rows


@pytest.mark.parametrize("first,small", [(False, 1_000_000), (True, 0)])
def test_change_sets_equal_full_resolution(spark, first, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL", small)
    rng = random.Random(first)
    stored = {f"f{i}": definitions(rng, [f"f{i}"]) for i in range(12)}
    table = lambda rows: spark.createDataFrame(rows, COLUMNS)
    every = lambda: [r for rows in stored.values() for r in rows]
    now = N.resolved(table(every()), KEY, ORDER, ["value"], first)
    for step in range(4):
        changed = rng.sample(sorted(stored), 2) + [f"g{step}"]
        gone = [f for f in rng.sample(sorted(stored), 2) if f not in changed] + ["unknown"]
        new = {f: definitions(rng, [f]) for f in changed}
        before = {tuple(r) for r in now.state.collect()}
        now = N.change(now, table([r for rows in new.values() for r in rows]), spark.createDataFrame([(f,) for f in [*gone, *changed]], "file string"), KEY, ORDER, ["file"], ["value"], first)
        stored = {f: r for f, r in stored.items() if f not in gone} | new
        full = {tuple(r) for r in N.resolved(table(every()), KEY, ORDER, ["value"], first).state.collect()}
        after = spark.createDataFrame(now.state.collect(), now.state.schema)
        assert {tuple(r) for r in after.collect()} == full and sorted(map(str, now.defs.collect())) == sorted(map(str, table(every()).collect()))
        told = {r.name: (r.change, tuple(r.old) if r.old else None, tuple(r.new) if r.new else None) for r in now.changes.collect()}
        old, cur = ({r[0]: r[1:] for r in s} for s in (before, full))
        assert set(told) == {k for k in old.keys() | cur.keys() if old.get(k) != cur.get(k)}
        for k, (kind, was, is_now) in told.items():
            assert (was, is_now) == (old.get(k), cur.get(k))
            assert kind == ("added" if k not in old else "removed" if k not in cur else "replaced" if was[:-1] != is_now[:-1] else "recounted")
        now = N.Resolved(spark.createDataFrame(now.defs.collect(), COLUMNS), after)


def test_untouched_keys_are_not_shuffled(spark, tmp_path):
    """The stored state and definitions are scanned and filtered by broadcast keys; only what is touched is exchanged."""
    rows = [(f"k{i}", i % 3, f"f{i % 50}", i, i) for i in range(2000)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/defs")
    N.resolved(spark.read.parquet(f"{tmp_path}/defs"), KEY, ORDER).state.write.parquet(f"{tmp_path}/state")
    old = N.Resolved(spark.read.parquet(f"{tmp_path}/defs"), spark.read.parquet(f"{tmp_path}/state"))
    now = N.change(old, spark.createDataFrame([("k1", 9, "new", 0, 0)], COLUMNS), spark.createDataFrame([("f7",)], "file string"), KEY, ORDER, ["file"])
    plan = now.state._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    kept = plan.split("Union")[1]
    assert kept.index("LeftAnti") < kept.index("Exchange")  # the kept rows come straight from their scan
    assert now.state.count() == 2000 - 40


def test_large_change_sets_start_from_what_the_last_one_stored(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 0)
    rows = spark.range(400).selectExpr("concat('k', id % 90) AS name", "cast(id % 3 AS int) AS load_order", "concat('f', id % 40) AS file", "cast(id AS int) AS line", "cast(id AS int) AS value")
    now = N.resolved(rows, KEY, ORDER)
    for step in range(3):
        now = N.change(now, rows.where(f"line % 11 = {step}").withColumn("file", F.concat(F.lit("n"), "file")), rows.where(f"line % 7 = {step}").select("file"), KEY, ORDER, ["file"])
    plan = now.state._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # before: every change set was computed again in the next
    full = N.resolved(now.defs, KEY, ORDER).state
    assert sorted(map(tuple, now.state.collect())) == sorted(map(tuple, full.collect()))
