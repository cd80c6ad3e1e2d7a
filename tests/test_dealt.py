from palimpsest import session as S
from palimpsest.operators import conflicts as C


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id % 7 = 0, null, id % 900) AS k", "id AS line")
    known = spark.range(1200).selectExpr("id % 600 AS k", "id AS file")
    plain = rows.join(known, "k", "left")
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, C.enriched(rows, known, ["k"]).collect())) == want
    small = S.dealt
    monkeypatch.setattr(C, "dealt", lambda key, *t: small(key, *t, rows=200))
    got = C.enriched(rows, known, ["k"])
    assert sorted(map(str, got.collect())) == want
    assert "hashpartitioning(k#" in str(plan := got._jdf.queryExecution().executedPlan().toString()) and ", 26)" in plan  # before: 4 tasks, however many rows
    assert S.tasks(rows, known, rows=200) == 26 and S.tasks(rows, known) == 4
