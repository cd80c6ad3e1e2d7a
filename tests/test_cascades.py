import random

from palimpsest.operators import cascades as K
from palimpsest.operators.ordered import latest_before

COLUMNS = "file string, record long, second int, category string, mod_id string, source string, script_file string, signature string"


def brute(rows):
    """Cascades found one after the other, each overwriting the group of the records in it."""
    marks = {(r[0], r[1]): [False, False, None] for r in rows}
    found = []
    for file in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == file), key=lambda r: r[1])
        number = 0

        def cascade(pattern, root, children, sure):
            nonlocal number
            number += 1
            found.append((file, number, pattern, root[1], len(children), sure))
            marks[file, root[1]][0], marks[file, root[1]][2] = True, number
            for c in children:
                marks[file, c[1]][1], marks[file, c[1]][2] = True, number

        for r in own:
            if r[3] == "script_system_error" and r[2] is not None:
                c = [x for x in own if x[1] != r[1] and -50 <= x[1] - r[1] <= 149 and x[2] is not None and abs(x[2] - r[2]) <= 5 and x[3] in K.SCRIPT_CHILDREN and (not x[6] or x[6] == r[6])]
                if len(c) >= 3:
                    cascade("script_parse_cascade", r, c, 0.8 if len(c) >= 10 else 0.6)
        for r in own:
            if r[3] == "encoding_error" and r[2] is not None and r[4] is not None:
                c = [x for x in own if x[4] == r[4] and x[2] is not None and x[2] > r[2]]
                if len(c) >= 5:
                    cascade("mod_load_cascade", r, c, 0.9)
        alike = {}
        for r in own:
            alike.setdefault(f"{r[5] or ''}:{r[7] or ''}", []).append(r)
        for same in alike.values():
            if len(same) >= 10:
                cascade("repeated_error_spam", same[0], same[1:], 1.0)
    return sorted(found), {k: tuple(v) for k, v in marks.items()}


def log(seed, n=400):
    rng = random.Random(seed)
    rows, second = [], 0
    for i in range(n):
        second = rng.randrange(40) * 300 if rng.random() < 0.02 else second + rng.choice([0, 0, 1, 3])
        rows.append(
            (
                rng.choice("ab"), i, None if rng.random() < 0.05 else second, rng.choice(["script_system_error", "missing_reference", "scope_error", "event_error", "encoding_error", "unknown", "gui_warning"]),
                rng.choice([None, "1", "2", "3"]), rng.choice(["s", "t", None]), rng.choice([None, "", "f", "g"]), rng.choice(["m N", "k", *[f"x{j}" for j in range(40)]]),
            )
        )
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 100)
    for seed in (1, 2):
        rows = log(seed)
        df = spark.createDataFrame(rows, COLUMNS).repartition(3).cache()
        found, marks = brute(rows)
        assert sorted(tuple(r) for r in K.find(df)[0].collect()) == found and len(found) > 20
        got = {(r.file, r.record): (r.is_root, r.is_child, r.cascade_group) for r in K.marked(df).collect()}
        assert got == marks


def test_no_records(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert K.marked(df).count() == 0 and K.find(df)[0].count() == 0


def test_latest_before(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randrange(100), i) for i in range(120)]
    marks = [(rng.choice("xy"), rng.randrange(100), rng.randrange(1000)) for _ in range(30)]
    got = latest_before(spark.createDataFrame(rows, "g string, t long, i long"), spark.createDataFrame(marks, "g string, t long, v long"), "g", "t", "v", 7, "v")
    assert {r.i: r.v for r in got.collect()} == {i: max((v for h, u, v in marks if h == g and u < t), default=None) for g, t, i in rows}


def test_pairs_are_reduced_where_they_meet(spark, monkeypatch):
    """Marks of many records are dealt to tasks by their number, and pairs are not sorted by root to be told its number."""
    rows = log(4)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3).cache()
    monkeypatch.setattr(K, "MARKED", 50)
    told = K.marked(df)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert ", 8)" in plan and "root_record" not in "".join(x for x in plan.splitlines() if "SortMergeJoin [file" in x)  # before: 4, and a join by root_record
    assert {(r.file, r.record): (r.is_root, r.is_child, r.cascade_group) for r in told.collect()} == brute(rows)[1]
