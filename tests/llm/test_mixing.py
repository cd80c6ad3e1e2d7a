import random
import re

import pytest

from palimpsest.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling by hand: what is over a source's cap is dealt again to those below theirs."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_cut(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "null", "Z"]
    rows = [(i, rng.choice([None, "", " ", "w " * rng.randint(1, 40), " x y"]), rng.choices(sources, [60, 5, 5, 3, 3, 2])[0], "x", 1) for i in range(400)]
    rows += [rows[7], rows[7], (None, "a b", "a", None, None)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, of = {}, {}, {r[0]: r[2] for r in rows}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    for r in got:
        s = of[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    none = mix_sources(spark.createDataFrame([(1, None, None, "x", 1)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)]
