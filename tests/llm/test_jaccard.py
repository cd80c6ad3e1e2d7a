import itertools
import random
import re

import numpy as np
import pytest

from palimpsest.llm import jaccard
from palimpsest.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(vocab, k=n)
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t", "one", "One", "one two", "a b c d", "A B C D", "a b c d e", "x" * 5000])]
    passage = text(30)
    for size in (6, 9, 12, 14, 16, 20, 40, 120):
        for _ in range(4):
            base = text(size)
            for _ in range(rng.choice([1, 2, 12])):
                words = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, size // 12])):
                    k = rng.randrange(len(words) + 1)
                    words[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
                rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(text(size) + passage + text(3))))
    rows += [(len(rows), rows[20][1]), (25, rows[25][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,limit,cell", [(1, None, 500), (2, 0, 2), (3, 12, 1), (4, 6, 3)])
def test_against_all_pairs(spark, seed, limit, cell, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda length, most=12: limit)
    monkeypatch.setattr(jaccard, "SHORT", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cls string, token int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, cell=cell).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert [r.component_id for r in jaccard.near_duplicates(df).collect()] == [7, 7, 7]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_cost_bound():
    assert jaccard.boundary(1.0) >= 4 and jaccard.boundary(1.0) < jaccard.boundary(40.0) <= 12
    assert jaccard.subset_sizes(10) == [8, 9, 10]


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_sketches_never_overstate():
    rng = np.random.default_rng(3)
    for n, m, both in [(1, 1, 0), (5, 900, 5), (64, 65, 60), (700, 800, 690), (3000, 40, 10)]:
        shared = rng.integers(0, 2**63, both).astype(np.uint64)
        x, y = (np.concatenate((shared, rng.integers(0, 2**63, k - both).astype(np.uint64))) for k in (n, m))
        assert jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(y)) <= n + m - 2 * both
        assert jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(x[::-1])) == 0
