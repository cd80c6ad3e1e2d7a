import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm import vector_codes as V

NAN, INF = float("nan"), float("inf")


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(first[0][1]) if first else 0
    kept = [r for r in kept if len(r[1]) == width]
    cuts = [(width * k // parts, width * (k + 1) // parts) for k in range(parts)]
    books = [[r[1][a:b] for r in first if len(r[1]) == width] for a, b in cuts]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for (a, b), book in zip(cuts, books):
                far = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        told = assign()
        for p, (a, b) in enumerate(cuts):
            for e in range(len(books[p])):
                own = [v[a:b] for (_, v, _), row in zip(kept, told) if row[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    told = assign()
    errors = [sum(d for _, d in row) for row in told]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i is None, i or 0), "".join(f"{k:02x}" for k, _ in row), e, sums[lab], sha) for (i, _, lab), row, e in zip(kept, told, errors))


def vectors(width, n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 * n), [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([1, 2, None])) for _ in range(n)]
    return rows + [rows[0], (None, rows[1][1], 1), (5, None, 1), (6, [NAN] * width, 1), (7, [None] * width, 1), (8, [INF] * width, 1), (9, [0.0] * (width + 16), 2), (10, [0.25] * width, None)]


@pytest.mark.parametrize("width,n,kind", [(64, 150, "float"), (32, 40, "double"), (20, 90, "double"), (8, 80, "float")])
def test_against_brute_force(spark, width, n, kind, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 37)
    rows = vectors(width, n, width)
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, q int").repartition(3)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.coded_table(df).collect())
    assert got == brute(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert V.coded_table(df).count() == 0 and V.coded_table(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    none = spark.createDataFrame([(1, [], 2)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error) for r in V.coded_table(none).collect()] == [("00" * 16, 0)]


def test_bounds_filter_and_never_exceed():
    rng = np.random.default_rng(1)
    for width, scale in ((4, 60), (16, 1 << 25), (5, 40)):
        book = rng.integers(-scale, scale, (64, width))
        x = book[rng.integers(0, 64, 300)] + rng.integers(-scale // 9, scale // 9 + 1, (300, width))
        best, far, n = V.nearest(x, book)
        exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
        assert n.sum() < 300 * 64 / 2  # the bounds do filter
        for cuts in V.segments(width):
            (mx, rx), (mc, rc) = V.moments(x, cuts), V.moments(book, cuts)
            bound = ((mx[:, None] - mc[None]) ** 2 + (rx[:, None] - rc[None]) ** 2).sum(axis=2)
            assert (bound * (1 - 1e-9) - 1 <= exact).all()


def test_far_components_are_bounded(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38] * 8, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    told, books = V.encode_vectors(df)
    assert told.count() == 2 and max(abs(int(x)) for b in books for x in b.ravel()) <= V.LIMIT
