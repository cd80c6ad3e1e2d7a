import itertools
import math
import random
import time

import numpy as np
import pytest

from palimpsest.llm import quality
from palimpsest.llm.quality import features, fit, lines_of, marginals, score_quality, train


def spans(texts):
    raw = [t.encode() for t in texts]
    return np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


@pytest.mark.parametrize("long,sizes", [(512, [1, 3, 5, 2]), (2, [1, 3, 8, 2]), (3, [7, 3, 10, 4]), (1, [2, 5, 1, 6])])
def test_marginals_against_enumeration(long, sizes, monkeypatch):
    monkeypatch.setattr(quality, "LONG", long)
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(4), sizes)
    s, link = rng.normal(size=len(doc)) * 3, rng.normal(size=(2, 2))
    good, pairs, log_z = marginals(s, doc, link)
    want_good, want_pairs, want_z = np.zeros(len(s)), np.zeros((2, 2)), 0.0
    for d in range(4):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        weight = np.array([math.exp(sum(s[i] for i, y in zip(at, p) if y) + sum(link[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        want_z += math.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            want_good[at] += w * np.array(p)
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(60), rng.integers(1, 6, 60))
    label = rng.integers(0, 2, 60)
    x = (rng.normal(size=(len(doc), len(quality.NAMES))) + label[doc][:, None] * 0.5).astype(np.float32)

    def likelihood(m):
        lift = m.lift(x, doc)
        inner = doc[1:] == doc[:-1]
        path = (lift * label[doc]).sum() + m.link[label[doc][:-1][inner], label[doc][1:][inner]].sum()
        return path - marginals(lift, doc, m.link)[2]

    assert likelihood(train(x, doc, label, rounds=80)) > likelihood(train(x, doc, label, rounds=1)) + 5


def test_lines_and_features():
    offsets, data = spans(["one two\n\n  \nthree", "", "\n", "a b a b\na b a b"])
    doc, begin, end = lines_of(offsets, data)
    assert [(d, data[a:b].tobytes()) for d, a, b in zip(doc.tolist(), begin, end)] == [(0, b"one two\n"), (0, b"three"), (3, b"a b a b\n"), (3, b"a b a b")]
    x, _, _ = features(offsets, data)
    assert x[:, quality.NAMES.index("repeated")].tolist() == [0, 0, 1, 1]
    assert x[:, quality.NAMES.index("distinct")].tolist() == [1, 1, 0.5, 0.5]


def test_held_out_and_odd_rows(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choices("the house stands by a river and waits".split(), k=8)).capitalize() + "." for _ in range(rng.randint(1, 5)))
    bad = lambda: "\n".join(" | ".join(rng.choices("BUY now### ClIcK %% $$$ win!!".split(), k=8)) for _ in range(rng.randint(1, 5)))
    rows = [(i, good() if i % 2 else bad(), i % 2, 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, score double")
    model = fit(df.where("doc_id < 200"), sample=150)
    got = {r.doc_id: r for r in score_quality(df.where("doc_id >= 200"), model).collect()}
    assert np.mean([got[i].predicted == q for i, _, q, _ in rows[200:]]) >= 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, good() * 3000), (None, bad()), (4, "x\n" * 20000)], "doc_id long, text string")
    out = score_quality(odd, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2, 3)} == {model.prior}
    assert score_quality(odd.limit(0), model).count() == 0
    assert {r.score for r in score_quality(odd.limit(2), fit(df.limit(0))).collect()} == {0.5}


def test_a_million_lines():
    rng = np.random.default_rng(1)
    n = 1_000_000
    s, link = rng.normal(size=n) * 4, np.array([[2.0, -1.0], [-1.5, 1.0]])
    doc = np.concatenate((np.zeros(n - 700, np.int64), np.repeat(np.arange(1, 8), 100)))
    began = time.process_time()
    good, pairs, _ = marginals(s, doc, link)
    assert time.process_time() - began < 20 and np.isfinite(good).all() and np.isclose(pairs.sum(), n - 8)
    short, _, _ = marginals(s[:40], doc[:40], link)
    assert np.allclose(good[:20], short[:20], atol=1e-4)


def test_score_is_the_length_weighted_marginal():
    """Each document's score by enumeration of all labellings of its lines, weighed by the lines' bytes."""
    rng = np.random.default_rng(6)
    size = len(quality.NAMES)
    model = quality.Model(np.full(size, 0.1), np.full(size, 0.7), rng.normal(size=3 * size + 1) * 0.3, rng.normal(size=(2, 2)), 0.25)
    texts = ["One line here.", "A first line.\nBUY now $$$\n\nthe third, and longest line of all of them", "", "x\ny\nz z z z\nx"]
    offsets, data = spans(texts)
    got = model.scores(offsets, data)
    x, doc, weight = features(offsets, data)
    lift = model.lift(x, doc)
    for d in range(len(texts)):
        at = np.flatnonzero(doc == d)
        if not len(at):
            assert got[d] == 0.25
            continue
        paths = list(itertools.product((0, 1), repeat=len(at)))
        p = np.array([math.exp(sum(lift[i] for i, y in zip(at, q) if y) + sum(model.link[a, b] for a, b in zip(q, q[1:]))) for q in paths])
        good = sum(w * np.array(q) for w, q in zip(p / p.sum(), paths))
        assert np.isclose(got[d], (good * weight[at]).sum() / weight[at].sum())
