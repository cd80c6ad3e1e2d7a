import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.llm import ngram_lm
from palimpsest.llm.ngram_lm import score_documents


@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 2**40)))
def test_packing(values, counts):
    v = np.array(sorted(values), dtype=np.uint64)
    assert (ngram_lm.unpack_sorted(ngram_lm.pack_sorted(v)) == v).all()
    c = np.array(counts, dtype=np.int64)
    assert (ngram_lm.unpack_counts(ngram_lm.pack_counts(c), len(c)) == c).all()


def brute(texts, order, backoff):
    words = [(t or "").split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    each = [grams(w) for w in words]
    every = sum(each, Counter())
    size = sum(map(len, words))
    out = []
    for w, own in zip(words, each):
        count = lambda g: every[g] - own[g]
        log = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s = factor * (count(g) / (size - len(w)) if count(g) else 1 / (size - len(w) + 1))
                    break
                if count(g):
                    s = factor * count(g) / count(g[:-1])
                    break
                factor *= backoff
            log += math.log(s)
        out.append((len(w), log))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_counting(spark, order, monkeypatch):
    rng = random.Random(order)
    vocab = ["a", "b", "c", "d", "é", "ff"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", " \n", "unique words only here", "a b c a b c", "a b c a b c", "a " * 3000]
    rows = [(i if i else None, t, 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_score double").repartition(3)
    got = {r.doc_id or 0: r for r in score_documents(df, order=order, buckets=8).collect()}
    assert len(got) == len(texts)
    for i, (n, log) in enumerate(brute(texts, order, 0.4)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, log, rel_tol=1e-9, abs_tol=1e-9), i
        assert (got[i].mean_log_score is None) == (n == 0)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (1, "x y z")], "doc_id long, text string")
    a = score_documents(df.repartition(3), buckets=4).collect()
    b = score_documents(df.coalesce(1), buckets=4).collect()
    want = brute(["x y z"] * 3, 3, 0.4)[0][1]
    assert [round(r.log_score, 9) for r in a] == [round(r.log_score, 9) for r in b] == [round(want, 9)] * 3
    assert score_documents(df.limit(0)).count() == 0
