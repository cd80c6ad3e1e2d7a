import hashlib
import random
from collections import Counter

import pytest

from palimpsest.llm.substring_dedup import digest, remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(length // 3) for _ in range(4)]
    out = [None, "", "short", "a" * (length - 1), "b" * length, "c" * (length + 1), "ab" * length, "d" * (3 * length)]
    for _ in range(40):
        parts = [text(rng.randint(0, length // 2))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            lo = rng.randrange(len(s) // 2)
            parts += [s[lo : lo + rng.randint(length // 2, 2 * length)], text(rng.randint(0, 6))]
        out.append("".join(parts))
    base = out[-1]
    out += [base, base[:-3] + "xyz", base + shared[0] + shared[0], out[20], shared[1] * 3]
    return out


@pytest.mark.parametrize("seed,length,gram", [(1, 40, 16), (2, 40, 40), (3, 100, 32), (4, 400, 64)])
def test_against_counting(spark, seed, length, gram):
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, key string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in digest(remove_repeats(df, length=length, gram=gram)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("seed,length,gram", [(1, 40, 16), (3, 100, 32), (5, 60, 8)])
def test_groups_too_large_for_a_shard(spark, seed, length, gram):
    """Blocks of windows are halved and counted down to single windows where a group may have two contexts at most."""
    texts = corpus(seed, length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in digest(remove_repeats(df, length=length, gram=gram, hot=2)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_planted_passages(spark):
    """Passages of 380 to 800 bytes in two texts each: all of 400 bytes or more go, and nothing of the shorter ones."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefghijk ", k=n))
    sizes = list(range(380, 800, 7)) + [398, 399, 400, 401]
    rows = []
    for i, n in enumerate(sizes):
        passage = text(n)
        rows += [(2 * i, f"{text(600)}<{passage}>{text(700)}"), (2 * i + 1, f"{text(50)}[{passage}]{text(3)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in digest(remove_repeats(df)).collect()}
    assert got == {d: sizes[d // 2] if sizes[d // 2] >= 400 else 0 for d, _ in rows}


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdef ", k=3000))
    rows = [(1, long), (1, long), (None, long[:1000]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in digest(remove_repeats(df, carry=True)).collect())
    assert got == sorted(brute([t for _, t in rows], 400))
    assert remove_repeats(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefghijk ", k=n))
    passage = text(900)
    rows = [(1, text(1_500_000) + passage + text(1_500_000)), (2, text(300) + passage)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: (3_000_900, 900, 1), 2: (1200, 900, 1)}
