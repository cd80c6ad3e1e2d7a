import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.llm import decontaminate as D


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 5), max_size=25))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert D.common(D._masks(np.array(a, dtype=int)), b) == best[-1][-1]


def test_singular_vectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 40)) + 1e-4 * rng.normal(size=(500, 40))
    probe = rng.normal(size=(40, 14))
    got = D.nystrom(a.T @ (a @ probe), probe, 6)
    _, s, v = np.linalg.svd(a)
    # The same space, scaled by the root of each singular value.
    assert np.abs(np.abs(got.T * np.sqrt(s[:6, None])) - np.abs(v[:6])).max() < 1e-3


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "a", "in", "to"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(20)]
    docs, planted = [], set()
    for d in range(300):
        words = text(rng.randint(5, 400)).split()
        if d % 6 == 0:
            i = rng.randrange(20)
            leak = items[i][1].split()
            if d % 12 == 0:  # reworded: some words changed, one in eight
                leak = [rng.choice(vocab) if k % 8 == 3 else w for k, w in enumerate(leak)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in leak]
            planted.add((d, i))
        docs.append((d, " ".join(words), "x", 1))
    return docs, items, planted


def test_planted_and_clean(spark):
    docs, items, planted = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, item_id int")
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    hits = D.find_contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == planted
    for r in hits:  # by brute force: the shares hold in the region around the reported window
        item = D.Items.of([items[r.item_id]])
        offsets, data = D.flat(D.pa.array([docs[r.doc_id][1]]))
        _, hashes = D.words_of(offsets, data)
        n = len(item.words[0])
        at = np.flatnonzero(np.isin(hashes, item.vocabulary))
        at = at[(at >= r.first_word - n) & (at < r.first_word + 32 + n)]
        region = np.searchsorted(item.vocabulary, hashes[at]).tolist()
        assert abs(D.common(D._masks(item.words[0]), region) / n - r.common_share) < 1e-9
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in planted}


def test_recall_against_all_windows(spark):
    """Reworded passages: what is found against the common subsequences of every item and every window."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(2500)]
    common = ["the", "of", "and", "a", "in", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(12, 60)) for _ in range(30)]
    docs = []
    for d in range(400):
        words = text(rng.randint(20, 300))
        if d % 2:
            noise = rng.choice([0.0, 0.1, 0.2, 0.3])
            leak = []
            for w in rng.choice(items):
                r = rng.random()
                leak += [] if r < noise / 3 else [rng.choice(vocab)] if r < 2 * noise / 3 else [rng.choice(vocab), w] if r < noise else [w]
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        docs.append(words)
    whole = D.Items.of([(i, " ".join(w)) for i, w in enumerate(items)])
    number = {h: i for i, h in enumerate(whole.vocabulary.tolist())}
    want = set()
    for d, words in enumerate(docs):
        _, hashes = D.words_of(*D.flat(D.pa.array([" ".join(words)])))
        told = [number.get(h, -1) for h in hashes.tolist()]
        for i, item in enumerate(whole.words):
            n, masks, answer = len(item), D._masks(item), D._masks(item[-5:])
            for s in range(0, len(told), D.STEP):
                region = told[max(0, s - n) : s + 2 * D.STEP + n]
                if D.common(masks, region) / n >= 0.7 and D.common(answer, region) / min(n, 5) >= 0.6:
                    want.add((d, i))
                    break
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_contaminated(df, bench).collect()}
    assert len(want) > 150 and got <= want
    recall = len(got) / len(want)
    print(f"recall {recall:.4f} of {len(want)}")
    assert recall >= 0.95


def test_verbatim_runs_need_no_cosine(spark):
    """Items of common words only, which weigh next to nothing, are found where they stand word for word."""
    rng = random.Random(2)
    common = ["the", "of", "and", "a", "in", "to", "is", "it"]
    text = lambda n: " ".join(rng.choices(common, k=n))
    items = [(i, text(n)) for i, n in enumerate((14, 20, 33))] + [(3, "rare words")]
    rows = [(d, text(200)) for d in range(40)] + [(100 + i, f"{text(90)} {t} {text(50)}") for i, t in items]
    got = D.find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_cosine=2.0).collect()
    assert {(100 + i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}


def test_odd_rows(spark):
    docs, items, _ = corpus()
    leak = items[3][1]
    odd = [(None, leak), (1, None), (2, ""), (3, leak), (3, leak), (4, leak + " w" * 50000)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.find_contaminated(df, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 3), (3, 3), (3, 3), (4, 3)]))
    assert D.find_contaminated(df.limit(0), bench).count() == 0
    assert D.find_contaminated(df, bench.limit(0)).count() == 0
