import itertools
import random
import re

import pytest
import xxhash

from palimpsest.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def corpus():
    rng = random.Random(5)
    vocab = [f"W{i}é" if i % 7 else f"w{i}" for i in range(300)]
    rows = list(enumerate([None, "", " \n\t", "one", "One", "one two", "ONE\x0btwo", "a b c", "a  b\r\nc", "x" * 5000, "É é", "a a a a a a"]))
    for size in (5, 30, 200):
        for _ in range(4):
            base = rng.choices(vocab, k=size)
            for _ in range(rng.choice([1, 3, 25])):
                words = list(base)
                for _ in range(rng.choice([0, 1, 1, 2])):
                    words[rng.randrange(len(words))] = rng.choice(vocab)
                rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[20][1]), (25, rows[25][1]), (len(rows) + 1, " ".join(rng.choices(vocab, k=60000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [512, 8])
def test_against_all_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 1000)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, mask int").repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, cell=cell).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("distance,cell", [(3, 512), (3, 60), (1, 20), (5, 60)])
def test_links_of_dense_fingerprints(spark, distance, cell):
    """Fingerprints around few centres, so that all blocks are shared and groups are divided down to the last bits."""
    rng = random.Random(distance)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(120):
            prints.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3), distance=distance, cell=cell).collect()

    def classes(pairs):
        root = {x: x for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in prints]

    assert len(links) <= 6 * 7 * len(prints)  # no pairs of a whole group
    assert classes(links) == classes((a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) % 2**64).bit_count() <= distance)


def test_groups_meet_whatever_the_join(spark):
    """A join planned with a shuffle and run as a broadcast, as in large tables, leaves no group in several tasks."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    dense = {centre ^ sum(1 << k for k in rng.sample(range(64), 2)) for _ in range(300)}
    pairs = [(x, x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for x in (rng.getrandbits(64) for _ in range(3000))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x),) for x in {*dense, *itertools.chain(*pairs)}]
    rng.shuffle(rows)
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10MB", "adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long").repartition(4), cell=100).collect()
    finally:
        for k in conf:
            spark.conf.unset(f"spark.sql.{k}")
    linked = {frozenset(x) for x in links}
    assert [p for p in pairs if p[0] != p[1] and frozenset(map(signed, p)) not in linked] == []  # before: most are missed


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 7), (0, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(df.where("doc_id IS NULL")).collect()[0].component_id is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_cover_all_bits():
    first = simhash.blocks(0, 4)
    assert [b.bit_count() for b in first] == [16] * 4 and sum(first) == 2**64 - 1
    assert all((b & first[0]) == first[0] for b in simhash.blocks(first[0], 4)) and sum(b ^ first[0] for b in simhash.blocks(first[0], 4)) | first[0] == 2**64 - 1
