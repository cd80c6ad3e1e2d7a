import random

from palimpsest.llm import components as module

CUT = module.cut


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long").repartition(3)


def test_stars_take_no_round(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(module, "cut", lambda df: stored.append(1) or CUT(df))
    stars = [(1, n) for n in range(10, 40)] + [(n, 2) for n in range(50, 60)] + [(7, 7), (1, 10), (None, 3)]
    got = {r.node: r.root for r in module.components(links_of(spark, stars)).collect()}
    assert got == {1: 1, 2: 2} | {n: 1 for n in range(10, 40)} | {n: 2 for n in range(50, 60)}
    assert len(stored) == 1
    assert module.components(links_of(spark, [(7, 7)])).count() == 0


def test_edges_that_are_no_stars_go_on(spark):
    for pairs, settled in [([(2, 1), (3, 1)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False)]:
        assert module._settled(spark.createDataFrame(pairs, "u long, v long")) is settled


def test_every_round_is_let_go(spark, monkeypatch):
    done = []
    monkeypatch.setattr(module, "cut", lambda df: done.append("cut") or CUT(df))
    monkeypatch.setattr(module, "release", lambda spark: done.append("release"), raising=False)
    chain = list(range(60))
    random.Random(5).shuffle(chain)
    got = {r.node: r.root for r in module.components(links_of(spark, list(zip(chain, chain[1:])))).collect()}
    assert got == dict.fromkeys(range(60), 0)
    assert len(done) >= 6 and done == ["cut", "release"] * (len(done) // 2)
