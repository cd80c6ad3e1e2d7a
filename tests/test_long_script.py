import random

import pytest

from palimpsest.sources import long_script as L
from palimpsest.sources import script


def texts():
    rng = random.Random(12)
    out = []
    for i in range(30):
        pieces = []
        for _ in range(rng.randint(0, 25)):
            pieces.append(
                rng.choice(
                    ["a = 1", "b = { x = 1 y = { 2 3 } }", "{ 1 2 }", "key", '"quoted { # text"', "c = { # } comment\n d = 4 }", "a = { }", "}", "= 5", 'e = "two\nlines }"', "\n\n", "# whole { line\n", "f = { g = { h = { i } } }", "b >= 3", ";", "﻿", "x#y {\n", 'é = "ü"', "a = { b }"]
                )
            )
        if i % 9 == 4:
            pieces.insert(rng.randrange(len(pieces) + 1), "open = { never")
        if i % 9 == 5:
            pieces.append('z = "never closed')
        if i % 9 == 6:
            pieces.append('v = @[1 + } ] w = "a \\" b"')
        out.append((f"f{i}", rng.choice([" ", "\n"]).join(pieces)))
    return out + [("empty", ""), ("null", None), ("deep", "t = { " * 60 + "} " * 61 + "u = 1")]


@pytest.mark.parametrize("size", [5, 23, 90])
def test_pieces_equal_one_pass(spark, size):
    df = spark.createDataFrame(texts(), "digest string, text string").repartition(3)
    want = sorted(map(str, script.nodes(df).collect()))
    got = L.long_nodes(df, size=size).select(["digest", *L.COLUMNS])
    assert sorted(map(str, got.collect())) == want


def test_effects_compose():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices('{}"#\nab ', k=rng.randint(0, 30)))
        at = rng.randint(0, len(text))
        for state in L.STATES:
            s, c, o = L.effect(text[:at], state)
            t, d, p = L.effect(text[at:], s)
            depth = rng.randint(0, 5)
            one = L.effect(text, state)
            assert one[0] == t and max(max(depth - c, 0) + o - d, 0) + p == max(depth - one[1], 0) + one[2]


def test_work_grows_with_the_text_not_with_its_square(spark):
    import time

    n = 60_000
    text = "\n".join(f"p_{i} = {{ a = {i} }}" for i in range(n))
    df = spark.createDataFrame([("long", text)], "digest string, text string")
    began = time.monotonic()
    top = L.long_nodes(df, size=40).where("depth = 0").selectExpr("count(*)", "max(pos)", "max(line)").first()
    assert tuple(top) == (n, n - 1, n)
    assert time.monotonic() - began < 60
