import random

import pytest

from palimpsest.operators.ordered import sections, stitch


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, f"t{i}", rng.random() < 0.2, rng.choice([None, None, None, "x", "y"])) for i in rng.sample(range(400), 250)]
    return spark.createDataFrame(rows, "file string, line long, text string, head boolean, mark string").repartition(3)


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_two_levels_as_one(lines, span):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(stitch(lines, ["file"], ["line"], "text", "head", span=span)) == key(stitch(lines, ["file"], ["line"], "text", "head"))
    columns = ["file", "line", "section"]
    assert key(sections(lines, ["file"], ["line"], "mark", span=span).select(columns)) == key(sections(lines, ["file"], ["line"], "mark").select(columns))
    assert stitch(lines.limit(0), ["file"], ["line"], "text", "head", span=span).count() == 0
