import random

from palimpsest.operators import list_diff as D
from palimpsest.sources import script


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_longest():
    rng = random.Random(3)
    for _ in range(400):
        a, b = (rng.choices("abcd" if rng.random() < 0.5 else "abcdefghijkl", k=rng.randint(0, 14)) for _ in range(2))
        met = D.common(a, b)
        assert all(a[i] == b[j] for i, j in met) and len(met) == longest(a, b)
        assert all(p < q and s < t for (p, s), (q, t) in zip(met, met[1:]))


def test_edits_make_the_new_list():
    rng = random.Random(4)
    for _ in range(300):
        old, new = ([(rng.choice("kl"), rng.choice("123")) for _ in range(rng.randint(0, 8))] for _ in range(2))
        made = D.edits(old, new)
        touched = {i for _, i, _ in made if i is not None}, {j for _, _, j in made if j is not None}
        assert [x for i, x in enumerate(old) if i not in touched[0]] == [x for j, x in enumerate(new) if j not in touched[1]]
        assert all(old[i][0] == new[j][0] for c, i, j in made if c == "modified")


def test_an_insertion_is_one_change(spark):
    table = lambda *texts: script.nodes(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "digest string, text string"))
    old = table("p = { list = { a b c } m = 1 m = 2 q.r = { x > 1 } }", "same = { 1 2 }", "gone = { x = 1 }")
    new = table("p = { list = { new a b c } m = 0 m = 1 m = 2 q.r = { x < 1 } }", "same = { 1 2 }", "come = { 7 }")
    got = sorted((r.digest, r.path, r.name, r.change_type, r.old_value, r.new_value, r.old_pos, r.new_pos) for r in D.list_changes(old, new).collect())
    assert got == [
        ("f0", "p", "m", "added", None, "0", None, 0), ("f0", "p.list", "[]", "added", None, "new", None, 0), ("f0", "p.q.r", "x", "modified", "1", "1", 0, 0),
        ("f2", "come", "[]", "added", None, "7", None, 0), ("f2", "gone", "x", "removed", "1", None, 0, None),
    ]
    assert D.list_changes(old, old).count() == 0


def test_like_the_positional_diff_where_nothing_moved(spark):
    rng = random.Random(5)
    values = [[str(rng.randrange(9)) for _ in range(6)] for _ in range(30)]
    # Every value differs from all others, so that what is modified stands where it stood.
    text = lambda v, k: "p = { a = %s list = { %s } }" % (f"{v[0]}{k}", " ".join(f"v{i}_{x}" for i, x in enumerate(v)))
    old = [(f"f{i}", text(v, "")) for i, v in enumerate(values)]
    new = [(f"f{i}", text([x if rng.random() < 0.7 else x + "n" for x in v], "")) for i, v in enumerate(values)]
    a, b = (script.nodes(spark.createDataFrame(t, "digest string, text string")) for t in (old, new))
    want = sorted((r.digest, r.old_value, r.new_value, r.change_type) for r in script.diff(a, b, keep=("digest",)).collect())
    assert sorted((r.digest, r.old_value, r.new_value, r.change_type) for r in D.list_changes(a, b).collect()) == want and want
