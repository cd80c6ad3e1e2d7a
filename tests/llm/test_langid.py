import random

import numpy as np

from palimpsest.llm import langid
from palimpsest.llm.langid import fit, identify, presence

WORDS = {"en": "the and of with thing was that".split(), "de": "der und nicht schön für ist ein".split(), "fr": "le être où français que pas une".split()}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 40))), lang, "clash"))
    return rows


def grams(text):
    letters = "".join(c.lower() if c.isalpha() else "\0" for c in text)
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1) if letters[i : i + n] != "\0" and "\0\0" not in letters[i : i + n]}


def test_presence_is_the_set_of_grams():
    a, b = "Schön, der Tag!  ", "schön der tag"
    x, letters = presence(np.array([0, len(a.encode()), len(a.encode()) + len(b.encode())]), np.frombuffer((a + b).encode(), np.uint8))
    assert letters.all()
    # Hashing may merge places but not part them.
    assert x[0].sum() <= len(grams(a)) and x[1].sum() <= len(grams(b))
    assert x[1].sum() >= 0.97 * len(grams(b))
    shared = len(grams(a) & grams(b))
    assert abs((x[0] * x[1]).sum() - shared) <= 2


def test_held_out_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    train = spark.createDataFrame(made(300, 1), schema)
    model = fit(train, landmarks=64, sample=200)
    assert model.languages == ["de", "en", "fr"]
    fresh = made(120, 2)
    got = {r.doc_id: r for r in identify(spark.createDataFrame(fresh, schema), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in fresh]) >= 0.99
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 345 !?"), (4, "the and of " * 30000), (None, "der und nicht"), (4, "the and of " * 30000)], "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.lang_pred) for r in identify(odd, model).collect())
    assert out == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert identify(odd.limit(0), model).count() == 0
    assert fit(train.limit(0)) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {langid.UNDECIDED}


def test_scores_match_a_plain_kernel_machine(spark):
    rows = made(80, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, x string")
    model = fit(docs, landmarks=80, sample=80, ridge=1e-2)
    x = langid._sets([t for _, t, *_ in rows])
    unit = x / np.sqrt(x.sum(axis=1))[:, None]
    kernel = (unit @ unit.T).astype(float)
    y = np.array([[1.0 if r[2] == g else -1.0 for g in model.languages] for r in rows])
    # With every row a landmark, Nystrom features give the exact kernel ridge regression.
    exact = kernel @ np.linalg.lstsq(kernel + 1e-2 * len(rows) * np.eye(len(rows)), y, rcond=None)[0]
    assert np.abs(model.scores(x) - exact).max() < 0.02
