import random
from collections import Counter

import pytest

from palimpsest.llm.tokens import RULES, VOCABULARY, count_field_tokens, count_tokens, encoder

TEXTS = ["", None, "a", "\n", "\n\nabc\n", "one\ntwo\n\nthree é\n", "héllo wörld 😀😀\nñandú", "x" * 3000 + "\n" + "word " * 5000, "tail no feed", "日本語\nテスト 文"]


def spans_of(text):
    """Tokens with the code point that holds their first and last byte."""
    encoding, length = encoder(VOCABULARY)
    where = [i for i, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for t in encoding.encode_ordinary(text):
        out.append((where[at], where[at + length[t] - 1]))
        at += length[t]
    assert at == len(where)
    return out


def brute(text, sections, rule):
    tokens, crossing = Counter(), Counter()
    of = lambda p: next((i for i, (a, b) in enumerate(sections) if a <= p < b), None)
    for a, b in spans_of(text or ""):
        x, y = of(a), of(b)
        k = x if rule == "first" else y
        if rule == "longest" and x != y:
            held = [s for s in map(of, range(a, b + 1)) if s is not None]
            k = max(dict.fromkeys(held), key=held.count) if held else None
        elif rule == "longest":
            k = x
        tokens[k] += 1
        crossing[k] += x != y
    return tokens, crossing


def test_lines(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, section int").coalesce(1)
    got = {}
    for r in count_tokens(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        lines = (text or "").splitlines(keepends=True) if "\n" in (text or "") else [text or ""]
        assert [(text or "")[r.start_char : r.end_char] for r in got[i]] == lines
        sections = [(r.start_char, r.end_char) for r in got[i]]
        tokens, crossing = brute(text, sections, "first")
        assert [(r.n_tokens, r.n_crossing) for r in got[i]] == [(tokens[k], crossing[k]) for k in range(len(lines))]
    assert count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", RULES)
def test_given_sections(spark, rule):
    rng = random.Random(3)
    rows = []
    for i, text in enumerate(TEXTS):
        n = len(text or "")
        marks = sorted(rng.randrange(n + 1) for _ in range(4)) if n else []
        rows.append((i, text, [(a, b) for a, b in zip(marks[::2], marks[1::2])] or (None if i % 2 else [])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:int,end:int>>").coalesce(1)
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in count_tokens(docs, sections_col="sections", rule=rule).collect()}
    for i, text, sections in rows:
        tokens, crossing = brute(text, sections or [], rule)
        for k in [*range(len(sections or [])), None]:
            assert got[i, k] == (tokens[k], crossing[k]), (i, k)


@pytest.mark.parametrize("rule", RULES)
def test_fields(spark, rule):
    rows = [(1, "héllo wörld", "one two\nthree", "x"), (2, None, "only", None), (None, "", "", ""), (1, "héllo wörld", "one two\nthree", "x"), (3, "ab", "cd" * 400, "😀")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, title string, body string, tail string, n_tokens int").coalesce(1)
    got = sorted(map(str, (tuple(r) for r in count_field_tokens(docs, ["title", "body", "tail"], rule=rule).collect())))
    want = []
    for d, *texts in rows:
        whole = "\n".join(t or "" for t in texts)
        sizes = [len(t or "") + (i < 2) for i, t in enumerate(texts)]
        sections = [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(3)]
        tokens, crossing = brute(whole, sections, rule)
        want += [(d, f, *sections[i], tokens[i], crossing[i]) for i, f in enumerate(["title", "body", "tail"])]
    assert got == sorted(map(str, want))
    assert count_field_tokens(docs.limit(0), ["title"]).count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, None)], "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in count_tokens(docs).collect())
    assert len(got) == 3 and got[1] == got[2] and "(5, 0, 0, 0, 0, 0)" in got
