import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from palimpsest.llm import alignment as A


def spans(ids, raw):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(raw[i]), i))
        at += len(raw[i])
    return out


def brute(rows):
    """Whole texts, encoded in one piece, every pair of tokens of a group compared."""
    both, told = A.pair(A.A_FILE, A.B_FILE), []
    for d, text in rows:
        a = both.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        whole = f" {text}".encode()
        if not text or b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            told.append((d, [], [], [], []))
            continue
        x, y = spans(a, both.a_bytes), spans(b, both.b_bytes)
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, links, i, j = [], [], 0, 0
        for e in ends:
            p, q = [], []
            while i < len(x) and x[i][1] <= e:
                p.append(x[i])
                i += 1
            while j < len(y) and y[j][1] <= e:
                q.append(y[j])
                j += 1
            groups.append(",".join(str(t[2]) for t in p) + "|" + ",".join(str(t[2]) for t in q))
            links += [(s[2], t[2]) for s in p for t in q if max(s[0], t[0]) < min(s[1], t[1])]
        told.append((d, a, b, groups, links))
    count = Counter(pair for *_, links in told for pair in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (d or 0, len(a), len(b), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), ";".join(g)) for d, a, b, g, links in told
    )


def same(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, seg string, key int").repartition(3)
    want = brute(rows)
    got = A.align_documents(df, **options)
    assert sorted((r.doc_id or 0, *r[1:]) for r in got.collect()) == want
    sha = A.align_documents(df, as_digest=True, **options).select("doc_id", "groups_sha256").collect()
    assert sorted((r[0] or 0, r[1]) for r in sha) == sorted((w[0], hashlib.sha256(w[-1].encode()).hexdigest() if w[1] else "") for w in want)


ODD = [
    None, "", " ", "  ", "\n", "\t", "a", " a ", "a  b", "a\t b\t\n c", "a\t\n b", "a \n b\n\nc\n", "it's  I'll\n'tis", "x▁y", "a▁ b", "<|endoftext|> </s> <s><unk> <0x41>",
    "naïve café – “quotes”… ﬁ ½", "日本語 テキスト　全角", "👩‍👩‍👧 ok 👍🏽", "é combining", "nul\x00 byte", "a b  c​d", "﻿bom", "x" * 3000, "ab " * 500, "▁", "1234567 89.01", "العربية نص", "\r\nline\r\n end\x0b \x0cq",
]


def test_odd_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD", 40)
    monkeypatch.setattr(A, "SMALL", 10)  # pairs are joined by a shuffle
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "a b"), (3, "a b"), (99, ODD[14])]
    same(spark, rows, block=200)


def test_supplied_documents_against_brute_force(spark):
    some = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    same(spark, [(r["doc_id"], r["text"]) for r in some])


def test_random_texts_cut_alike():
    """Segments put together are the whole text's tokens."""
    both, rng = A.pair(A.A_FILE, A.B_FILE), random.Random(7)
    assert both.cuts
    for _ in range(3000):
        text = "".join(rng.choice(["a", "The", "é", "  ", " ", "\n", "\n\n", "\t", ".", "...", ",", "*x", "'s", "12", "日", "👍", " ", " ", "ing", "\r", "\x1c", "-", "_"]) for _ in range(rng.randint(1, 12)))
        found = both.segments(text)
        if both.exact(f" {text}", both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)):
            ids = both.encode(found)
            assert "".join(found) == f" {text}"
            assert [i for x, _ in ids for i in x] == both.a.encode(f" {text}", add_special_tokens=False).ids, repr(text)
            assert [i for _, y in ids for i in y] == both.b.encode(text), repr(text)
        else:
            assert found == [], repr(text)


def test_links_of_given_tokens(spark):
    rows = [(1, [5, 6, 7], [2, 3, 1], [8, 9], [4, 2]), (2, [1], [3], [2, 2, 2], [1, 1, 1]), (3, [], [], [], []), (4, None, None, None, None)]
    links = A.align(spark.createDataFrame(rows, "key long, a_ids array<int>, a_lens array<int>, b_ids array<int>, b_lens array<int>"))
    assert sorted((r.key, r.grp, r.start, r.a_id, r.b_id) for r in links.collect()) == [(1, 0, 0, 5, 8), (1, 0, 2, 6, 8), (1, 0, 4, 6, 9), (1, 0, 5, 7, 9), (2, 0, 0, 1, 2), (2, 0, 1, 1, 2), (2, 0, 2, 1, 2)]
    rows = {r.key: r for r in A.by_key(links).collect()}
    assert {k: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) for k, r in rows.items()} == {1: (3, 2, 1, 4, "5,6,7|8,9"), 2: (1, 3, 1, 3, "1|2,2,2")}
    weighted = [(p.a_id, p.b_id, {1: 2, 2: 5}[k]) for k, r in rows.items() for p in r.pairs]
    counts = A.pair_counts(spark.createDataFrame(weighted, "a_id int, b_id int, n long")).collect()
    assert {(r.a_id, r.b_id): (r.times, r.best) for r in counts} == {(5, 8): (2, True), (6, 8): (2, True), (6, 9): (2, True), (7, 9): (2, True), (1, 2): (15, True)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x▁y")]])
def test_no_tokens_at_all(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in A.align_documents(df, as_digest=True).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * len(rows)
