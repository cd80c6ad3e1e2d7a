import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index as I
from palimpsest.operators import search as S


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["common"] * 40
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60))) + (" Rare-thing C++" if i == 77 else "")) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "w1 w2 w1 w2 w1")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3).cache()


def scores(rows, key="key"):
    return sorted((r[key], round(r["score"], 9)) for r in rows.collect())


def scanned(docs, query):
    return scores(S.bm25(docs.select("id", F.coalesce("text", F.lit("")).alias("text")), "id", "text", query), "id")


QUERIES = ["common", "w1 w2", "rare", "C++ w3,w3", "nowhere", "...", "common w59 thing"]


def test_search_equals_the_scan(spark, texts, tmp_path):
    I.add_segment(texts, "id", "text", str(tmp_path), 0)
    for q in QUERIES:
        assert scores(I.search(spark, str(tmp_path), q)) == scanned(texts, q), q
    assert {r.key: (r.n, r.first) for r in I.phrase(spark, str(tmp_path), "w1 w2 W1").collect() if r.key > 899} == {902: (2, 0)}
    assert I.phrase(spark, str(tmp_path), "w1 nowhere").count() == 0


def test_rare_words_read_little(spark, texts, tmp_path):
    """Only the folder of the word's bucket is listed, and its row groups are tested for the word."""
    I.add_segment(texts, "id", "text", str(tmp_path), 0)
    rows = I.live_postings(spark, str(tmp_path), ["rare"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan.replace("EqualTo(term", "In(term")
    every = spark.read.parquet(f"{tmp_path}/postings")
    bucket = rows.select("bucket").first()[0]
    assert rows.count() == 1 and every.where(F.col("bucket") == bucket).count() < every.count() / 10


def test_segments_replace_remove_and_merge(spark, texts, tmp_path):
    root, to = f"{tmp_path}/a", f"{tmp_path}/b"
    I.add_segment(texts, "id", "text", root, 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    new = spark.createDataFrame([(3, "rare words now"), (1000, "common rare")], "id long, text string")
    I.add_segment(new, "id", "text", root, 1, removed=texts.where("id IN (5, 77)").select("id"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # older segments stay as they were
    now = texts.where("id NOT IN (3, 5, 77)").unionByName(new)
    again = spark.createDataFrame([(3, "w1"), (5, "back again")], "id long, text string")
    for _ in range(2):  # a batch may be run again
        I.add_segment(again, "id", "text", root, 2)
    latest = now.where("id <> 3").unionByName(again)
    I.merge(spark, root, to)
    for q in [*QUERIES, "rare again"]:
        assert scores(I.search(spark, root, q)) == scores(I.search(spark, to, q)) == scanned(latest, q), q


def test_disk_of_segments_and_merges_is_bounded(spark, texts, tmp_path, monkeypatch):
    """A batch's postings are written where they are made, and a merge shuffles some buckets at a time."""
    root, to = f"{tmp_path}/a", f"{tmp_path}/b"
    monkeypatch.setattr(I, "TEXT", 10000)
    stored, seen = I._stored, []

    def watched(placed, *more):
        seen.append((placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), placed.select("bucket").distinct().count(), placed.count()))
        return stored(placed, *more)

    monkeypatch.setattr(I, "_stored", watched)
    I.add_segment(texts, "id", "text", root, 0)
    assert [s[0] for s in seen] == [1]  # the texts'; before: the postings' too
    again = spark.createDataFrame([(3, "w1 rare"), (1000, "common rare")], "id long, text string")
    I.add_segment(again, "id", "text", root, 1, removed=texts.where("id = 77").select("id"))
    files = {str(p.parent) for p in (tmp_path / "a" / "postings" / "segment=0").rglob("*.parquet")}
    assert len(files) > 1 and len(list((tmp_path / "a" / "postings" / "segment=0").rglob("*.parquet"))) > len(files)  # more tasks for more text
    seen.clear()
    monkeypatch.setattr(I, "ROUND", 2000)
    every = spark.read.parquet(f"{root}/postings").count()
    I.merge(spark, root, to)
    assert len(seen) > 1 and max(s[1] for s in seen) <= -(-64 // (every // 2000)) and sum(s[2] for s in seen) == spark.read.parquet(f"{to}/postings").count()  # before: all at once
    latest = texts.where("id NOT IN (3, 77)").unionByName(again)
    for q in ("common w59 thing", "rare w1"):
        assert scores(I.search(spark, to, q)) == scanned(latest, q), q


NAMES = ["brave", "brave_knight", "old_brave_knight", "knight", "Brave_Knight_2", "br", "b_r_a", "bravery", "un_brave", None, "", "xbravex", "knight_of_brave"]


@pytest.mark.parametrize("query", ["brave", "brave_knight", "knight", "br", "b_r", "old_brave_knight", "zzz"])
def test_adjacent_names(spark, tmp_path, query):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string").repartition(2)
    I.index_grams(names, "id", "name", str(tmp_path))
    got = sorted((r.key, r.match_type) for r in I.adjacent(spark, str(tmp_path), query, names, "id", "name").collect())
    assert got == sorted((r.id, r.match_type) for r in S.adjacent(names, "name", query).collect())


def test_like_and_grep(spark, texts, tmp_path):
    assert I.grams_of("%ab_cdef%gh%") == ["cde", "def"] and I.like(spark, "none", "%ab%") is None
    I.index_grams(texts, "id", "text", str(tmp_path), keep_text=False)
    for terms in (["rare-thing"], ["w1 w2", "common"], ["C++"], ["w5", "mon w"], ["w"], ["nowhere"]):
        want = sorted(map(tuple, S.grep_files(texts, "text", terms).collect()))
        assert sorted((r.id, r.text, r.n_occurrences) for r in I.grep(texts, "id", "text", terms, str(tmp_path)).collect()) == want, terms
    candidates = I._holders(spark, str(tmp_path), ["rar", "are"], ["key"]).count()
    assert candidates == 1  # of 403 texts one is read and checked


def test_postings_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "B a, b É a"), (2, None), (3, "c")], "k long, t string")
    made = I.postings(docs, "k", "t")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()  # before: every word of every text
    assert sorted(map(tuple, made.collect())) == [("a", 1, 4, 2, [1, 3]), ("b", 1, 4, 2, [0, 2]), ("c", 3, 1, 1, [0])]
