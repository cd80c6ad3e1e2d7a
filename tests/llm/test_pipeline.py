import random

import corpus_pipeline
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import targets

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_repeats(texts, length=400):
    raw, seen = [t.encode() for t in texts], {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "replace"))
    return out


def corpus():
    rng = random.Random(11)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(1500)] for lang, letters in (("en", "abcdefghilmnop"), ("fr", "éèaeiouqrstçz"))}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    items = [(i, text("en", 30)) for i in range(5)]
    passage = text("en", 120)
    rows, leaks = [], set()
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        t = text(lang, rng.randint(20, 300))
        if i % 16 == 3:
            t = passage.join([t, text(lang, 90)])
        if i % 20 == 9:
            t, _ = f"{t} {items[i % 5][1]} {text(lang, 20)}", leaks.add(i)
        rows.append((i, t, lang if i % 7 else None, f"src{min(i % 5, 2)}", len(t)))
    for k in (10, 11, 12):
        rows.append((200 + k, rows[k][1], "en", "src0", 0))
        rows.append((300 + k, rows[k][1] + " tail", "en", "src1", 0))
    rows += [(400, None, "en", "src0", None), (401, "", "en", "src0", 0), (402, "12 34 !", None, None, 7), (403, "un é", "fr", None, 4)]
    return rows, items, leaks


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, leaks = corpus()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    told = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    least = {d: c for d, _, c in components([(r[0], r[1]) for r in told])}
    kept = [r for r in told if least[r[0]] == r[0]]
    texts = brute_repeats([r[1] for r in kept])
    clean = [(r[0], t, r[2], r[3]) for r, t in zip(kept, texts) if r[0] not in leaks]
    size = lambda t: len(t.split())
    sizes = {}
    for _, t, _, s in clean:
        sizes[s] = sizes.get(s, 0) + size(t)

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    by_id = {r[0]: r for r in clean}
    assert any(len(t) < len(r[1]) for r, t in zip(kept, texts)) and set(got) <= set(by_id)
    taken = {}
    for d, r in got.items():
        _, text, lang, source = by_id[d]
        assert (r.text, r.lang, r.source, r.size) == (text, lang, source, size(text))
        taken[source] = taken.get(source, 0) + r.taken
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 0.5 + 1e-9
        if want >= sizes[s]:
            assert {d for d, r in by_id.items() if r[3] == s and size(r[1])} <= set(got)


def test_stage_columns_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_and_not_ids_decide(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghilmnop", k=rng.randint(3, 9))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(30)) for i in range(3)]
    a, b, c, d, e, f, g, h = (text(80) for _ in range(8))
    row = lambda i, t, source="s": (i, t, "en", source, len(t))
    equal, leak = row(1, a), f"{text(40)} {items[1][1]} {text(40)}"
    rows = [equal, equal, equal]  # equal rows
    rows += [row(2, b, "x"), row(2, b, "y"), row(2, c)]  # one id, two copies and another text
    rows += [row(None, d), row(None, d), row(None, d + " tail"), row(None, e), row(None, f), row(3, f)]  # no id
    rows += [row(4, g), row(5, g), row(5, h)]  # a clean row with the id of a copy
    rows += [(None, "", "en", "s", 0)] * 2
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()]
    one = lambda *options: sum(got.count(r) for r in set(options)) == 1
    assert one(equal) and one(row(2, b, "x"), row(2, b, "y")) and one(row(None, d), row(None, d + " tail"))
    assert all(got.count(r) == 1 for r in (row(2, c), row(None, e), row(3, f), row(4, g), row(5, h)))
    assert got.count((None, "", "en", "s", 0)) == 2 and len(got) == 10

    rows = [row(None, leak), row(None, a), row(7, leak), row(7, b), row(8, c), row(8, c), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [row(None, a), row(7, b), row(8, c), row(8, c), (None,) * 5]))


def test_passages_of_just_over_50_words(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghilmnop", k=rng.randint(3, 8))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(n) for n in range(51, 61)]
    assert sum(len(p) < 400 for p in passages) > 7
    rows = [(3 * i + k, f"{text(90)} {p} {text(90)}", "en", "s", 0) for i, p in enumerate(passages) for k in range(3)]
    rows += [(100 + i, text(120), "en", "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, str(tmp_path)).collect()}
    assert all(passages[d // 3] not in t and len(t.split()) in range(178, 183) for d, t in got.items() if d < 100)
    assert all(got[d] == t for d, t, *_ in rows if d >= 100) and len(got) == len(rows)


def test_clashing_columns(spark, tmp_path):
    """Every stage returns all columns of its input with their values, whatever their names."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghilmnop", k=rng.randint(3, 9))) for _ in range(800)]
    names = ["score", "lang_pred", "size", "source_size", "target", "passes", "taken", "row", "own", "key", "kept", "cls", "component_id", "__row", "__place", "place", "n", "least"]
    names += ["cuts", "n_removed", "no_text", "anchor", "words", "named", "hits", "id", "no_id", "n_shingles"]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", "s", 0, *range(100 * i, 100 * i + len(names))) for i in range(12)]
    rows.append((20, rows[5][1], *rows[5][2:]))
    docs = spark.createDataFrame(rows, DOCUMENTS + "".join(f", `{n}` int" for n in names)).repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns), name
        got = out.select(*[f"`{c}`" for c in docs.columns]).collect()
        assert len(got) >= 11, name
        for r in got:
            if name == "repeats" and r.doc_id in (5, 20):
                assert r.text == "" and tuple(r)[2:4] + tuple(r)[5:] == given[r.doc_id][2:4] + given[r.doc_id][5:]
            else:
                assert tuple(r) == given[r.doc_id], name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(range(1, 12)) and got and all((r.score, r.taken, r.mix_size) == (100 * r.doc_id, 100 * r.doc_id + 6, 60) for r in got)


def test_unknown_languages_go(spark, tmp_path):
    rng = random.Random(4)
    letters = {"en": "abcdefghilmnop", "fr": "éèaeiouqrstçz", "de": "äöüßkwvxnerst", "es": "ñóíáúlmdoaey"}
    words = {lang: ["".join(rng.choices(own, k=rng.randint(3, 9))) for _ in range(400)] for lang, own in letters.items()}
    langs = sorted(letters)
    rows = [(i, " ".join(rng.choices(words[langs[i % 4]], k=rng.choice([12, 40, 300]))), langs[i % 4], "s", 0) for i in range(200)]
    foreign = ["".join(rng.choices("абвгдежзиклмнопрст", k=6)) for _ in range(60)]
    rows += [(300, " ".join(foreign), None, "s", 0), (301, " ".join(foreign[:12]) * 30, None, "s", 0)]
    rows += [(302, foreign[0], None, "s", 0), (303, "12 34", None, "s", 0), (304, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()} == {*range(200), 302}
