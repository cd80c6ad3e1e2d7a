from pyspark.sql import functions as F

from palimpsest.operators.resolve import merge_containers, trace, winners
from palimpsest.sources import script

ONE = """# a comment
on_birth = { # appended lists
    events = { a.1 a.2 }
    trigger = { is_alive = yes age >= 16 }
}
x = "quoted \\"text\\"" y = @[ 1 + 2 ] z = { 1 2 { q = $P$ } } x = -3.5
"""
TWO = "on_birth = { events = { b.1 a.1 } trigger = { has_flag = yes } }\nbroken = { a = 1\n"


def tree(spark, *texts):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "digest string, text string")
    return script.nodes(df).cache()


def test_nodes():
    rows = {r[12]: r for r in script.nodes_of(ONE)}
    assert rows["on_birth.trigger.age"][5:9] == ["age", ">=", "16", "number"] and rows["on_birth.trigger.age"][9] == 4
    assert rows["on_birth.events.[]"][7] == "a.1" and rows["on_birth.events.[][1]"][7] == "a.2"
    assert rows["x"][8] == "string" and rows["x[1]"][7:9] == ["-3.5", "number"] and rows["y"][8] == "inline_expression"
    assert rows["z.[][2].q"][8] == "param" and rows["on_birth"][4] == "block"
    block = rows["on_birth"]
    assert ONE[block[10] : block[11]].startswith("on_birth = {") and ONE[block[10] : block[11]].endswith("}")
    for op in ("<", ">", "<=", ">=", "!=", "==", "?=", "="):
        assert [r[6] for r in script.nodes_of(f"a {op} b")][1] == op


def test_errors_are_rows():
    assert [r[13] for r in script.nodes_of("a = { b = 1") if r[13]] == ["unclosed block"]
    assert [r[13] for r in script.nodes_of("} = x") if r[13]] == ["stray }", "operator = without key"]
    assert [r[13] for r in script.nodes_of('a = "open') if r[13]] == ["unclosed string"]
    assert [r[4] for r in script.nodes_of("")] == ["root"]


def test_null_text_and_reprint(spark):
    assert tree(spark, None).count() == 0
    once = script.printed(tree(spark, ONE)).first().text
    again = script.printed(tree(spark, once)).first().text
    assert once == again and "age >= 16" in once
    assert script.diff(tree(spark, ONE), tree(spark, once)).count() == 0


def test_containers_over_sources(spark):
    items = script.slots(tree(spark, ONE, TWO), ("events", "trigger"))
    merged = merge_containers(items.selectExpr("*", "CAST(substr(digest, 2) AS INT) AS load_order"), "container", ["load_order", "pos"], "item", "slot", ("events",))
    got = {r.slot: r for r in merged.collect()}
    assert got["events"].merged == "a.1,a.2,b.1,a.1" and not got["events"].conflict
    assert got["trigger"].conflict and got["trigger"].winner == 1


def test_symbols_references_and_winners(spark):
    files = spark.createDataFrame([("f0", "base", "common/on_action/a.txt"), ("f1", "mod", "common/on_action/b.txt"), ("f1", "copy", "common/on_action/c.txt")], "digest string, source string, relpath string")
    found = script.symbols(tree(spark, ONE, TWO), files)
    assert found.where("name = 'on_birth'").count() == 3 and found.first().symbol_type == "on_action"
    ordered = found.selectExpr("*", "CASE source WHEN 'base' THEN 0 WHEN 'mod' THEN 1 ELSE 2 END AS load_order")
    assert winners(ordered, ["name"], ["load_order"], ["source"]).where("name = 'on_birth'").collect()[0].source == "copy"
    assert [r.is_winner for r in trace(ordered, "name", "on_birth", ["load_order"]).collect()] == [False, False, True]
    refs = script.references(tree(spark, "e = { trigger_event = my_event.1 has_trait = brave id = 12 }"))
    assert {(r.name, r.ref_type) for r in refs.collect()} == {("my_event.1", "event"), ("brave", "trait")}


def test_changes(spark):
    changes = script.diff(tree(spark, "a = 1 b = 2 c = { d > 3 }"), tree(spark, "a = 1 b = 5 c = { d < 3 } e = 4")).collect()
    assert sorted((r.path, r.change_type) for r in changes) == [("b", "modified"), ("c.d", "modified"), ("e", "added")]


def test_nodes_spread_and_joins_do_not_broadcast_them(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("id AS digest", "concat('p_', id, ' = { b = 2 c = { a = 1 } }') AS text")
    tree = script.nodes(rows)
    assert tree.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = script.slots(tree, ("c",))
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().sparkPlan().toString()
    assert made.count() == 400


def test_printed_parses_once_and_at_any_depth(spark):
    deep = "a = { " * 40 + "x = 1" + " }" * 40
    rows = spark.createDataFrame([("d", deep), ("e", "k = { z = { } y = 2 v b = 1 } q = 1")], "digest string, text string")
    made = script.printed(script.nodes(rows), indent=" ", sort_keys=True)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    texts = dict(made.collect())
    assert texts["e"] == "k = {\n v\n b = 1\n y = 2\n z = {\n }\n}\nq = 1"
    assert "x = 1" in texts["d"] and texts["d"].count("}") == 40


def test_a_text_in_parts_has_the_nodes_of_the_whole():
    import random

    rng = random.Random(5)
    pieces = ['a', 'b.1', ' ', '\n', '=', '<=', '?=', '!', '?', '{', '}', '"', '"x y"', '\\', '\\"', '#', '# c "\n', '@', '@[', ']', '@[ a + 1 ]', ';', ',', 'yes', '$P$', '﻿', 'é']
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        n = rng.randrange(1, 9)
        assert list(script.nodes_of((text[i : i + n] for i in range(0, len(text), n)), len(text))) == list(script.nodes_of(text)), (n, text)


def test_a_long_text_is_not_held():
    asked = []

    def parts():
        for i in range(300):
            asked.append(i)
            yield f"k{i} = {{ v = {i} }}\n"

    size = sum(len(f"k{i} = {{ v = {i} }}\n") for i in range(300))
    found = script.nodes_of(parts(), size)
    assert [next(found)[4] for _ in range(5)][0] == "root" and len(asked) < 8  # before: the whole text
    assert sum(1 for r in found if r[4] == "assignment") == 298


def test_parts_reach_their_texts(spark, monkeypatch):
    texts = [("a", "x = { y = 1 }\n" * 9), ("b", ""), ("c", None), ("d", 'é = "é\n' * 3 + '"'), ("e", "} # }")]
    monkeypatch.setattr(script, "PART", 5)
    got = sorted(tuple(r) for r in script.nodes(spark.createDataFrame(texts, "digest string, text string")).collect())
    assert [g[:2] for g in got] == sorted((k, r[0]) for k, t in texts if t is not None for r in script.nodes_of(t))
    assert {str(g[1:]) for g in got} == {str(tuple(r)) for k, t in texts if t is not None for r in script.nodes_of(t)}


def test_runs_of_words_are_single_nodes():
    """Words that nothing but separators part are read in one step, and give the rows that they gave one by one."""
    text = "l = { a b;yes\n 3 @c d﻿ e f@g h\n\ni = 1 j k }"
    rows = [(r[7], r[8], r[9], text[r[10] : r[11]], r[12]) for r in script.nodes_of(text) if r[4] == "value"]
    words = ["a", "b", "yes", "3", "@c", "d﻿", "e", "f@g", "h", "j", "k"]
    kinds = ["identifier", "identifier", "bool", "number", "scripted_value", *["identifier"] * 6]
    lines = [1, 1, 1, 2, 2, 2, 2, 2, 2, 4, 4]
    assert rows == [(w, k, n, w, f"l.[][{i}]" if i else "l.[]") for i, (w, k, n) in enumerate(zip(words, kinds, lines))]
    many = " ".join(f"w{i}" for i in range(5000))
    assert [g for g, *_ in script.tokens([f"l = {{ {many} }}"])] == ["atom", "op", "open", *["atom", "words"] * 5, "atom", "close"]  # before: 5000 atoms
    assert [r[7] for r in script.nodes_of(f"l = {{ {many} }}") if r[4] == "value"] == many.split()


def test_slots_join_nothing(spark):
    """Only the columns that are asked for leave the parser, and a node names its container itself."""
    df = spark.createDataFrame([("f0", ONE), ("f1", TWO), ("f2", "{ events = { x } } c = { events = y { z } events = { { q } } }")], "digest string, text string")
    slim = script.nodes(df, columns=script.SLOTS)
    assert slim.columns == ["digest", *script.SLOTS]
    made = script.slots(slim, ("events",))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before: a join
    got = sorted(map(str, made.collect()))
    assert got == sorted(map(str, script.slots(script.nodes(df), ("events",)).collect())) and len(got) == 6
    assert {(r.container, r.item) for r in made.where("digest = 'f2'").collect()} == {("c", "y"), ("c", None)}
