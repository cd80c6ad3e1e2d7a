import random

from pyspark.sql import functions as F

from palimpsest.operators import lint as old
from palimpsest.operators import lint_rules as L
from palimpsest.sources import script


def texts():
    rng = random.Random(6)

    def block(depth):
        items = []
        for _ in range(rng.randint(0, 5)):
            key = rng.choice(["a", "b", "need", "old", "liege"])
            items.append(f"{key} = {{ {block(depth + 1)} }}" if depth < 4 and rng.random() < 0.4 else rng.choice([f"{key} = {rng.choice(['1', 'yes', 'true'])}", "7"]))
        return " ".join(items)

    return [(f"f{i}", "\n".join(f"top{j} = {{ {block(1)} }}" for j in range(3))) for i in range(40)] + [("e", ""), ("n", None)]


def test_together_as_one_by_one(spark):
    tree = script.nodes(spark.createDataFrame(texts(), "digest string, text string")).cache()
    got = L.lint(tree, [L.duplicate_keys(), L.empty_block(), L.deprecated(["old"]), L.missing_keys(["need", "a"])])
    want = old.duplicate_keys(tree).unionByName(old.empty_blocks(tree)).unionByName(old.deprecated(tree, ["old"])).unionByName(old.missing_keys(tree, ["need", "a"]))
    key = lambda rows: sorted((r.digest, r.rule, r.path, r.line, r.n) for r in rows.collect())
    assert key(got) == key(want) and len(key(got)) > 100


def test_scopes_go_down_and_one_scan(spark, tmp_path):
    tree = script.nodes(spark.createDataFrame([("f", "t = { has = 1 liege = { has = 2 land = { has = 3 other = { has = 4 } liege = { has = 5 } } } }")], "digest string, text string"))
    tree.write.parquet(str(tmp_path / "tree"))
    stored = spark.read.parquet(str(tmp_path / "tree"))
    scopes = {r.value: r.s for r in stored.where("key = 'has'").select("value", L.scope(F.col("ancestors"), {"liege": "character", "land": "province"}).alias("s")).collect()}
    assert scopes == {"1": "root", "2": "character", "3": "province", "4": "province", "5": "character"}
    rules = [L.wrong_scope({"has": ["root", "character"]}), L.deprecated(["x"]), L.truth_values(), L.too_deep(1), L.duplicate_keys(), L.empty_block(), L.missing_keys(["has"])]
    found = L.lint(stored, rules, {"liege": "character", "land": "province"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.rule, r.path) for r in found.collect() if r.rule == "wrong_scope") == [("wrong_scope", "t.liege.land.has"), ("wrong_scope", "t.liege.land.other.has")]
    assert L.lint(stored, []).count() == 0 and L.lint(stored.where("false"), rules).count() == 0


def test_a_rule_of_ones_own(spark):
    tree = script.nodes(spark.createDataFrame([("f", "a = { x >= 3 y = 2 }")], "digest string, text string"))
    rule = L.NodeRule("compared", "info", F.col("op") == ">=")
    assert [(r.rule, r.path, r.n) for r in L.lint(tree, [rule]).collect()] == [("compared", "a.x", 1)]
