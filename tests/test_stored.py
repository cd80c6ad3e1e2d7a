import pytest

from palimpsest.operators import stored as ST


@pytest.fixture
def unhinted(spark):
    """Tables of any size are joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_by_digest_do_not_shuffle(unhinted):
    spark = unhinted
    rows = spark.range(1000).selectExpr("cast(id % 300 as string) AS digest", "id", "id % 3 AS cvid")
    made = {
        "t_contents": rows.select("digest").distinct(), "t_trees": rows.where("id % 300 < 200").select("digest").distinct(),
        "t_symbols": rows.where("id < 250").selectExpr("digest", "concat('s', id) AS name"), "t_files": rows.selectExpr("digest", "id AS file", "cvid"),
    }
    t = {n: ST.store(df, n, ["digest"], 8) for n, df in made.items()}
    try:
        versions = spark.createDataFrame([(0, "a"), (1, "b")], "cvid long, version string")
        near = t["t_symbols"].join(t["t_trees"], "digest").join(t["t_files"], "digest")
        for df, want in ((near, 200 * 10 // 3), (ST.unparsed(t["t_contents"], t["t_trees"]), 100), (ST.orphaned(t["t_contents"], t["t_files"]), 0)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert df.count() in range(want, want + 40)
        told = ST.defined_in(t["t_symbols"], t["t_trees"], t["t_files"], versions)
        plain = made["t_symbols"].join(made["t_trees"], "digest").join(made["t_files"], "digest").join(versions, "cvid")
        assert sorted(map(str, told.select(sorted(plain.columns)).collect())) == sorted(map(str, plain.select(sorted(plain.columns)).collect()))
    finally:
        ST.drop(spark, *made)
