from palimpsest.plans.table_queries import unit_histogram


def test_units_are_made_once(spark):
    made = unit_histogram(spark, "/root/testdata/sf0.001")
    assert not [f for f in made.inputFiles() if "lineitem" in f]  # before: three times in one plan
    assert {r["what"] for r in made.collect()} == {"risk", "domain", "status", "all"}
