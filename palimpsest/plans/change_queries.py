"""Registered queries over change sets: a state kept up to date against one resolved anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import incremental as N
from palimpsest.plans.queries import DEFS, DOWN, TIES, _defs
from palimpsest.plans.registry import query

ORDER = ["load_order", *TIES]


def _changed(spark: SparkSession, sf: str) -> list[N.Resolved]:
    """The state at first, and after files of lineitem's orders came, went and changed."""
    every = _defs(spark, sf)
    states = [N.resolved(every.where("file % 5 <> 1"), ["name"], ORDER)]
    sets = [
        (every.where("file % 5 = 1"), every.where("false")),  # new files
        (every.where("false"), every.where("file % 7 = 2")),  # files that go, winners among them
        (every.where("file % 11 = 3").withColumn("load_order", F.col("load_order") % 3), every.where("file % 13 = 4")),  # files that change
    ]
    for new, gone in sets:
        states.append(N.change(states[-1], new, gone.select("file"), ["name"], ORDER, ["file"]))
    return states


BEFORE = f"{DEFS}, old AS (SELECT * FROM def WHERE file % 7 <> 2)"
AFTER = f"{BEFORE}, now AS (SELECT * FROM old WHERE file % 11 <> 3 AND file % 13 <> 4 UNION ALL SELECT * REPLACE (load_order % 3 AS load_order) FROM def WHERE file % 11 = 3)"


def _winners(rows: str) -> str:
    return f"SELECT name, load_order, file, line, price, n::BIGINT AS overridden_count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {DOWN}) AS r, count(*) OVER (PARTITION BY name) - 1 AS n FROM {rows}) WHERE r = 1"


@query(f"{AFTER} {_winners('now')}")
def state_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The winners after three change sets, each of which touches some keys only."""
    return _changed(spark, sf)[-1].state.select("name", "load_order", "file", "line", "price", "overridden_count")


@query(f"""{AFTER}, a AS ({_winners('old')}), b AS ({_winners('now')})
  SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN (a.load_order, a.file, a.line) <> (b.load_order, b.file, b.line) THEN 'replaced' ELSE 'recounted' END AS change,
    a.file AS old_file, b.file AS new_file, a.overridden_count AS old_hidden, b.overridden_count AS new_hidden
  FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR (a.load_order, a.file, a.line, a.overridden_count) <> (b.load_order, b.file, b.line, b.overridden_count)""")
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the last of three change sets did to the winners."""
    told = _changed(spark, sf)[-1].changes
    return told.select("name", "change", F.col("old.file").alias("old_file"), F.col("new.file").alias("new_file"), F.col("old.overridden_count").alias("old_hidden"), F.col("new.overridden_count").alias("new_hidden"))
