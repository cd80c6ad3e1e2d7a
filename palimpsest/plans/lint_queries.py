"""Registered queries over lint rules, evaluated together in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import lint_rules as L
from palimpsest.plans.registry import query
from palimpsest.sources import script
from palimpsest.session import table

TRANSITIONS = {"liege": "character", "capital": "province", "faith": "faith"}


def _rules() -> list[L.NodeRule | L.BlockRule]:
    scoped = L.wrong_scope({"has_trait": ["root", "character"], "terrain": ["province"]})
    return [scoped, L.deprecated(["old_key"]), L.truth_values(), L.too_deep(3), L.duplicate_keys(), L.empty_block(), L.missing_keys(["type", "desc"])]


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS z, 'p_' || p_partkey AS p FROM part)
  SELECT k AS digest, 'wrong_scope' AS rule, 'error' AS severity, p || '.liege.capital.has_trait' AS path, 3 AS line, 1::BIGINT AS n FROM s UNION ALL SELECT k, 'wrong_scope', 'error', p || '.terrain', 4, 1 FROM s WHERE z % 2 = 0
  UNION ALL SELECT k, 'deprecated', 'warning', p || '.old_key', 5, 1 FROM s WHERE z % 3 = 0 UNION ALL SELECT k, 'truth_value', 'warning', p || '.flag', 6, 1 FROM s WHERE z % 5 = 0
  UNION ALL SELECT k, 'too_deep', 'info', p || '.a.b.c.d', 7, 1 FROM s UNION ALL SELECT k, 'duplicate_key', 'warning', p || '.a.b.x', 7, 1 + z % 4 FROM s WHERE z % 4 > 0
  UNION ALL SELECT k, 'empty_block', 'info', p || '.a.b.c.d', 7, 1 FROM s UNION ALL SELECT k, 'missing', 'error', p, 1, 1 + (z % 7 > 0)::INT FROM s""")
def lint_all(spark: SparkSession, sf: str) -> DataFrame:
    """Seven rules over every part's text: what is found, in one scan."""
    text = """concat('p_', p_partkey, ' = {\\n has_trait = ok\\n liege = { has_trait = ok capital = { terrain = hills has_trait = bad } }\\n', if(p_size % 2 = 0, ' terrain = hills', ' weight = 1'), '\\n', if(p_size % 3 = 0, ' old_key = 1', ' new_key = 1'),
      '\\n flag = ', if(p_size % 5 = 0, 'TRUE', 'yes'), '\\n a = { b = { x = 1', repeat(' x = 2', p_size % 4), ' c = { d = { } } } }\\n', if(p_size % 7 = 0, ' type = t', ''), '\\n}') AS text"""
    tree = script.nodes(table(spark, sf, "part").selectExpr("p_partkey AS digest", text))
    return L.lint(tree, _rules(), TRANSITIONS)
