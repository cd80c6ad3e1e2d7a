"""Registered queries over script text, each beside the SQL that must agree with it.

Texts are written from the rows of the supplied tables, so that what is read back from them can be said in SQL over those
rows; the small fixtures stand in the SQL as they are expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import names as N
from palimpsest.plans.registry import query
from palimpsest.sources import lookups as L
from palimpsest.sources import script
from palimpsest.session import table

FILES = 64  # files that a table's blocks are dealt to


def _files(rows: DataFrame, number: str, block: Column) -> DataFrame:
    """Blocks dealt to files by a number: digest, text. A file's blocks stand in order of the number."""
    entry = F.struct(F.col(number).alias("i"), block.alias("s"))
    dealt = rows.groupBy((F.col(number) % FILES).alias("f")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["s"]), "\n").alias("text"))
    return dealt.select(F.concat(F.lit("file_"), F.col("f").cast("string")).alias("digest"), "text")


def _tree(rows: DataFrame, number: str, block: str) -> DataFrame:
    return script.nodes(_files(rows, number, F.expr(block)))


# --- lookups ---------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS character_id, c_name AS name, c_mktsegment AS culture, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_nationkey END AS religion, c_nationkey::BIGINT + 1 AS dynasty_id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - 1 END AS father_id, NULL::BIGINT AS mother_id, (1000 + c_custkey % 300) || '.' || (c_custkey % 12 + 1) || '.1' AS birth_date,
  CASE WHEN c_custkey % 3 = 0 THEN (1050 + c_custkey % 300) || '.2.3' END AS death_date FROM customer""")
def lookup_characters(spark: SparkSession, sf: str) -> DataFrame:
    block = """concat(c_custkey, ' = {\\n\\tname = "', c_name, '" # a comment\\n\\tname = "second"\\n\\tdynasty = ', c_nationkey + 1, ' culture = "', c_mktsegment, '"', if(c_custkey % 2 = 0, concat(' religion = r', c_nationkey), ''),
      if(c_custkey % 5 = 0, ' father = nobody', concat(' father = ', c_custkey - 1)), '\\n\\t', 1000 + c_custkey % 300, '.', c_custkey % 12 + 1, '.1 = { birth = yes }', if(c_custkey % 3 = 0, concat(' ', 1050 + c_custkey % 300, '.2.3 = { death = yes }'), ''), '\\n}')"""
    return L.characters(_tree(table(spark, sf, "customer"), "c_custkey", block)).drop("digest", "line")


@query("""SELECT s_suppkey AS province_id, 'province_' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new' || s_nationkey ELSE 'old' || s_nationkey END AS culture, 'faith' || s_nationkey AS religion,
  CASE WHEN s_suppkey % 3 = 0 THEN 'city' END AS holding_type FROM supplier""")
def lookup_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """The base's provinces, and an overlay's on top that tells only some of their values."""
    rows = table(spark, sf, "supplier")
    base = L.provinces(_tree(rows, "s_suppkey", "concat(s_suppkey, ' = { culture = old', s_nationkey, ' religion = faith', s_nationkey, if(s_suppkey % 3 = 0, ' holding = city', ''), ' }')"))
    over = L.provinces(_tree(rows.where("s_suppkey % 2 = 0"), "s_suppkey", "concat(s_suppkey, ' = { culture = new', s_nationkey, ' }')"))
    return L.overlaid(base, over, ["province_id"], ["culture", "religion", "holding_type"], ["name"])


@query("""SELECT DISTINCT 'name_list_' || replace(p_brand, '#', '_') AS name_list_id, unnest(CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ') ELSE [p_name] END) AS name, CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM part""")
def lookup_names(spark: SparkSession, sf: str) -> DataFrame:
    """Plain words for one gender, quoted names for the other."""
    block = """concat('name_list_', replace(p_brand, '#', '_'), ' = { ', if(p_size % 2 = 0, concat('male_names = { ', p_name, ' }'), concat('female_names = { "', p_name, '" }')), ' }')"""
    return L.names(_tree(table(spark, sf, "part"), "p_partkey", block)).drop("digest").distinct()


@query("SELECT 'site_' || n_nationkey AS site_key, 'c_' || n_name AS county, CASE WHEN n_nationkey % 2 = 0 THEN 'b_' || n_name END AS barony, n_name || ' flag' AS flag FROM nation WHERE n_nationkey % 4 <> 0")
def lookup_holy_sites(spark: SparkSession, sf: str) -> DataFrame:
    block = """concat('site_', n_nationkey, ' = { ', if(n_nationkey % 4 <> 0, concat('county = c_', n_name), 'x = y'), if(n_nationkey % 2 = 0, concat(' barony = b_', n_name), ''), ' flag = "', n_name, ' flag" }')"""
    return L.holy_sites(_tree(table(spark, sf, "nation"), "n_nationkey", block)).drop("digest", "line")


@query("SELECT s_suppkey + 1000 AS dynasty_id, s_name AS name_key, CASE WHEN s_suppkey % 3 = 0 THEN 'of' END AS prefix, 'n' || s_nationkey AS culture FROM supplier")
def lookup_dynasties(spark: SparkSession, sf: str) -> DataFrame:
    block = """concat(s_suppkey + 1000, ' = { name = "', s_name, '"', if(s_suppkey % 3 = 0, ' prefix = of', ''), ' culture = n', s_nationkey, ' inner = { name = wrong } }')"""
    return L.dynasties(_tree(table(spark, sf, "supplier"), "s_suppkey", block)).drop("digest", "line")


@query("""SELECT 'trait_' || p_partkey AS name, p_type AS category, 'g' || (p_size % 5) AS trait_group, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS level, p_size % 3 = 0 AS is_genetic, false AS is_physical, p_size % 4 = 0 AS is_health, false AS is_fame,
  'a' || p_size || ',b' AS flags, CASE WHEN p_size % 2 = 1 THEN 'trait_' || (p_partkey + 1) ELSE '' END AS opposites, (p_size % 7)::VARCHAR AS diplomacy, CASE WHEN p_size % 3 = 1 THEN '-0.5' END AS health, CASE WHEN p_size % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS n_modifiers FROM part""")
def lookup_traits(spark: SparkSession, sf: str) -> DataFrame:
    block = """concat('trait_', p_partkey, ' = { category = "', p_type, '" group = g', p_size % 5, ' level = ', if(p_size % 2 = 0, string(p_size), 'high'), ' genetic = ', if(p_size % 3 = 0, 'yes', 'no'), if(p_size % 4 = 0, ' health_trait = yes', ''),
      ' flag = a', p_size, ' flag = b', if(p_size % 2 = 1, concat(' opposite = trait_', p_partkey + 1), ''), ' diplomacy = ', p_size % 7, if(p_size % 3 = 1, ' health = -0.5', ''), ' triggered = { martial = 9 } }')"""
    found = L.traits(_tree(table(spark, sf, "part"), "p_partkey", block))
    return found.select(
        "name", "category", "trait_group", "level", "is_genetic", "is_physical", "is_health", "is_fame", F.array_join("flags", ",").alias("flags"), F.array_join("opposites", ",").alias("opposites"),
        F.try_element_at("modifiers", F.lit("diplomacy")).alias("diplomacy"), F.try_element_at("modifiers", F.lit("health")).alias("health"), F.size("modifiers").cast("long").alias("n_modifiers"),
    )


@query("SELECT 'ns' || (o_custkey % 9) || '.' || o_orderkey AS event_name, 'ns' || (o_custkey % 9) AS namespace, o_orderstatus || '_event' AS event_type, o_orderpriority AS theme, o_orderkey % 3 = 0 AS is_hidden FROM orders")
def lookup_events(spark: SparkSession, sf: str) -> DataFrame:
    block = """concat('ns', o_custkey % 9, '.', o_orderkey, ' = { type = ', o_orderstatus, '_event theme = "', o_orderpriority, '" hidden = ', if(o_orderkey % 3 = 0, 'yes', 'no'), ' option = { type = inner } }')"""
    return L.events(_tree(table(spark, sf, "orders"), "o_orderkey", block)).drop("digest", "line")


@query("SELECT 'decide_' || o_orderkey AS name, o_orderkey % 4 = 0 AS major, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END::INT AS ai_check_interval FROM orders")
def lookup_decisions(spark: SparkSession, sf: str) -> DataFrame:
    block = "concat('decide_', o_orderkey, ' = { ', if(o_orderkey % 4 = 0, 'major = yes', ''), ' ai_check_interval = ', if(o_custkey % 2 = 0, string(o_custkey), '@often'), ' }')"
    return L.decisions(_tree(table(spark, sf, "orders"), "o_orderkey", block)).drop("digest", "line")


@query("""SELECT 'k_' || n_nationkey AS title_key, 'kingdom' AS tier, 'e_' || n_regionkey AS liege, 'c_' || n_nationkey AS capital, '1 2 ' || n_nationkey AS color FROM nation
  UNION ALL SELECT 'e_' || n_regionkey, 'empire', NULL, NULL, NULL FROM nation UNION ALL SELECT 'b_' || n_nationkey, 'barony', 'k_' || n_nationkey, NULL, NULL FROM nation""")
def lookup_titles(spark: SparkSession, sf: str) -> DataFrame:
    block = "concat('e_', n_regionkey, ' = { k_', n_nationkey, ' = { color = { 1 2 ', n_nationkey, ' } capital = c_', n_nationkey, ' cultural_names = { b_', n_nationkey, ' = { } } } }')"
    return L.titles(_tree(table(spark, sf, "nation"), "n_nationkey", block)).drop("digest", "line")


# --- symbols, references, trees ----------------------------------------------------------------------


KEYS_SQL = "['has_trait', 'culture', 'trigger_event', 'cb_type', 'has_building', 'lifestyle', 'scripted_trigger']"


@query(f"""SELECT p_partkey, {KEYS_SQL}[p_size % 7 + 1] AS key, 'x' || p_partkey AS name, ['trait', 'culture', 'event', 'cb_type', 'building', 'lifestyle', 'scripted_trigger'][p_size % 7 + 1] AS ref_type,
  CASE WHEN p_size % 3 = 0 THEN 'limit' WHEN p_size % 3 = 1 THEN 'effect' ELSE {KEYS_SQL}[p_size % 7 + 1] END AS context FROM part""")
def reference_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """One reference a part, inside a limit in an effect, an effect, or none."""
    key = f"element_at(array{KEYS_SQL.replace('[', '(').replace(']', ')')}, p_size % 7 + 1)"
    block = (
        "concat('p_', p_partkey, ' = { ', if(p_size % 3 < 2, 'effect = { if = { ', 'other = { if = { '), if(p_size % 3 = 0, 'limit = { ', 'then = { '), "
        + key
        + ", ' = x', p_partkey, ' z = 1 } } } }')"
    )
    refs = script.references(_tree(table(spark, sf, "part"), "p_partkey", block))
    last = F.element_at(F.split("path", "[.]"), -1)
    return refs.select(F.substring("name", 2, 20).cast("long").alias("p_partkey"), last.alias("key"), "name", "ref_type", "context")


@query("SELECT p_partkey AS name, sum(l)::BIGINT AS n_nodes, 6 + p_size % 3 AS want FROM (SELECT p_partkey, p_size, unnest([6 + p_size % 3]) AS l FROM part) GROUP BY p_partkey, p_size")
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of every part's block: the block, an assignment, a list of two to four values, a block with a value."""
    block = "concat('p_', p_partkey, ' = { a = ', p_size, ' list = { 1 2', repeat(' 3', p_size % 3), ' } c = { x } }')"
    tree = _tree(table(spark, sf, "part"), "p_partkey", block)
    each = tree.where("depth >= 0").groupBy("digest", "top_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("depth") == 0, F.col("key"))).alias("k"))
    size = F.col("n") - 1
    return each.select(F.substring("k", 3, 20).cast("long").alias("name"), size.alias("n_nodes"), size.cast("int").alias("want"))


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of every part's block, each part a file: some values modified, removed, added, of another type."""
    rows = table(spark, sf, "part")
    old = rows.selectExpr("p_partkey AS digest", "concat('p = { size = ', p_size, ' type = ', p_type, ' tags = { a b } inner = { x > 1 } }\\nq = { y = 1 }') AS text")
    new = rows.selectExpr("p_partkey AS digest", """concat('q = { y = 1 }\\np = { size = ', if(p_partkey % 3 = 0, p_size + 1, p_size), if(p_partkey % 4 = 1, '', concat(' type = ', p_type)), if(p_partkey % 5 = 2, ' extra = yes', ''), ' tags = { a ', if(p_partkey % 7 = 0, 'c', 'b'), ' } inner = { x ', if(p_partkey % 2 = 0, '>', '<'), ' 1 } }', if(p_partkey % 6 = 5, '\\nr = { }', '')) AS text""")
    return script.nodes(old), script.nodes(new)


@query("""SELECT p_partkey AS digest, 'p.size' AS path, 'modified' AS change_type, p_size::VARCHAR AS old_value, (p_size + 1)::VARCHAR AS new_value FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'p.type', 'removed', p_type, NULL FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'p.extra', 'added', NULL, 'yes' FROM part WHERE p_partkey % 5 = 2
  UNION ALL SELECT p_partkey, 'p.tags.[][1]', 'modified', 'b', 'c' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p.inner.x', 'modified', '1', '1' FROM part WHERE p_partkey % 2 = 1""")
def batch_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between two versions of every part's script in one plan."""
    return script.diff(*_two(spark, sf), keep=("digest",)).select("digest", "path", "change_type", "old_value", "new_value")


@query("""WITH c AS (SELECT 'modified' AS t, 'p.size' AS path FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'removed', 'p.type' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'added', 'p.extra' FROM part WHERE p_partkey % 5 = 2
  UNION ALL SELECT 'modified', 'p.tags.[][1]' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'modified', 'p.inner.x' FROM part WHERE p_partkey % 2 = 1)
  SELECT 'types' AS section, t AS label, count(*) AS n FROM c GROUP BY t UNION ALL SELECT 'paths', path, count(*) FROM c GROUP BY path""")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.sinks.export import change_summary

    return change_summary(script.diff(*_two(spark, sf), keep=("digest",)), "digest").where("section <> 'changes'").drop("detail")


@query("SELECT p_partkey AS digest, 'p = {' || chr(10) || chr(9) || 'size >= ' || p_size || chr(10) || chr(9) || 'name = \"' || p_name || '\"' || chr(10) || chr(9) || 'tags = {' || chr(10) || chr(9) || chr(9) || 'a' || chr(10) || chr(9) || chr(9) || 'b' || chr(10) || chr(9) || '}' || chr(10) || '}' AS text FROM part")
def reprinted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in one line, parsed and printed with tabs."""
    rows = table(spark, sf, "part").selectExpr("p_partkey AS digest", """concat('p={size>=', p_size, ' name = "', p_name, '" # gone\\ntags = { a b } }') AS text""")
    return script.printed(script.nodes(rows))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(['p_' || p_partkey, 'size', CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END]) AS key FROM part) GROUP BY key")
def tree_keys(spark: SparkSession, sf: str) -> DataFrame:
    return N.keys_of(_tree(table(spark, sf, "part"), "p_partkey", "concat('p_', p_partkey, ' = { size = ', p_size, if(p_size % 2 = 0, ' even', ' odd'), ' = { yes } }')"))


@query("SELECT 'p_' || p_partkey || '.name' AS path, p_name AS value FROM part WHERE contains(p_name, 'bolt') UNION ALL SELECT 'p_7.size', p_size::VARCHAR FROM part WHERE p_partkey = 7")
def tree_search(spark: SparkSession, sf: str) -> DataFrame:
    """Values that hold a text, and the node at a path."""
    tree = _tree(table(spark, sf, "part"), "p_partkey", """concat('p_', p_partkey, ' = { size = ', p_size, ' size = 0 name = "', p_name, '" }')""")
    return N.values_in_tree(tree, "BOLT").unionByName(N.at_path(tree, "p_7.size")).select("path", "value")


