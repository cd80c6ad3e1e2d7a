"""Registered queries over references, histories, paths and what is left to do, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import conflicts as C
from palimpsest.operators import index as I
from palimpsest.operators import stored as ST
from palimpsest.operators import units as U
from palimpsest.operators.list_diff import list_changes
from palimpsest.plans.index_queries import bm25_sql
from palimpsest.plans.registry import query
from palimpsest.plans.script_queries import _files, _tree
from palimpsest.plans.table_queries import UNITS, _contributions
from palimpsest.session import shared_folder, table
from palimpsest.sources import lookups as L
from palimpsest.sources import script
from palimpsest.sources.long_script import long_nodes


@query(f"{UNITS} SELECT v.unit_key, c.file_id, c.node_id, v.top AS winner_order, count(*) AS n FROM v JOIN c ON v.unit_key = c.unit_key WHERE c.source = 's7' AND c.load_order < v.top GROUP BY ALL")
def losing_units(spark: SparkSession, sf: str) -> DataFrame:
    """What one source loses to others, and to whom."""
    rows = _contributions(spark, sf)
    units = U.conflict_units(rows, base_order=0)
    lost = U.losing_source(U.candidates(rows, units), "s7")
    return lost.select("unit_key", "file_id", "node_id").join(units.select("unit_key", "winner_order"), "unit_key").groupBy("unit_key", "file_id", "node_id", "winner_order").agg(F.count("*").alias("n"))


@query(bm25_sql(["ring", "small"], "SELECT p_partkey AS doc_id, replace(p_name, ' ', '_') AS text FROM part WHERE p_size % 2 = 0"))
def reference_search(spark: SparkSession, sf: str) -> DataFrame:
    """References of one kind ranked by the words of their names, from a stored index."""
    tree = _tree(table(spark, sf, "part"), "p_partkey", "concat('p_', p_partkey, ' = { ', if(p_size % 2 = 0, 'has_trait', 'trigger_event'), ' = ', replace(p_name, ' ', '_'), ' }')")
    heads = tree.where("depth = 0 AND node_type = 'block'").select("digest", "top_id", F.substring("key", 3, 20).cast("long").alias("doc_id"))
    refs = script.references(tree).where("ref_type = 'trait'").join(heads, ["digest", "top_id"])
    root = shared_folder(spark, "refs")
    I.add_segment(refs.select("doc_id", "name"), "doc_id", "name", root, 0)
    return I.search(spark, root, "small_ring").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey, lower(trim(replace(CASE p_size % 3 WHEN 0 THEN '/' WHEN 1 THEN '' ELSE '\\' END || 'Common\\' || p_type || '/' || p_name || '.TXT' || CASE WHEN p_size % 2 = 0 THEN '//' ELSE '' END, '\\', '/'), '/')) AS path FROM part")
def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as they are compared: lower case, forward slashes, none at the ends."""
    raw = F.concat(F.expr("CASE p_size % 3 WHEN 0 THEN '/' WHEN 1 THEN '' ELSE chr(92) END"), F.lit("Common\\"), "p_type", F.lit("/"), "p_name", F.lit(".TXT"), F.expr("if(p_size % 2 = 0, '//', '')"))
    return table(spark, sf, "part").select("p_partkey", rules.normal_path(raw).alias("path"))


@query("SELECT p_partkey AS digest FROM part WHERE p_size % 3 > 0")
def trees_without_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed contents that define nothing: only numbers, reserved words and short names."""
    rows = table(spark, sf, "part").selectExpr("p_partkey AS digest", "CASE p_size % 3 WHEN 0 THEN concat('name_', p_size, ' = { a = 1 }') WHEN 1 THEN concat(p_size, ' = { }') ELSE 'yes = { } x = { }' END AS text")
    tree = script.nodes(rows)
    symbols = script.symbols(tree, rows.selectExpr("digest", "'base' AS source", "concat('common/traits/', digest, '.txt') AS relpath"))
    return C.without(tree.select("digest").distinct(), symbols, ["digest"])


@query("SELECT 'decide_' || o_orderkey AS name, o_orderkey % 4 = 0 AS major FROM orders WHERE o_orderkey % 64 NOT IN (SELECT o_orderkey % 64 FROM orders WHERE o_orderkey % 64 < 40)")
def lookup_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the files from which none were extracted yet."""
    tree = _tree(table(spark, sf, "orders"), "o_orderkey", "concat('decide_', o_orderkey, ' = { ', if(o_orderkey % 4 = 0, 'major = yes', 'x = 1'), ' }')")
    done = tree.select("digest").distinct().where(F.substring_index("digest", "_", -1).cast("int") < 40)
    return L.decisions(L.fresh(tree, done)).select("name", "major")


@query("""SELECT 'c_' || s_suppkey AS title_key, (1000 + s_suppkey % 90) || '.1.1' AS date, s_nationkey::VARCHAR AS holder, CASE WHEN s_suppkey % 2 = 0 THEN 'd_' || s_nationkey END AS liege, NULL::VARCHAR AS government, 2 AS line FROM supplier
  UNION ALL SELECT 'c_' || s_suppkey, (1100 + s_suppkey % 90) || '.12.' || (s_suppkey % 28 + 1), '0', NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'republic' END, 3 FROM supplier""")
def title_history(spark: SparkSession, sf: str) -> DataFrame:
    """Holders and lieges of titles by date."""
    text = """concat('c_', s_suppkey, ' = {\n ', 1000 + s_suppkey % 90, '.1.1 = { holder = ', s_nationkey, ' holder = 99', if(s_suppkey % 2 = 0, concat(' liege = d_', s_nationkey), ''), ' }\n ',
      1100 + s_suppkey % 90, '.12.', s_suppkey % 28 + 1, ' = { holder = 0', if(s_suppkey % 3 = 0, ' government = republic', ''), ' }\n name = x\n}') AS text"""
    found = L.title_history(script.nodes(table(spark, sf, "supplier").selectExpr("s_suppkey AS digest", text)))
    return found.select("title_key", "date", "holder", "liege", "government", F.col("line").cast("int").alias("line"))


def _stored(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Documents as files of contents with their trees, symbols and versions, in tables by digest."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2(text, 256).alias("digest"), F.split(text, " ")[0].alias("word"))
    labels = table(spark, sf, "labels").select("doc_id")
    tag = uuid.uuid4().hex[:12]
    parts = {
        "contents": docs.groupBy("digest").agg(F.count("*").alias("n_files")),
        "trees": docs.join(labels, "doc_id", "left_semi").select("digest").distinct(),
        "symbols": docs.where("word <> ''").groupBy("digest").agg(F.min("word").alias("name")),
        "files": docs.select("digest", "doc_id", F.col("source").alias("cvid")),
    }
    return {name: ST.store(df, f"{name}_{tag}", ["digest"]) for name, df in parts.items()}


STORED = """WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), ' ')[1] AS word FROM documents),
  t AS (SELECT DISTINCT digest FROM d WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(f"{STORED}, s AS (SELECT digest, min(word) AS name FROM d WHERE word <> '' GROUP BY 1) SELECT s.name, d.doc_id, 'version ' || d.source AS version FROM s JOIN t USING (digest) JOIN d USING (digest) WHERE d.source IS NOT NULL")
def stored_content_join(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of parsed contents with the files that hold them and their versions, joined bucket by bucket."""
    s = _stored(spark, sf)
    versions = table(spark, sf, "documents").select(F.col("source").alias("cvid")).where("cvid IS NOT NULL").distinct().withColumn("version", F.concat(F.lit("version "), "cvid"))
    return ST.defined_in(s["symbols"], s["trees"], s["files"], versions).select("name", "doc_id", "version")


@query(f"{STORED} SELECT digest, count(*) AS n_files FROM d WHERE digest NOT IN (SELECT digest FROM t) GROUP BY 1")
def stored_unparsed(spark: SparkSession, sf: str) -> DataFrame:
    """Contents without a tree, told bucket by bucket."""
    s = _stored(spark, sf)
    return ST.unparsed(s["contents"], s["trees"])


@query("""SELECT p_partkey AS digest, 'p.list' AS path, '[]' AS name, 'added' AS change_type, NULL AS old_value, 'first' AS new_value, NULL AS old_pos, 0 AS new_pos FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'p.list', '[]', 'removed', 'b', NULL, 1, NULL FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'p.list', '[]', 'modified', p_size::VARCHAR, 'z' || p_size, 3, 3 + (p_size % 2 = 0)::INT - (p_size % 3 = 0)::INT FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT p_partkey, 'p', 'mod', 'added', NULL, 'one', NULL, 0 FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'p', 'x', 'modified', '1', '2', 2, 2 + (p_size % 7 = 0)::INT FROM part WHERE p_size % 11 = 0""")
def list_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of every part's lists and repeated keys, aligned: an insertion shifts nothing."""
    rows = table(spark, sf, "part")
    old = rows.selectExpr("p_partkey AS digest", "concat('p = { mod = a mod = b x = 1 list = { a b c ', p_size, ' a } }') AS text")
    new = rows.selectExpr("p_partkey AS digest", "concat('p = { ', if(p_size % 7 = 0, 'mod = one ', ''), 'mod = a mod = b x = ', if(p_size % 11 = 0, 2, 1), ' list = { ', if(p_size % 2 = 0, 'first ', ''), 'a ', if(p_size % 3 = 0, '', 'b '), 'c ', if(p_size % 5 = 0, 'z', ''), p_size, ' a } }') AS text")
    found = list_changes(script.nodes(old), script.nodes(new))
    return found.withColumns({c: F.col(c).cast("int") for c in ("old_pos", "new_pos")})


@query("""WITH s AS (SELECT 'file_' || p_partkey % 64 AS digest, p_partkey AS k, p_size AS z, row_number() OVER (PARTITION BY p_partkey % 64 ORDER BY p_partkey) - 1 AS i FROM part),
  c AS (SELECT *, sum(6 + z % 3) OVER (PARTITION BY digest ORDER BY i) - (6 + z % 3) AS before FROM s)
  SELECT digest, 'p_' || k AS path, 2 * i AS pos, 2 * i + 1 AS line, before + 1 AS node_id FROM c UNION ALL SELECT digest, 'r' || CASE WHEN i > 0 THEN '[' || i || ']' ELSE '' END, 2 * i + 1, 2 * i + 2, before + 6 + z % 3 FROM c""")
def long_script(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level nodes of long files, each parsed in pieces: places, lines, ids and numbers of repeated keys go on from
    piece to piece."""
    files = _files(table(spark, sf, "part"), "p_partkey", F.expr("concat('p_', p_partkey, ' = { a = \"} {\" list = { 1 2', repeat(' 3', p_size % 3), ' } } # {\\nr = ', p_size)"))
    tree = long_nodes(files, size=300)
    top = tree.where("depth = 0")
    return top.select("digest", "path", *[F.col(c).cast("long").alias(c) for c in ("pos", "line", "node_id")])
