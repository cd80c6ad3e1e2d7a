"""Registered queries over resolution, conflicts, search, status and sources, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import conflicts as C
from palimpsest.operators import resolve as R
from palimpsest.operators import search as S
from palimpsest.operators import stats as T
from palimpsest.plans.queries import DEFS, DOWN, EXPECTED, PATH_SQL, TIES, UP, _defs
from palimpsest.plans.registry import query
from palimpsest.session import table
from palimpsest.sources import files as P
from palimpsest.sources import logs as G
from palimpsest.sources import script

FOLDER = "['common/decisions', 'common/on_action', 'common/defines', 'gui'][name % 4 + 1]"


@query(f"{DEFS}, s AS (SELECT *, rank() OVER (PARTITION BY file ORDER BY load_order DESC) AS q FROM def), w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {UP}) AS r, count(*) OVER (PARTITION BY name) - 1 AS n FROM s WHERE q = 1) SELECT name, load_order, file, line, n::BIGINT AS overridden_count FROM w WHERE r = 1")
def resolve_fios_files(spark: SparkSession, sf: str) -> DataFrame:
    """First definitions among the files that survive: a later file of the same path replaces an earlier one."""
    return R.first_wins(_defs(spark, sf), ["name"], ["file"], "load_order", TIES).select("name", "load_order", "file", "line", "overridden_count")


ALL = f"""{DEFS}, f AS (SELECT *, {FOLDER} AS folder FROM def), t AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY {UP}) AS up, row_number() OVER (PARTITION BY folder, name ORDER BY {DOWN}) AS down, count(*) OVER (PARTITION BY folder, name) - 1 AS n FROM f),
  w AS (SELECT * FROM t WHERE CASE WHEN folder = 'gui' THEN up ELSE down END = 1)"""


def _state(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.expr("element_at(array('common/decisions', 'common/on_action', 'common/defines', 'gui'), int(name % 4 + 1))")
    return R.resolved(_defs(spark, sf).withColumn("folder", folder), "name", "folder", ["load_order", *TIES])


@query(f"{ALL} SELECT folder, name, CASE folder WHEN 'gui' THEN 'fios' WHEN 'common/on_action' THEN 'container_merge' WHEN 'common/defines' THEN 'per_key_override' ELSE 'override' END AS policy, load_order, file, line, n::BIGINT AS overridden_count FROM w")
def resolve_all_folders(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).select("folder", "name", "policy", "load_order", "file", "line", "overridden_count")


@query(f"{ALL} SELECT folder, count(*) AS n_names, count(*) FILTER (n > 0) AS n_conflicts, sum(n)::BIGINT AS n_hidden, count(DISTINCT load_order) AS n_sources FROM w GROUP BY folder")
def state_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.state_totals(_state(spark, sf), "folder", "load_order")


@query(f"{DEFS} SELECT load_order, file, line, price, row_number() OVER (ORDER BY {DOWN}) = 1 AS is_winner FROM def WHERE name = 7")
def key_trace(spark: SparkSession, sf: str) -> DataFrame:
    return R.trace(_defs(spark, sf), "name", 7, ["load_order", *TIES]).select("load_order", "file", "line", "price", "is_winner")


@query("""WITH a AS (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS av, b.v AS bv, a.k IS NOT NULL AS ina, b.k IS NOT NULL AS inb FROM a FULL JOIN b ON a.k = b.k)
  SELECT s AS strategy, k, CASE WHEN ina AND (s = 'ours' OR NOT inb) THEN av ELSE bv END AS v, CASE WHEN ina AND (s = 'ours' OR NOT inb) THEN 'ours' ELSE 'theirs' END AS side, ina AND inb AND av IS DISTINCT FROM bv AS conflict FROM j, (SELECT unnest(['ours', 'theirs', 'latest']) AS s)""")
def merge_strategies(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda s: table(spark, sf, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    made = [R.merge_two(side("F"), side("O"), ["k"], "v", s).withColumn("strategy", F.lit(s)) for s in ("ours", "theirs", "latest")]
    return made[0].unionByName(made[1]).unionByName(made[2])


# --- conflicts ---------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT 'd/' || CASE WHEN l_orderkey % 5 = 0 THEN 'ZZZ_' ELSE '' END || l_orderkey || '.txt' AS relpath, l_suppkey AS load_order FROM lineitem)
  SELECT relpath, count(DISTINCT load_order) AS n_sources, count(*) AS n_files, 's' || max(load_order) AS winner, contains(relpath, 'ZZZ_') AS is_last_by_name FROM f GROUP BY relpath HAVING count(DISTINCT load_order) > 1""")
def file_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").selectExpr("concat('d/', if(l_orderkey % 5 = 0, 'ZZZ_', ''), l_orderkey, '.txt') AS relpath", "l_suppkey AS load_order", "concat('s', l_suppkey) AS source")
    return C.file_conflicts(files)


@query(f"SELECT folder, count(*) AS n FROM (SELECT array_to_string(string_split({PATH_SQL}, '/')[1:least(2, len(string_split({PATH_SQL}, '/')) - 1)], '/') AS folder FROM part) GROUP BY folder ORDER BY n DESC, folder LIMIT 5")
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.folder_counts(table(spark, sf, "part").selectExpr(f"{PATH_SQL} AS relpath"), top=5)


@query(f"""{DEFS}, d AS (SELECT name, load_order, CASE WHEN load_order % 10 = 3 THEN 'Big Compatch ' ELSE 'Mod ' END || load_order AS source, policy FROM def JOIN part ON name = p_partkey JOIN {EXPECTED} ON p_size % 12 = folder)
  SELECT name, count(DISTINCT load_order) AS n_sources, any_value(policy) AS policy, CASE WHEN any_value(policy) = 'fios' THEN min(load_order) ELSE max(load_order) END AS winner, bool_or(load_order % 10 = 3) AS has_patch FROM d GROUP BY name HAVING count(DISTINCT load_order) > 1 AND NOT bool_or(load_order % 10 = 3)""")
def conflicts_by_policy(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "part").selectExpr("p_partkey AS name", f"{PATH_SQL} AS relpath")
    defs = _defs(spark, sf).select("name", "load_order", F.expr("concat(if(load_order % 10 = 3, 'Big Compatch ', 'Mod '), load_order)").alias("mod")).join(paths, "name").withColumn("cvid", F.col("load_order"))
    return C.conflicts_by_policy(defs, ["name"], "cvid", "load_order", "relpath", "mod")


@query("SELECT l_orderkey, l_partkey, count(o_orderkey) AS n_files, any_value(o_custkey) AS cust FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' GROUP BY ALL")
def left_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """References with what is known of their file, if anything."""
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    known = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS l_orderkey", "o_orderkey", "o_custkey")
    return C.enriched(refs, known, ["l_orderkey"]).groupBy("l_orderkey", "l_partkey").agg(F.count("o_orderkey").alias("n_files"), F.max("o_custkey").alias("cust"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY n_chars, doc_id LIMIT 40")
def small_first_work(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that no parse of the current kind covers, the smallest first."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return C.without(docs, table(spark, sf, "labels").where("quality = 1"), ["doc_id"]).orderBy("n_chars", "doc_id").limit(40)


@query("SELECT l_partkey AS name FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT s_suppkey + 1000000 FROM supplier")
def union_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """All names that any of several tables knows, each once."""
    t = lambda n, c: table(spark, sf, n).selectExpr(f"{c} AS name")
    return C.all_names(t("lineitem", "l_partkey"), t("part", "p_partkey"), t("supplier", "s_suppkey + 1000000"))


# --- search ------------------------------------------------------------------------------------------

TERMS = """t AS (SELECT doc_id, source, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), l AS (SELECT *, len(t) AS len, len(list_filter(t, lambda x: x = '{0}')) AS f FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f > 0) AS d FROM l), b AS (SELECT l.*, ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM l, s WHERE f > 0)"""


@query(f"WITH {TERMS.format('license')} SELECT source, round(max(score), 6) AS score FROM b GROUP BY source ORDER BY 2 DESC, source LIMIT 10")
def ranked_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """The best document of each path, with the text around its first hit."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = S.ranked(docs, "doc_id", "text", "source", "license", top=10)
    return found.where(F.lower("snippet").contains("license")).select("source", F.round("score", 6).alias("score"))


@query(f"WITH {TERMS.format('license')}, c AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part), cl AS (SELECT *, len(t) AS len, len(list_filter(t, lambda x: x = 'bolt')) AS f FROM c), cs AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f > 0) AS d FROM cl) SELECT scope, key, round(score, 6) AS score FROM (SELECT 'content' AS scope, doc_id::VARCHAR AS key, score FROM b UNION ALL SELECT 'symbols', p_partkey::VARCHAR, ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) FROM cl, cs WHERE f > 0) ORDER BY round(score, 6) DESC, scope, key LIMIT 25")
def merged_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rounded = lambda df: df.withColumn("score", F.round("score", 6))
    content = rounded(S.bm25(docs, "doc_id", "text", "license")).withColumnRenamed("doc_id", "key")
    names = rounded(S.bm25(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "bolt")).withColumnRenamed("p_partkey", "key")
    return S.merged_scopes({"content": content, "symbols": names}, "key", top=25)


@query("SELECT page_id, n FROM (SELECT page_id, len(list_filter(string_split(html, '<'), lambda x: regexp_matches(x, '(?i)^a\\s+href'))) AS n FROM pages WHERE url ILIKE '%example.org%') WHERE n > 0")
def raw_grep(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("file"), F.explode(F.split("html", "<")).alias("text"))
    return S.grep_raw(pages, r"^a\s+href", True, pattern="%example.org%").groupBy("page_id").agg(F.count("*").cast("long").alias("n"))


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 4') AND list_contains(string_split(event_type, '_'), 'error')")
def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of an index by a tag and a text."""
    rows = table(spark, sf, "events").withColumn("tags", F.split("event_type", "_"))
    return S.with_tags(rows, "tags", ["error"], "props", '"K": 4').select("event_id")


# --- status ------------------------------------------------------------------------------------------


@query("""SELECT 'ast' AS stage, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_done, round(100.0 * count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) / count(*)::DOUBLE, 1) AS pct FROM documents
  UNION ALL SELECT 'symbols', count(*), count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')), round(100.0 * count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) / count(*)::DOUBLE, 1) FROM orders UNION ALL SELECT 'none', 0, 0, 100.0""")
def build_status(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    keys = t("orders").selectExpr("o_orderkey AS k")
    return T.build_status({"ast": (t("documents"), t("labels"), ["doc_id"]), "symbols": (keys, t("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS k"), ["k"]), "none": (keys.where("false"), keys, ["k"])})


@query("SELECT 1 AS priority, 'cleanup' AS phase, 'purge_deleted' AS action, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 5, 'cleanup', 'remove_orphans', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def recommended_actions(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.operators.tables import orphan_counts, row_counts

    t = lambda n: table(spark, sf, n)
    counts = row_counts({"deleted": t("orders").where("o_orderstatus = 'F'"), "pending": t("orders").where("false")})
    counts = counts.unionByName(orphan_counts({"asts": (t("orders").selectExpr("o_orderkey AS k"), t("lineitem").selectExpr("l_orderkey AS k"), ["k"]), "contents": (t("documents").selectExpr("doc_id AS k"), t("labels").selectExpr("doc_id AS k"), ["k"])}))
    return T.recommended(counts, [("deleted", 1, "cleanup", "purge_deleted"), ("pending", 2, "ast", "generate_ast"), ("asts", 5, "cleanup", "remove_orphans"), ("contents", 5, "cleanup", "remove_orphans")])


STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'error' ELSE 'done' END"


@query(f"SELECT count(*) AS n, count(*) FILTER (s = 'pending') AS n_pending, count(*) FILTER (s = 'processing') AS n_processing, count(*) FILTER (s = 'processing' AND date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-02 00:00:00') > 300) AS n_stale, count(*) FILTER (s = 'error') AS n_error FROM (SELECT *, {STATUS} AS s FROM events)")
def queue_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("status", F.expr(STATUS))
    return T.health(rows, "status", "ts", F.lit("2024-01-02 00:00:00").cast("timestamp"))


@query("WITH f AS (SELECT source, sha256(coalesce(text, '')) AS d, n_chars FROM documents), c AS (SELECT d, max(n_chars) AS n FROM f GROUP BY d) SELECT source, count(*) AS n_files, count(DISTINCT f.d) AS n_contents, (SELECT coalesce(sum(n), 0) FROM c WHERE d IN (SELECT d FROM f g WHERE g.source IS NOT DISTINCT FROM f.source))::BIGINT AS n_bytes FROM f GROUP BY source")
def version_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars")
    return T.version_stats(files, files.groupBy("digest").agg(F.max("n_chars").alias("size")), "source", "digest", "size")


@query("SELECT count(*) AS n_contents, count(*) FILTER (p_size % 3 > 0) AS n_ok, count(*) FILTER (p_size % 3 = 0) AS n_failed, sum(CASE WHEN p_size % 3 = 0 THEN 4 ELSE 3 END)::BIGINT AS n_nodes FROM part")
def parse_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that parse and that do not; a stray brace is a node of its own."""
    rows = table(spark, sf, "part").selectExpr("p_partkey AS digest", "concat('p = { a = ', p_size, ' }', if(p_size % 3 = 0, ' }', '')) AS text")
    return T.tree_stats(rows, script.nodes(rows))


@query("SELECT p_partkey AS digest, 4 + p_size % 3 AS n_nodes, 'p.list.[]' AS first_value FROM part")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Node tables written as JSON and read back."""
    rows = table(spark, sf, "part").selectExpr("p_partkey AS digest", "concat('p = { list = { 1', repeat(' 2', p_size % 3), ' } }') AS text")
    back = script.from_json(script.as_json(script.nodes(rows)))
    return back.groupBy("digest").agg(F.count("*").cast("int").alias("n_nodes"), F.min(F.when(F.col("node_type") == "value", F.col("path"))).alias("first_value"))


@query("SELECT p_partkey AS digest, 'p = {' || chr(10) || '  x' || chr(10) || '  alpha = ' || p_size || chr(10) || '  beta = \"' || p_name || '\"' || chr(10) || '  inner = {' || chr(10) || '    a = 1' || chr(10) || '    b = 2' || chr(10) || '  }' || chr(10) || '}' || chr(10) || chr(10) || 'q = 1' AS text FROM part")
def formatted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts laid out anew: keys sorted, two spaces, a blank line between entries."""
    rows = table(spark, sf, "part").selectExpr("p_partkey AS digest", """concat('p={ inner={ b=2 a=1 } beta = "', p_name, '" x alpha = ', p_size, ' } q=1') AS text""")
    return script.printed(script.nodes(rows), indent="  ", sort_keys=True, blank_lines=True)


@query("SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN 'On Actions' WHEN 11 THEN 'Traditions' WHEN 1 THEN 'Events' WHEN 2 THEN 'Common' WHEN 3 THEN 'Common' WHEN 4 THEN 'Common' WHEN 7 THEN 'Common' WHEN 8 THEN 'Common' END AS type, lower(CASE WHEN p_size % 7 = 2 THEN CASE WHEN p_size % 12 = 6 THEN 'localization' ELSE 'skip' END WHEN p_size % 7 IN (4, 6) OR p_size % 12 IN (5, 6, 9) THEN 'skip' WHEN p_size % 12 = 10 THEN 'lookups' ELSE 'script' END) AS file_type FROM part")
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    registry = {"common": "Common", "common/on_action": "On Actions", "common/culture/traditions": "Traditions", "events": "Events"}
    p = F.expr(PATH_SQL)
    return table(spark, sf, "part").select("p_partkey", P.content_type(p, registry).alias("type"), rules.file_type(p).alias("file_type"))


@query(f"SELECT p_partkey, {PATH_SQL} AS relpath FROM part WHERE p_size % 12 = 3 AND p_size % 7 IN (0, 1, 3) AND p_partkey % 5 <> 0")
def folder_files(spark: SparkSession, sf: str) -> DataFrame:
    """Live script files directly in a folder."""
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{PATH_SQL} AS relpath", "1 AS cvid", "p_partkey % 5 = 0 AS deleted", "'s' AS source")
    deeper = rows.withColumn("relpath", F.concat(F.lit("common/decisions/deeper/"), F.col("p_partkey").cast("string"), F.lit(".txt")))
    return P.folder_sources(P.files_of(rows.unionByName(deeper), 1), "common/decisions").select("p_partkey", "relpath")


@query("SELECT event_id AS record, CASE WHEN event_id % 4 = 0 THEN '11' WHEN event_id % 4 = 1 THEN '12' WHEN event_id % 4 = 2 THEN '99' END AS mod_id, CASE WHEN event_id % 4 = 0 THEN 'More Bolts' WHEN event_id % 4 = 1 THEN 'More Bolts Extra' WHEN event_id % 4 = 2 THEN 'Mod 99' END AS mod_name FROM events")
def mods_of_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their mod, by id or by its name in the path; the longest name that fits counts."""
    path = F.expr("CASE event_id % 4 WHEN 0 THEN 'mod/ugc_11.mod' WHEN 1 THEN 'gui/More_Bolts_Extra_x.gui' WHEN 2 THEN 'mod/ugc_99.mod' ELSE 'events/none.txt' END")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record"), path.alias("script_file"), F.expr("CASE event_id % 4 WHEN 0 THEN '11' WHEN 2 THEN '99' END").alias("mod_id"))
    mods = spark.createDataFrame([("11", "More Bolts"), ("12", "More Bolts Extra")], "mod_id string, name string")
    return G.with_mod(rows, mods).select("record", "mod_id", "mod_name")


@query("SELECT event_id AS record, CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'click' THEN 3 ELSE 4 END AS priority FROM events WHERE event_type IN ('error', 'click') AND event_id % 3 <> 0 ORDER BY 2, (event_id % 5 = 0) DESC, event_id LIMIT 30")
def actionable_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr("event_id AS record", "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 3 ELSE 4 END AS priority", "event_id % 3 = 0 AS is_child", "event_id % 5 = 0 AS is_root")
    return G.actionable(rows, top=30).select("record", "priority")
