"""Registered queries over stored tables: units of conflict and the report, names, changes to tables, logs, files.

``lineitem`` stands for definitions and files (source = supplier, file = order), ``part`` for names and their paths,
``events`` for log records; the texts of logs and localization are written from such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import names as N
from palimpsest.operators import stats as T
from palimpsest.operators import tables as B
from palimpsest.operators import units as U
from palimpsest.plans.queries import DEFS, EXPECTED, PATH_SQL
from palimpsest.plans.registry import query
from palimpsest.session import shared_folder, table
from palimpsest.sources import files as S
from palimpsest.sources import logs as G

# --- units of conflict -------------------------------------------------------------------------------


def _contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Every definition of a part by a supplier, the parts' kinds dealt over folders; the name is shared by four parts."""
    paths = table(spark, sf, "part").selectExpr("p_partkey", f"{PATH_SQL} AS relpath")
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey AS p_partkey", "l_suppkey AS cvid", "l_orderkey AS file_id", "l_linenumber AS node_id", "md5(cast(cast(l_quantity AS int) AS string)) AS node_hash")
    found = rows.join(paths, "p_partkey").selectExpr("concat('n', p_partkey div 4) AS name", "relpath", "cvid", "file_id", "node_id", "node_hash", "cvid AS load_order", "concat('s', cvid) AS source")
    return U.contributions(found)


CONTRIBS = f"""{DEFS}, c AS (SELECT 'n' || (name // 4) AS name, {PATH_SQL} AS relpath, load_order AS cvid, file AS file_id, line AS node_id, md5(qty::INT::VARCHAR) AS node_hash, load_order, 's' || load_order AS source, r.*,
  CASE policy WHEN 'container_merge' THEN 'append' WHEN 'per_key_override' THEN 'merge_by_id' ELSE 'replace' END AS merge_behavior,
  CASE domain WHEN 'localization' THEN 'loc' ELSE domain END || ':n' || (name // 4) AS unit_key FROM def JOIN part ON name = p_partkey JOIN {EXPECTED} ON p_size % 12 = folder)"""


@query(f"{CONTRIBS} SELECT file_id, node_id, cvid, unit_key, domain, merge_behavior, substr(sha256(cvid || ':' || file_id || ':' || node_id), 1, 16) AS contrib_id, count(*) AS n FROM c GROUP BY ALL")
def unit_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return _contributions(spark, sf).groupBy("file_id", "node_id", "cvid", "unit_key", "domain", "merge_behavior", "contrib_id").agg(F.count("*").alias("n"))


UNITS = f"""{CONTRIBS}, e AS (SELECT unit_key, domain, merge_behavior, any_value(unit_weight) AS w, load_order, source, min(node_hash) AS h1, max(node_hash) AS h2 FROM c GROUP BY unit_key, domain, merge_behavior, load_order, source),
  g AS (SELECT unit_key, domain, merge_behavior, any_value(w) AS w, count(*) AS n, max(load_order) AS top, min(load_order) AS base, min(h1) <> max(h2) AS differ FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  u AS (SELECT *, substr(sha256(unit_key), 1, 16) AS conflict_id, least(100, w + greatest(n - 2, 0) * 10 + CASE WHEN base = 0 THEN 5 ELSE 0 END)::BIGINT AS risk_score,
  CASE WHEN domain = 'on_action' THEN 'medium' WHEN differ THEN 'medium' ELSE 'low' END AS uncertainty FROM g),
  v AS (SELECT *, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN merge_behavior = 'replace' THEN 'winner_only' ELSE 'guided_merge' END AS merge_capability FROM u)"""


@query(f"{UNITS} SELECT conflict_id, unit_key, domain, n AS candidate_count, merge_capability, risk_score, risk, uncertainty, top AS winner_order FROM v")
def unit_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = U.conflict_units(_contributions(spark, sf), base_order=0)
    return found.select("conflict_id", "unit_key", "domain", "candidate_count", "merge_capability", "risk_score", "risk", "uncertainty", "winner_order")


@query(f"{UNITS} SELECT unit_key, domain, n AS candidate_count, risk_score, risk FROM v WHERE risk = 'high' AND domain <> 'gui' AND domain = 'event' ORDER BY risk_score DESC, unit_key LIMIT 20 OFFSET 5")
def unit_list(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the riskiest units of one domain."""
    return U.listed(U.conflict_units(_contributions(spark, sf), base_order=0), risk="high", domain="event", offset=5, limit=20).select("unit_key", "domain", "candidate_count", "risk_score", "risk")


@query(f"{UNITS} SELECT v.unit_key, c.cvid, c.file_id, c.node_id, c.load_order = v.top AS is_winner, count(*) AS n FROM v JOIN c ON v.unit_key = c.unit_key GROUP BY ALL")
def unit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _contributions(spark, sf)
    return U.candidates(rows, U.conflict_units(rows, base_order=0)).groupBy("unit_key", "cvid", "file_id", "node_id", "is_winner").agg(F.count("*").alias("n"))


@query(f"""{UNITS}, d AS (SELECT v.*, CASE WHEN domain = 'event' THEN 'resolved' WHEN domain = 'gui' THEN 'deferred' ELSE 'unresolved' END AS status FROM v)
  SELECT 'risk' AS what, risk AS value, count(*) AS n FROM d GROUP BY risk UNION ALL SELECT 'domain', domain, count(*) FROM d GROUP BY domain UNION ALL SELECT 'status', status, count(*) FROM d GROUP BY status UNION ALL SELECT 'all', NULL, count(*) FROM d""")
def unit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Units by risk, domain and the state of their latest resolution."""
    path = shared_folder(spark, "units")  # read three times, made once
    U.conflict_units(_contributions(spark, sf), base_order=0).select("conflict_id", "domain", "risk").write.parquet(path)
    units = spark.read.parquet(path)
    first = units.where("domain IN ('event', 'gui')").select("conflict_id", F.lit("deferred").alias("status"), F.lit(1).alias("decided_at"))
    later = units.where("domain = 'event'").select("conflict_id", F.lit("resolved").alias("status"), F.lit(2).alias("decided_at"))
    return U.histogram(U.with_resolutions(units, first.unionByName(later)))


def _report_files(spark: SparkSession, sf: str) -> DataFrame:
    return _contributions(spark, sf).groupBy("relpath", "source", "load_order").agg(F.count("*").alias("size"))


REPORT = f"""{CONTRIBS}, i1 AS (SELECT unit_key, report_domain, load_order, any_value(report_weight) AS w FROM c GROUP BY unit_key, report_domain, load_order),
  i AS (SELECT unit_key, report_domain, any_value(w) AS w, count(*) AS candidates, max(load_order) AS top FROM i1 GROUP BY 1, 2 HAVING count(*) >= 2),
  f1 AS (SELECT relpath, load_order, any_value(report_domain) AS report_domain, any_value(report_weight) AS w, count(*) AS size, string_agg(DISTINCT unit_key, '|') AS u FROM c GROUP BY 1, 2),
  inner_ AS (SELECT relpath, count(DISTINCT unit_key) AS k FROM c WHERE unit_key IN (SELECT unit_key FROM i) GROUP BY relpath),
  f AS (SELECT relpath, any_value(report_domain) AS domain, any_value(w) AS w, count(*) AS candidates, max(load_order) AS top, (max(size) - min(size)) / max(size) AS delta FROM f1 GROUP BY relpath HAVING count(*) >= 2),
  fs AS (SELECT f.*, coalesce(k, 0) AS inner_conflicts, least(100, w + greatest(candidates - 2, 0) * 10 + CASE WHEN delta > 0.5 THEN 10 ELSE 0 END + CASE WHEN coalesce(k, 0) > 5 THEN 10 WHEN coalesce(k, 0) > 0 THEN 5 ELSE 0 END)::BIGINT AS score FROM f LEFT JOIN inner_ USING (relpath)),
  ids AS (SELECT *, least(100, w + greatest(candidates - 2, 0) * 15 + CASE WHEN report_domain = 'on_action' THEN 10 ELSE 0 END)::BIGINT AS score FROM i)"""


@query(f"""{REPORT} SELECT relpath, domain, candidates, 's' || (SELECT max(load_order) FROM c WHERE c.relpath = fs.relpath) AS winner, round(delta, 6) AS size_delta, inner_conflicts, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level,
  concat_ws('; ', CASE WHEN domain IN ('on_action', 'events', 'gui') THEN 'hotspot_domain' END, CASE WHEN candidates > 2 THEN candidates || '_candidates' END, CASE WHEN delta > 0.5 THEN 'large_size_delta' END, CASE WHEN inner_conflicts > 5 THEN 'many_id_conflicts_inside' WHEN inner_conflicts > 0 THEN 'has_id_conflicts' END) AS reasons
  FROM fs WHERE domain NOT IN ('gfx') AND score >= 30""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = U.report(_report_files(spark, sf), _contributions(spark, sf), exclude=["gfx"], least_score=30)
    return found.drop("file_type")


@query(f"""{REPORT} SELECT unit_key, report_domain AS domain, candidates, 's' || top AS winner, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN report_domain IN ('localization', 'defines') THEN 'none' WHEN report_domain IN ('events', 'scripted_effect', 'decisions') THEN 'low' ELSE 'medium' END AS uncertain FROM ids""")
def report_units(spark: SparkSession, sf: str) -> DataFrame:
    _, found = U.report(_report_files(spark, sf), _contributions(spark, sf))
    return found.drop("container")


@query(f"""{REPORT} SELECT (SELECT count(*) FROM fs) AS file_conflicts, (SELECT count(*) FROM fs WHERE score >= 60) AS high_risk_files, (SELECT count(*) FROM ids) AS id_conflicts, (SELECT count(*) FROM ids WHERE score >= 60) AS high_risk_ids,
  (SELECT count(*) FROM ids WHERE report_domain NOT IN ('localization', 'defines')) AS uncertain_ids""")
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return U.report_summary(*U.report(_report_files(spark, sf), _contributions(spark, sf)))


# --- names -------------------------------------------------------------------------------------------


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("replace(p_name, ' ', '_') AS name", "p_type AS symbol_type", "p_size AS cvid", "p_partkey AS symbol_id")


@query("SELECT p_partkey AS symbol_id, p_type AS symbol_type, p_size AS cvid FROM part WHERE p_name = 'cold widget' AND p_type = 'ECONOMY' AND p_size % 2 = 0")
def find_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return N.definitions(_symbols(spark, sf), "cold_widget", "ECONOMY", list(range(0, 100, 2))).select("symbol_id", "symbol_type", "cvid")


@query("""WITH s AS (SELECT replace(p_name, ' ', '_') AS name FROM part), q AS (SELECT unnest(['cold_widget', 'cold_thing', 'zzz_none']) AS query),
  h AS (SELECT query, name, count(*) AS n FROM q, s WHERE name = query OR (query = 'cold_widget' AND (name LIKE 'cold%' OR name LIKE '%widget' OR name LIKE '%cold%widget%')) OR (query = 'cold_thing' AND (name LIKE 'cold%' OR name LIKE '%thing')) GROUP BY 1, 2)
  SELECT query, coalesce(sum(n) FILTER (name = query), 0)::BIGINT AS n_exact, count(name) FILTER (name <> query) AS n_similar, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name <> query), '') AS similar, count(name) = 0 AS absent FROM q LEFT JOIN h USING (query) GROUP BY query""")
def confirm_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Whether names may be said not to exist: one that does, one with names like it, one with none."""
    return N.confirm_absent(_symbols(spark, sf), ["cold_widget", "cold_thing", "zzz_none"], similar=1000)


@query("SELECT o_orderkey AS ref, (p_partkey IS NOT NULL AND o_orderkey % 2 = 0)::BIGINT AS n_definitions, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'other_kind' END AS status FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2")
def validate_references(spark: SparkSession, sf: str) -> DataFrame:
    """References to parts by their true kind, by one that no part has, and to parts that do not exist."""
    symbols = table(spark, sf, "part").selectExpr("cast(p_partkey AS string) AS name", "p_type AS symbol_type")
    kinds = table(spark, sf, "part").selectExpr("p_partkey", "p_type")
    refs = table(spark, sf, "orders").selectExpr("o_orderkey AS ref", "o_custkey * 2 AS p_partkey").join(kinds, "p_partkey", "left")
    told = refs.selectExpr("ref", "cast(p_partkey AS string) AS name", "if(ref % 2 = 0, coalesce(p_type, 'SMALL'), 'no such kind') AS ref_type")
    return N.validated(told, symbols).select("ref", "n_definitions", "status")


@query("SELECT l_suppkey AS cvid, count(DISTINCT l_partkey) AS n_names, count(*) AS n_rows, min(l_partkey) AS first_name, max(l_partkey) AS last_name FROM lineitem GROUP BY 1")
def names_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return N.by_source(table(spark, sf, "lineitem").selectExpr("l_suppkey AS cvid", "l_partkey AS name"), "cvid")


@query("SELECT l_suppkey AS cvid, p_type AS symbol_type, count(DISTINCT l_partkey) AS n_names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def kinds_touched(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").selectExpr("p_partkey AS name", "p_type AS symbol_type")
    return N.kinds_touched(table(spark, sf, "lineitem").selectExpr("l_suppkey AS cvid", "l_partkey AS name").join(kinds, "name"), "cvid")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS name FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name = 'cold widget')")
def references_to_found(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "part").where("p_name = 'cold widget'").selectExpr("p_partkey AS name")
    return N.references_to(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS name"), found)


@query("""SELECT p_partkey, CASE WHEN p_partkey::VARCHAR = 'CW' THEN 'id' WHEN lower(p_name) LIKE '%cw%' THEN 'contains' ELSE 'abbreviation' END AS match_type FROM part WHERE lower(p_name) LIKE '%cw%' OR regexp_matches(upper(p_name), '^C.*W')
  UNION ALL SELECT p_partkey, 'words' FROM part WHERE p_name LIKE '%cold%bolt%' UNION ALL SELECT p_partkey, 'id' FROM part WHERE p_partkey = 7""")
def mod_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by abbreviation, by words, by id."""
    mods = table(spark, sf, "part").selectExpr("p_partkey", "upper(p_name) AS name", "cast(p_partkey AS string) AS workshop_id")
    found = [N.mod_search(mods, "CW"), N.mod_search(mods.withColumn("name", F.lower("name")), "cold  bolt"), N.mod_search(mods, "7")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("p_partkey", "match_type")


@query("SELECT p_partkey, (CASE WHEN p_name LIKE 'cold %' THEN 1 ELSE 0 END + CASE WHEN p_name LIKE '% bol%' THEN 1 ELSE 0 END)::INT AS n_terms FROM part WHERE p_name LIKE 'cold %' OR p_name LIKE '% bol%'")
def prefix_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Names with words that begin like the query's."""
    return N.fts(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 'cold "bol"', prefix=True).select("p_partkey", "n_terms")


# --- changes to tables -------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS side FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0)
  SELECT 'replace' AS mode, k, arg_max(v, (side, v)) AS v FROM o GROUP BY k UNION ALL SELECT 'ignore', k, arg_min(v, (side, v)) FROM o GROUP BY k""")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS k", "o_orderkey AS v")
    old, new = rows.where("v % 2 = 0"), rows.where("v % 3 = 0")
    made = [B.upsert(old, new, ["k"], ["v"], mode).withColumn("mode", F.lit(mode)) for mode in ("replace", "ignore")]
    return made[0].unionByName(made[1])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0) GROUP BY 1")
def purge_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Line items left when customers go, and with them their orders."""
    custs, orders, items = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c_custkey"), table(spark, sf, "lineitem").select("l_orderkey")
    left = B.purged({"customer": (custs, None, []), "orders": (orders, "customer", ["c_custkey"]), "lineitem": (items, "orders", ["l_orderkey"])}, "customer", custs.where("c_custkey % 2 = 0"))
    return left["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)")
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Files that live on after two kinds of deletion."""
    files = table(spark, sf, "orders").selectExpr("o_orderkey", "int(o_orderstatus = 'F') AS deleted")
    gone = table(spark, sf, "lineitem").where("l_suppkey = 1").selectExpr("l_orderkey AS o_orderkey")
    return B.live(B.tombstoned(files, gone, ["o_orderkey"])).select("o_orderkey")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return B.orphan_counts({"orders": (t("orders").selectExpr("o_orderkey AS k"), t("lineitem").selectExpr("l_orderkey AS k"), ["k"]), "documents": (t("documents").selectExpr("doc_id AS k"), t("labels").selectExpr("doc_id AS k"), ["k"])})


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.row_counts({n: table(spark, sf, n) for n in ("part", "orders", "events")})


@query("""SELECT name, workshop_id, source_path, false AS fresh FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey END AS workshop_id, '/mods/' || s_suppkey AS source_path, s_suppkey FROM supplier) WHERE s_suppkey % 3 = 0
  UNION ALL SELECT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey END, '/mods/' || s_suppkey, true FROM supplier WHERE s_suppkey % 3 <> 0""")
def content_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions known and made for roots, some of which come twice or are known by id or by path."""
    roots = table(spark, sf, "supplier").selectExpr("s_name AS name", "concat('/mods/', s_suppkey) AS source_path", "if(s_suppkey % 2 = 0, concat('w', s_suppkey), null) AS workshop_id", "s_suppkey")
    known = roots.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cvid"), "name", "source_path", "workshop_id")
    made = B.versions(roots.unionByName(roots).withColumn("source_path", F.when(F.col("workshop_id").isNull(), F.upper("source_path")).otherwise(F.col("source_path"))).drop("s_suppkey"), known)
    return made.select("name", "workshop_id", F.lower("source_path").alias("source_path"), (F.col("cvid") != F.regexp_extract("source_path", "[0-9]+", 0).cast("long")).alias("fresh"))


@query("SELECT c_custkey AS mod, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT + 100 WHEN c_nationkey % 5 = 0 THEN c_nationkey END::BIGINT AS cvid FROM customer")
def resolve_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each mod's version: the latest of its id, else that of its path."""
    nations = table(spark, sf, "nation")
    by_id = nations.selectExpr("cast(n_nationkey AS bigint) + 100 AS cvid", "concat('w', n_nationkey) AS workshop_id", "'/elsewhere' AS source_path", "2 AS ingested_at")
    older = by_id.withColumns({"cvid": F.col("cvid") + 1000, "ingested_at": F.lit(1)})
    by_path = nations.where("n_nationkey % 5 = 0").selectExpr("cast(n_nationkey AS bigint) AS cvid", "cast(null AS string) AS workshop_id", "concat('/M/', n_nationkey) AS source_path", "1 AS ingested_at")
    mods = table(spark, sf, "customer").selectExpr("c_custkey AS mod", "if(c_custkey % 2 = 0, concat('w', c_nationkey), null) AS workshop_id", "concat('\\\\m\\\\', c_nationkey) AS source_path")
    return B.resolved_versions(mods, by_id.unionByName(older).unionByName(by_path)).select("mod", "cvid")


@query("SELECT l_orderkey AS file, l_suppkey AS cvid, CASE WHEN l_suppkey = 1 THEN -1 ELSE l_suppkey * 10 END AS load_order, count(*) AS n FROM lineitem WHERE l_suppkey = 1 OR l_suppkey % 2 = 0 GROUP BY ALL")
def base_or_enabled(spark: SparkSession, sf: str) -> DataFrame:
    order = table(spark, sf, "supplier").selectExpr("s_suppkey AS cvid", "s_suppkey * 10 AS load_order", "s_suppkey % 2 = 0 AS enabled")
    files = table(spark, sf, "lineitem").selectExpr("l_orderkey AS file", "l_suppkey AS cvid")
    return B.base_or_enabled(files, order, 1).groupBy("file", "cvid", "load_order").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_orderkey AS file_no, l_linenumber AS pos, CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END AS name, max(l_quantity) AS value FROM lineitem WHERE l_orderkey < 300 GROUP BY ALL)
  SELECT arg_min(file_no, (file_no, pos)) AS first_file, arg_min(pos, (file_no, pos)) AS first_pos, name, arg_max(value, (file_no, pos, value)) AS value FROM p WHERE name IS NOT NULL GROUP BY name UNION ALL SELECT file_no, pos, name, value FROM p WHERE name IS NULL""")
def combined_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files merged into one: a later entry in the place of an earlier one of its name."""
    rows = table(spark, sf, "lineitem").where("l_orderkey < 300").selectExpr("l_orderkey AS file_no", "l_linenumber AS pos", "if(l_partkey % 10 <> 0, l_partkey, null) AS name", "l_quantity AS value")
    return B.merged_files(rows.groupBy("file_no", "pos", "name").agg(F.max("value").alias("value")))


# --- routing and files -------------------------------------------------------------------------------


@query(f"""SELECT p_partkey, CASE WHEN p_size % 12 = 10 THEN 'E_LOOKUP_CHARACTERS' WHEN p_size % 12 IN (5, 9) THEN 'E_SKIP' WHEN p_size % 7 IN (0, 1, 3, 5) THEN 'E_SCRIPT' WHEN p_size % 7 = 2 THEN 'E_LOC' ELSE 'E_SKIP' END AS envelope,
  report_domain, CASE WHEN p_size % 7 = 2 OR p_size % 12 = 6 THEN 'localization' WHEN p_size % 7 = 4 THEN 'gfx' WHEN p_size % 7 = 6 THEN 'gui' WHEN p_size % 12 IN (0, 1, 2, 3, 4, 7, 8, 10, 11) THEN 'script' ELSE 'other' END AS file_type,
  CASE WHEN p_size % 12 = 0 AND p_size % 7 IN (0, 1, 3, 5) THEN 'on_actions' WHEN p_size % 12 IN (0, 2, 3, 4, 7, 8, 11) THEN 'common' WHEN p_size % 7 = 6 THEN 'interface' ELSE 'rest' END AS by_prefix FROM part JOIN {EXPECTED} ON p_size % 12 = folder""")
def route_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes by the routing table, report domains and types, and a router of prefixes and extensions."""
    p = F.expr(PATH_SQL)
    router = [("on_actions", ("common/on_action",), (".txt",)), ("common", ("common/",), ()), ("interface", (), (".gui",))]
    return table(spark, sf, "part").select("p_partkey", rules.envelope(p).alias("envelope"), rules.report_domain(p).alias("report_domain"), rules.report_type(p).alias("file_type"), rules.prefix_route(p, router, "rest").alias("by_prefix"))


@query("""SELECT c_custkey AS relpath, 3::BIGINT AS line, 'english' AS language, 'key.' || c_custkey AS loc_key, (c_custkey % 4)::INT AS version, 'Hi [Get' || c_nationkey || '] $NAME$ costs $5 @gold! "' || c_name || '"' AS value, 'Get' || c_nationkey AS scripted, 'NAME' AS variables, 'gold' AS icons FROM customer
  UNION ALL SELECT c_custkey, 4, 'english', 'plain_' || c_custkey, 0, '', '', '', '' FROM customer""")
def localization_entries(spark: SparkSession, sf: str) -> DataFrame:
    text = """concat('# l_french:\\r\\nl_english:\\r\\n key.', c_custkey, ':', c_custkey % 4, ' "Hi [Get', c_nationkey, '] $NAME$ costs $5 @gold! "', c_name, '""\\r\\n plain_', c_custkey, ': ""\\n # k: "x"\\n bad key: "x"\\n .x: "y"\\n k:1"z"\\n k:1 "z" x\\nl_german:') AS text"""
    found = S.localization(table(spark, sf, "customer").selectExpr("c_custkey AS relpath", text))
    return found.select("relpath", "line", "language", "loc_key", "version", "value", *[F.array_join(c, ",").alias(c) for c in ("scripted", "variables", "icons")])


@query("SELECT c_custkey AS relpath, unnest([6, 7, 8])::BIGINT AS line, unnest(['bad key: \"x\"', '.x: \"y\"', 'k:1\"z\"']) AS line_text FROM customer")
def localization_malformed(spark: SparkSession, sf: str) -> DataFrame:
    text = """concat('l_english:\\n a: "b"\\n\\n # k: "x"\\n no colon\\n bad key: "x"\\n .x: "y"\\n k:1"z"') AS text"""
    return S.malformed(table(spark, sf, "customer").selectExpr("c_custkey AS relpath", text))


@query("SELECT ref_type, ref_value, count(*) AS n FROM (SELECT unnest(['scripted', 'variable', 'icon']) AS ref_type, unnest(['n' || c_nationkey, 'N', 'i']) AS ref_value FROM customer) GROUP BY ALL")
def localization_references(spark: SparkSession, sf: str) -> DataFrame:
    text = """concat('l_english:\\n k:0 "[n', c_nationkey, '] $N$ @i!"') AS text"""
    found = S.localization_refs(S.localization(table(spark, sf, "customer").selectExpr("c_custkey AS relpath", text)))
    return found.groupBy("ref_type", "ref_value").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {PATH_SQL} AS relpath FROM part WHERE regexp_matches({PATH_SQL}, '^common/([^/]*/)*[^/]*widget[^/]*[.]txt$')")
def glob_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.glob_files(table(spark, sf, "part").selectExpr("p_partkey", f"{PATH_SQL} AS relpath"), "common/**/*widget*.txt", most=None)


@query("SELECT DISTINCT folder FROM (VALUES (0, 'common/on_action'), (1, 'events'), (2, 'common/scripted_effects'), (3, 'common/decisions'), (4, 'common/defines'), (7, 'common/modifiers'), (8, 'common/landed_titles'), (11, 'common/culture/traditions')) AS f (k, folder) JOIN part ON p_size % 12 = k AND p_size % 7 IN (0, 1, 3)")
def content_folders(spark: SparkSession, sf: str) -> DataFrame:
    return S.content_folders(table(spark, sf, "part").selectExpr(f"{PATH_SQL} AS relpath"))


@query(f"SELECT split_part(substr({PATH_SQL}, 8), '/', 1) AS name, contains(substr({PATH_SQL}, 8), '/') AS is_folder, count(*) AS n FROM part WHERE starts_with({PATH_SQL}, 'common/') GROUP BY ALL")
def folder_children(spark: SparkSession, sf: str) -> DataFrame:
    return T.children(table(spark, sf, "part").selectExpr(f"{PATH_SQL} AS relpath"), "relpath", "common")


@query("SELECT 's' || l_suppkey AS source, sha256(string_agg(path || digest, '' ORDER BY lower(path), path, digest)) AS root_hash, count(*) AS n_files FROM (SELECT l_suppkey, CASE WHEN l_orderkey % 2 = 0 THEN 'B' ELSE 'a' END || l_orderkey || '/' || l_linenumber AS path, md5(l_quantity::INT::VARCHAR) AS digest FROM lineitem) GROUP BY l_suppkey")
def flat_root_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One hash over a source's manifest in order of its paths' lower case."""
    rows = table(spark, sf, "lineitem").selectExpr("concat('s', l_suppkey) AS source", "concat(if(l_orderkey % 2 = 0, 'B', 'a'), l_orderkey, '/', l_linenumber) AS path", "md5(cast(cast(l_quantity AS int) AS string)) AS digest")
    return T.flat_root_hash(rows, "source", "path", "digest")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.counts_by(table(spark, sf, "events"), "event_type")


# --- logs --------------------------------------------------------------------------------------------

LOG = """concat('[', lpad(event_id % 24, 2, '0'), ':10:0', event_id % 10, '][', if(event_type = 'view', 'W', 'E'), '][', if(event_id % 3 = 0, 'jomini_script_system.cpp', 'gui/pdx_gui.cpp'), ':', event_id % 50, ']: ',
  CASE event_id % 4 WHEN 0 THEN concat('in file: events/a b.txt line: ', event_id) WHEN 1 THEN concat('Widget in "gui/', event_id, '.gui" x') WHEN 2 THEN concat("bad 'mod/ugc_", event_id % 7, ".mod' key") ELSE 'plain' END)"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """A log with two lines for each event, the second a continuation."""
    rows = table(spark, sf, "events").selectExpr("event_id", f"{LOG} AS head", "concat('  Error: more ', event_id) AS more")
    pair = F.array(F.struct((F.col("event_id") * 2).alias("line"), F.col("head").alias("text")), F.struct((F.col("event_id") * 2 + 1).alias("line"), F.col("more").alias("text")))
    return rows.select(F.concat(F.lit("log_"), (F.col("event_id") % 8).cast("string")).alias("file"), F.explode(pair).alias("p")).select("file", "p.line", "p.text")


LOG_SQL = """WITH l AS (SELECT event_id, event_id % 24 * 3600 + 600 + event_id % 10 AS second, CASE WHEN event_type = 'view' THEN 'W' ELSE 'E' END AS level, CASE WHEN event_id % 3 = 0 THEN 'script_system_error' ELSE 'gui_warning' END AS category, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 4 END AS priority,
  CASE event_id % 4 WHEN 0 THEN 'events/a b.txt' WHEN 1 THEN 'gui/' || event_id || '.gui' WHEN 2 THEN 'mod/ugc_' || event_id % 7 || '.mod' END AS script_file, CASE WHEN event_id % 4 = 0 THEN event_id END::INT AS script_line, CASE WHEN event_id % 4 = 2 THEN (event_id % 7)::VARCHAR END AS mod_id FROM events)"""


@query(f"{LOG_SQL} SELECT event_id, second::INT AS second, level, category, priority, script_file, script_line, mod_id FROM l")
def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Head lines with their continuations, taken apart."""
    told = G.entries(_log(spark, sf)).withColumn("event_id", F.substring_index("message", " ", -1).cast("long"))
    return told.select("event_id", "second", "level", "category", "priority", "script_file", "script_line", "mod_id")


@query(f"{LOG_SQL} SELECT event_id, priority FROM l WHERE category = 'gui_warning' AND priority <= 4 AND level = 'E' AND mod_id = '3' UNION ALL SELECT event_id, -1 FROM l WHERE script_file LIKE 'gui/1%.gui'")
def log_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Records by category, priority, level and mod; records that hold a text."""
    rows = G.entries(_log(spark, sf)).withColumn("event_id", F.substring_index("message", " ", -1).cast("long"))
    return G.chosen(rows, "gui_warning", 4, "3", level="E").select("event_id", "priority").unionByName(G.with_text(rows, "GUI/1", ["script_file"]).select("event_id", F.lit(-1).alias("priority")))


@query("SELECT category, priority, event_id % 3 AS k, count(*) AS n FROM events JOIN (VALUES (0, 'decision_error', 3), (1, 'culture_error', 3), (2, 'portrait_error', 5)) AS c (m, category, priority) ON event_id % 3 = m GROUP BY ALL")
def game_log_categories(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 3 WHEN 0 THEN '[decision_type.cpp:1] x' WHEN 1 THEN '[Culture_Template.cpp:2] y' ELSE 'bad PORTRAIT' END")
    rows = table(spark, sf, "events").select((F.col("event_id") % 3).alias("k"), rules.log_category(text, rules.GAME_LOG_CATEGORIES).alias("c"))
    return rows.groupBy("c.category", "c.priority", "k").agg(F.count("*").alias("n"))


@query("SELECT 'category' AS what, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY event_type")
def log_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(table(spark, sf, "events").withColumn("category", F.expr("if(event_id % 3 = 0, 'a', 'b')")), ["category", "event_type"])


@query("SELECT 'log_' || (event_id % 8) AS file, event_id * 2 AS line FROM events WHERE event_id * 2 BETWEEN 100 AND 140 UNION ALL SELECT 'log_' || (event_id % 8), event_id * 2 + 1 FROM events WHERE event_id * 2 + 1 BETWEEN 100 AND 140")
def log_window(spark: SparkSession, sf: str) -> DataFrame:
    return G.window_of_lines(_log(spark, sf), 100, 140).select("file", "line")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by event time; the same plan runs on a stream."""
    from palimpsest.streaming.ingest import event_counts

    return event_counts(table(spark, sf, "events"), "ts", "event_type", "1 hour").drop("end")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.streaming.ingest import sessions

    return sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours").drop("end")
