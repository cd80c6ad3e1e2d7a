"""Registered queries over the supplied tables, each beside the SQL that must agree with it.

``lineitem`` stands for definitions (name = part, load order = supplier, file = order), ``documents`` for contents,
``events`` for logs and work queues, ``pages`` for paths, ``conversations`` for chat sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import conflicts as C
from palimpsest.operators import ordered as O
from palimpsest.operators import resolve as R
from palimpsest.operators import search as S
from palimpsest.operators import stats as T
from palimpsest.plans.registry import ORACLES, QUERIES, query
from palimpsest.session import table

TIES = ["file", "line", "price", "qty", "discount", "tax", "shipdate", "flag", "status"]


def _defs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS name", "l_suppkey AS load_order", "l_orderkey AS file", "l_linenumber AS line", "l_extendedprice AS price", "l_quantity AS qty",
        "l_discount AS discount", "l_tax AS tax", "l_shipdate AS shipdate", "l_returnflag AS flag", "l_linestatus AS status",
    )


DEFS = """WITH def AS (SELECT l_partkey AS name, l_suppkey AS load_order, l_orderkey AS file, l_linenumber AS line, l_extendedprice AS price,
  l_quantity AS qty, l_discount AS discount, l_tax AS tax, l_shipdate AS shipdate, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""
UP = "load_order, file, line, price, qty, discount, tax, shipdate, flag, status"
DOWN = ", ".join(f"{c} DESC" for c in UP.split(", "))


# --- winners and merges --------------------------------------------------------------------------


@query(f"{DEFS} SELECT name, load_order, file, line, price, n::BIGINT AS overridden_count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {DOWN}) AS r, count(*) OVER (PARTITION BY name) - 1 AS n FROM def) WHERE r = 1")
def resolve_override(spark: SparkSession, sf: str) -> DataFrame:
    return R.winners(_defs(spark, sf), ["name"], ["load_order", *TIES]).select("name", "load_order", "file", "line", "price", "overridden_count")


@query(f"{DEFS} SELECT name, load_order, file, line, price, n::BIGINT AS overridden_count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {UP}) AS r, count(*) OVER (PARTITION BY name) - 1 AS n FROM def) WHERE r = 1")
def resolve_fios(spark: SparkSession, sf: str) -> DataFrame:
    return R.winners(_defs(spark, sf), ["name"], ["load_order", *TIES], first=True).select("name", "load_order", "file", "line", "price", "overridden_count")


@query(f"{DEFS} SELECT name, load_order, file, line, price, winner_order, winner_file FROM (SELECT *, max(load_order) OVER (PARTITION BY name) AS winner_order, first_value(file) OVER (PARTITION BY name ORDER BY {DOWN}) AS winner_file FROM def) WHERE load_order < winner_order")
def resolve_losers(spark: SparkSession, sf: str) -> DataFrame:
    return R.losers(_defs(spark, sf), ["name"], "load_order", TIES, "file").select("name", "load_order", "file", "line", "price", "winner_order", "winner_file")


@query(f"{DEFS} SELECT file, line, load_order, name, price FROM (SELECT *, rank() OVER (PARTITION BY file, line ORDER BY load_order DESC) AS r FROM def) WHERE r = 1")
def file_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return R.survivors(_defs(spark, sf), ["file", "line"], "load_order").select("file", "line", "load_order", "name", "price")


@query(f"{DEFS} SELECT a.file, a.line, a.load_order, a.name, w.top AS winner_order FROM def a JOIN (SELECT file, line, max(load_order) AS top FROM def GROUP BY file, line) w ON a.file = w.file AND a.line = w.line AND a.load_order < w.top")
def file_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return R.losers(_defs(spark, sf), ["file", "line"], "load_order", ["name"], "name").select("file", "line", "load_order", "name", "winner_order")


POLICY = "CASE p_size % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'container_merge' WHEN 2 THEN 'per_key_override' ELSE 'fios' END"


@query(f"""{DEFS}, two AS (SELECT d.*, {POLICY} AS policy, row_number() OVER (PARTITION BY name ORDER BY {UP}) AS up, row_number() OVER (PARTITION BY name ORDER BY {DOWN}) AS down,
  count(*) OVER (PARTITION BY name) - 1 AS n FROM def d JOIN part ON name = p_partkey)
  SELECT name, policy, load_order, file, line, n::BIGINT AS overridden_count FROM two WHERE CASE WHEN policy = 'fios' THEN up ELSE down END = 1""")
def policy_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    policies = table(spark, sf, "part").selectExpr("p_partkey AS name", f"{POLICY} AS policy")
    return R.dispatch(_defs(spark, sf).join(policies, "name"), ["name"], ["load_order", *TIES], "policy").select("name", "policy", "load_order", "file", "line", "overridden_count")


@query("""WITH s AS (SELECT l_orderkey AS container, CASE l_linenumber % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'on_actions' WHEN 2 THEN 'trigger' ELSE 'effect' END AS slot,
  l_suppkey AS load_order, l_linenumber AS pos, l_partkey AS item FROM lineitem), m AS (SELECT *, max(load_order) OVER (PARTITION BY container, slot) AS top FROM s)
  SELECT container, slot, string_agg(item::VARCHAR, ',' ORDER BY load_order, pos, item) FILTER (slot IN ('events', 'on_actions') OR load_order = top) AS merged,
  count(*) AS n_items, count(DISTINCT load_order) AS n_sources, max(load_order) AS winner, slot NOT IN ('events', 'on_actions') AND count(DISTINCT load_order) > 1 AS conflict
  FROM m GROUP BY container, slot""")
def container_merge(spark: SparkSession, sf: str) -> DataFrame:
    slot = "CASE l_linenumber % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'on_actions' WHEN 2 THEN 'trigger' ELSE 'effect' END AS slot"
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey AS container", slot, "l_suppkey AS load_order", "l_linenumber AS pos", "l_partkey AS item")
    return R.merge_containers(items, "container", ["load_order", "pos"], "item", "slot", ("events", "on_actions"))


@query("""WITH a AS (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v, CASE WHEN a.k IS NOT NULL THEN 'ours' ELSE 'theirs' END AS side,
  a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v AS conflict FROM a FULL JOIN b ON a.k = b.k""")
def merge_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda s: table(spark, sf, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    return R.merge_two(side("F"), side("O"), ["k"], "v", "union")


# --- conflicts and risk --------------------------------------------------------------------------


@query(f"""{DEFS}, s AS (SELECT DISTINCT name, load_order FROM def), n AS (SELECT name, count(*) AS n_definitions FROM def GROUP BY name)
  SELECT s.name, count(*) AS n_sources, any_value(n_definitions) AS n_definitions, max(load_order) AS winner,
  array_to_string(list_transform(list_sort(list(load_order), 'DESC')[2:], lambda x: x::VARCHAR), ',') AS losers FROM s JOIN n ON s.name = n.name GROUP BY s.name HAVING count(*) > 1""")
def symbol_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return C.conflicts(_defs(spark, sf), ["name"], "load_order")


@query(f"""{DEFS}, g AS (SELECT p_brand AS symbol_type, name, count(DISTINCT load_order) AS s, count(*) AS n FROM def JOIN part ON name = p_partkey GROUP BY 1, 2)
  SELECT symbol_type, count(*) FILTER (s > 1) AS n_conflicts, coalesce(sum(n) FILTER (s > 1), 0)::BIGINT AS n_definitions, count(*) AS n_keys FROM g GROUP BY 1""")
def conflict_summary_nested(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "part").selectExpr("p_partkey AS name", "p_brand AS symbol_type")
    return C.conflict_counts(_defs(spark, sf).join(types, "name"), ["name"], "load_order", "symbol_type")


FOLDERS = ("common/on_action", "events", "common/scripted_effects", "common/decisions", "common/defines", "gui", "localization/english", "common/modifiers", "common/landed_titles", "gfx/coat_of_arms", "history/characters", "common/culture/traditions")
EXTENSIONS = (".txt", ".txt", ".yml", ".txt", ".dds", ".TXT", ".gui")
PATH_SQL = "(CASE p_size % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FOLDERS)) + " END) || '/' || replace(p_name, ' ', '_') || (CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS name", f"{PATH_SQL} AS path")


#: What the rules say of each test folder, by its number: route of a txt file, domain, policy, kind, report's domain, weights.
EXPECTED = """(VALUES (0, 'SCRIPT', 'on_action', 'container_merge', 'on_action', 'on_action', 30, 40), (1, 'SCRIPT', 'event', 'override', 'event', 'events', 25, 35),
  (2, 'SCRIPT', 'scripted_effect', 'override', 'scripted_effect', 'scripted_effect', 15, 25), (3, 'SCRIPT', 'decision', 'override', 'decision', 'decisions', 10, 30),
  (4, 'SCRIPT', 'defines', 'per_key_override', 'define', 'defines', 15, 10), (5, 'SKIP', 'gui', 'fios', 'definition', 'gui', 25, 45),
  (6, 'SKIP', 'localization', 'per_key_override', 'definition', 'localization', 5, 5), (7, 'SCRIPT', 'modifier', 'override', 'modifier', 'modifiers', 5, 15),
  (8, 'SCRIPT', 'content', 'override', 'title', 'landed_titles', 10, 25), (9, 'SKIP', 'content', 'override', 'coa', 'gfx', 10, 10),
  (10, 'LOOKUPS', 'content', 'override', 'definition', 'other', 10, 15), (11, 'SCRIPT', 'tradition', 'override', 'tradition', 'culture', 10, 15))
  AS r (folder, txt_route, domain, policy, kind, report_domain, unit_weight, report_weight)"""
ROUTE_SQL = "CASE WHEN p_size % 7 = 2 THEN CASE WHEN folder = 6 THEN 'LOCALIZATION' ELSE 'SKIP' END WHEN p_size % 7 IN (4, 6) THEN 'SKIP' ELSE txt_route END"
PATHS = f"WITH p AS (SELECT p_partkey AS name, p_size, {PATH_SQL} AS path, r.* FROM part JOIN {EXPECTED} ON p_size % 12 = folder)"


@query(f"{PATHS} SELECT name, path, {ROUTE_SQL} AS route, domain, policy FROM p")
def route_case(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("name", "path", rules.route(F.col("path"))["route"].alias("route"), rules.domain(F.col("path")).alias("domain"), rules.policy(F.col("path")).alias("policy"))


@query(f"{PATHS} SELECT name, kind FROM p")
def kind_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("name", rules.kind(F.col("path")).alias("kind"))


@query(f"{PATHS}, r AS (SELECT {ROUTE_SQL} AS route FROM p) SELECT route, count(*) AS n FROM r GROUP BY route")
def route_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).groupBy(rules.route(F.col("path"))["route"].alias("route")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS name, p_name, length(p_name) >= 2 AND NOT regexp_matches(p_name, '^\\d+\\.\\d+(\\.\\d+)?$') AND NOT regexp_matches(p_name, '^\\.?\\d+\\.?\\d*$') AS valid, regexp_matches(lower(p_name), 'compat|patch|fix|tweak|override') AS patch FROM part")
def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("name"), "p_name", rules.is_symbol_name(p).alias("valid"), rules.is_compatibility_patch(p).alias("patch"))


UNITS = f"""{DEFS}, p AS (SELECT p_partkey AS name, r.* FROM part JOIN {EXPECTED} ON p_size % 12 = folder), u AS (SELECT d.name, domain, policy, report_domain, unit_weight, report_weight,
  count(DISTINCT load_order) AS n, min(load_order) AS base, max(price) AS hi, min(price) AS lo FROM def d JOIN p ON d.name = p.name GROUP BY ALL)"""
BUCKET = "CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END"
BEHAVIOR = "CASE policy WHEN 'container_merge' THEN 'append' WHEN 'per_key_override' THEN 'merge_by_id' ELSE 'replace' END"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Each name's domain, policy, number of sources, lowest source and price range: two counts that need no set."""
    units = _defs(spark, sf).groupBy("name", "load_order").agg(F.max("price").alias("hi"), F.min("price").alias("lo")).groupBy("name")
    found = units.agg(F.count("*").alias("n"), F.min("load_order").alias("base"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return found.join(_paths(spark, sf), "name").select("name", rules.domain(F.col("path")).alias("domain"), rules.policy(F.col("path")).alias("policy"), rules.report_domain(F.col("path")).alias("report_domain"), "n", "base", "hi", "lo")


@query(f"""{UNITS}, s AS (SELECT *, {BEHAVIOR} AS behavior, least(100, unit_weight + greatest(n - 2, 0) * 10 + CASE WHEN base = 1 AND n > 1 THEN 5 ELSE 0 END + CASE WHEN lo < 1000 THEN 15 ELSE 0 END + CASE WHEN hi > 90000 THEN 20 ELSE 0 END)::BIGINT AS score FROM u)
  SELECT name, domain, behavior, n AS candidates, score, {BUCKET} AS level FROM s""")
def conflict_risk_unit(spark: SparkSession, sf: str) -> DataFrame:
    behavior = rules.merge_behavior(F.col("policy"))
    score = rules.unit_risk(F.col("domain"), F.col("n"), behavior, F.col("base") == 1, F.col("lo") < 1000, F.col("hi") > 90000)
    return _units(spark, sf).select("name", "domain", behavior.alias("behavior"), F.col("n").alias("candidates"), score.alias("score"), rules.risk_bucket(score).alias("level"))


@query(f"""{UNITS}, s AS (SELECT *, (hi - lo) / hi AS delta, least(100, report_weight + greatest(n - 2, 0) * 10 + CASE WHEN (hi - lo) / hi > 0.5 THEN 10 ELSE 0 END + CASE WHEN n > 5 THEN 10 WHEN n > 0 THEN 5 ELSE 0 END)::BIGINT AS score FROM u)
  SELECT name, report_domain AS domain, round(delta, 6) AS size_delta, score, {BUCKET} AS level FROM s""")
def conflict_risk_file(spark: SparkSession, sf: str) -> DataFrame:
    delta = (F.col("hi") - F.col("lo")) / F.col("hi")
    score = rules.file_risk(F.col("report_domain"), F.col("n"), delta, F.col("n"))
    return _units(spark, sf).select("name", F.col("report_domain").alias("domain"), F.round(delta, 6).alias("size_delta"), score.alias("score"), rules.risk_bucket(score).alias("level"))


@query(f"""{UNITS}, s AS (SELECT *, least(100, report_weight + greatest(n - 2, 0) * 15 + CASE WHEN lo < 1000 THEN 15 ELSE 0 END + CASE WHEN policy <> 'override' THEN 10 ELSE 0 END)::BIGINT AS score FROM u)
  SELECT name, report_domain AS domain, score, {BUCKET} AS level, CASE WHEN domain = 'on_action' THEN 'medium' WHEN hi > 2 * lo THEN 'medium' ELSE 'low' END AS uncertain,
  CASE WHEN report_domain IN ('localization', 'defines') AND policy = 'override' THEN 'none' WHEN report_domain IN ('events', 'scripted_effect', 'decisions') THEN 'low' ELSE 'medium' END AS report_uncertain FROM s""")
def conflict_risk_id(spark: SparkSession, sf: str) -> DataFrame:
    domain, merges = F.col("report_domain"), F.col("policy") != "override"
    score = rules.id_risk(domain, F.col("n"), F.col("lo") < 1000, merges)
    unsure = rules.uncertainty(F.col("domain"), rules.merge_behavior(F.col("policy")), F.col("hi") > 2 * F.col("lo"))
    return _units(spark, sf).select("name", domain.alias("domain"), score.alias("score"), rules.risk_bucket(score).alias("level"), unsure.alias("uncertain"), rules.id_uncertainty(domain, merges).alias("report_uncertain"))


@query(f"{UNITS} SELECT domain, count(*) FILTER (n > 1) AS n_conflicts, count(*) AS n_units, sum(n)::BIGINT AS n_candidates FROM u GROUP BY domain ORDER BY n_conflicts DESC, domain LIMIT 10")
def report_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    groups = _units(spark, sf).groupBy("domain").agg(F.count_if(F.col("n") > 1).alias("n_conflicts"), F.count("*").alias("n_units"), F.sum("n").alias("n_candidates"))
    return groups.orderBy(F.desc("n_conflicts"), "domain").limit(10)


@query("SELECT source, count(*) AS candidates, round(coalesce((max(n_chars) FILTER (n_chars > 0) - min(n_chars) FILTER (n_chars > 0)) / max(n_chars) FILTER (n_chars > 0), 0), 6) AS size_delta FROM documents GROUP BY source")
def size_delta_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return C.size_delta(table(spark, sf, "documents"), ["source"], "n_chars").withColumn("size_delta", F.round("size_delta", 6))


# --- contents, manifests, anti joins -------------------------------------------------------------


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n_files, min(doc_id) AS first_file, max(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY 1")
def dedup_contents(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("size"))
    return T.deduplicated(docs, "digest", "doc_id", "size").select("digest", "n_files", F.col("first").alias("first_file"), "size")


@query("WITH s AS (SELECT sha256(coalesce(text, '')) AS digest, min(string_split(coalesce(text, ''), ' ')[1]) AS name FROM documents GROUP BY 1) SELECT d.doc_id, d.source, s.name FROM documents d JOIN s ON sha256(coalesce(d.text, '')) = s.digest")
def content_join(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    files = table(spark, sf, "documents").select("doc_id", "source", F.sha2(text, 256).alias("digest"), F.split(text, " ")[0].alias("word"))
    names = files.groupBy("digest").agg(F.min("word").alias("name"))
    return files.join(names, "digest").select("doc_id", "source", "name")


@query("""WITH f AS (SELECT source, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS digest FROM documents),
  b AS (SELECT source, substr(sha256(path), 1, 4) AS bucket, sha256(string_agg(path || digest, '' ORDER BY path, digest)) AS h, count(*) AS n FROM f GROUP BY 1, 2)
  SELECT source, sha256(string_agg(h, '' ORDER BY bucket)) AS root_hash, sum(n)::BIGINT AS n_files FROM b GROUP BY source""")
def root_hash(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return T.root_hash(files, "source", "path", "digest")


MANIFEST = "SELECT l_orderkey AS file, max(l_extendedprice) AS digest FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1"


@query(f"""WITH a AS ({MANIFEST.format("A")}), b AS ({MANIFEST.format("R")}) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'new' WHEN b.file IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS status
  FROM a FULL JOIN b ON a.file = b.file""")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("file")).agg(F.max("l_extendedprice").alias("digest"))
    return C.compare_manifests(side("A"), side("R"), ["file"], "digest")


@query("SELECT l_partkey AS name FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def common_keys_intersect(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: table(spark, sf, "lineitem").where(F.col("l_suppkey") == s).select(F.col("l_partkey").alias("name"))
    return of(1).intersect(of(2))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 1)")
def unused_symbols(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey"))
    return C.without(table(spark, sf, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def undefined_refs(spark: SparkSession, sf: str) -> DataFrame:
    return C.without(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def orphans_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return C.without(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5)")
def visibility_semi(spark: SparkSession, sf: str) -> DataFrame:
    return C.visible(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey", [1, 3, 5]).select("s_suppkey", "s_name")


@query("SELECT 'none' AS scope, count(*) FILTER (false) AS n FROM supplier UNION ALL SELECT 'all', count(*) FROM supplier UNION ALL SELECT 'empty is all', count(*) FROM supplier")
def visibility_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Rows seen through an empty list of sources, through none at all, and where an empty list means all."""
    rows = table(spark, sf, "supplier")
    seen = {"none": C.visible(rows, "s_suppkey", []), "all": C.visible(rows, "s_suppkey", None), "empty is all": C.visible(rows, "s_suppkey", [], "all")}
    counts = [df.agg(F.lit(k).alias("scope"), F.count("*").alias("n")) for k, df in seen.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'SMALL' AND p_name ILIKE '%RING%' AND p_size >= 5 AND p_size <= 40")
def generic_filters(spark: SparkSession, sf: str) -> DataFrame:
    return S.filtered(table(spark, sf, "part"), {"p_type": "SMALL", "p_name": "%RING%", "p_size_gte": 5, "p_size_lte": 40}).select("p_partkey", "p_name", "p_size")


@query("SELECT r_name, n_name, count(c_custkey) AS n_customers, coalesce(round(sum(c_acctbal), 2), 0) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    tree = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    return T.branch_totals(tree, own, "n_nationkey", ["r_name", "n_name"], "c_acctbal").select("r_name", "n_name", F.col("n").alias("n_customers"), F.round("total", 2).alias("balance"))


# --- search --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name, CASE WHEN n LIKE 'red widget' THEN 'exact' WHEN n LIKE 'red widget%' THEN 'prefix' WHEN n LIKE 'red%' THEN 'stem' WHEN n LIKE '%red widget' THEN 'suffix' WHEN n LIKE '%red widget%' THEN 'contains'
  WHEN n LIKE '%widget' THEN 'suffix_tokens' ELSE 'flex_underscore' END AS match_type FROM (SELECT *, lower(p_name) AS n FROM part) WHERE n LIKE 'red%' OR n LIKE '%widget' OR n LIKE '%red%widget%'""")
def adjacency_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.adjacent(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "red widget", sep=" ")


def _count_sql(term: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{term}', ''))) // {len(term)})"


@query(f"SELECT doc_id, ({_count_sql('the')} + {_count_sql('and')})::BIGINT AS n_occurrences FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def grep_files(spark: SparkSession, sf: str) -> DataFrame:
    return S.grep_files(table(spark, sf, "documents").select("doc_id", "text"), "text", ["the", "and"]).select("doc_id", "n_occurrences")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
  h AS (SELECT *, least(nullif(instr(lower(value), 'license'), 0), nullif(instr(lower(value), 'http'), 0)) AS p FROM l WHERE contains(lower(value), 'license') OR contains(lower(value), 'http'))
  SELECT doc_id, line::BIGINT AS line, substr(value, greatest(p - 30, 1), p + 50 - greatest(p - 30, 1)) AS snippet FROM h""")
def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.grep_lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ["license", "http"])


@query(f"SELECT source, sum({_count_sql('tion')})::BIGINT AS n, count(*) FILTER (contains(lower(text), 'tion')) AS n_docs FROM documents GROUP BY source")
def count_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", S.occurrences(F.col("text"), "tion").alias("n"))
    return docs.groupBy("source").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


@query("SELECT doc_id, substr(text, greatest(p - 20, 1), p + 40 - greatest(p - 20, 1)) AS snippet FROM (SELECT *, instr(lower(text), 'er ') AS p FROM documents) WHERE p > 0")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.instr(F.lower("text"), "er ").alias("at")).where("at > 0")
    return docs.select("doc_id", S.snippet(F.col("text"), F.col("at"), 20, 40).alias("snippet"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), l AS (SELECT doc_id, len(t) AS len, len(list_filter(t, lambda x: x = 'license')) AS f1, len(list_filter(t, lambda x: x = 'rights')) AS f2 FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM l)
  SELECT doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score
  FROM l, s WHERE f1 > 0 OR f2 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return S.bm25(docs, "doc_id", "text", "license rights").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("""SELECT 'part' AS scope, p_partkey::VARCHAR AS key, p_name AS label FROM part WHERE lower(p_name) LIKE '%r%0%' OR lower(p_name) LIKE '%ring%'
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier WHERE lower(s_name) LIKE '%r%0%' OR lower(s_name) LIKE '%ring%' UNION ALL SELECT 'page', page_id::VARCHAR, url FROM pages WHERE lower(url) LIKE '%r%0%' OR lower(url) LIKE '%ring%'""")
def unified_search(spark: SparkSession, sf: str) -> DataFrame:
    branches = [S.tagged("part", table(spark, sf, "part"), "p_partkey", "p_name"), S.tagged("supplier", table(spark, sf, "supplier"), "s_suppkey", "s_name"), S.tagged("page", table(spark, sf, "pages"), "page_id", "url")]
    hit = F.lower("label").like("%r%0%") | F.lower("label").like("%ring%")
    return branches[0].unionByName(branches[1]).unionByName(branches[2]).where(hit)


@query("SELECT host, folder, count(*) AS n, count(*) FILTER (deeper) AS n_deeper FROM (SELECT split_part(url, '/', 3) AS host, split_part(split_part(split_part(url, '/', 4), '?', 1), '#', 1) AS folder, split_part(url, '/', 5) <> '' AS deeper FROM pages) GROUP BY host, folder")
def folder_listing(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: F.split_part("url", F.lit("/"), F.lit(n))
    folder = F.split_part(F.split_part(part(4), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").groupBy(part(3).alias("host"), folder.alias("folder")).agg(F.count("*").alias("n"), F.count_if(part(5) != "").alias("n_deeper"))


# --- queues and logs -----------------------------------------------------------------------------


@query("SELECT event_type, user_id, count(*) AS n, grouping(event_type, user_id)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def queue_counts_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events")
    return t.groupingSets([[t.event_type], [t.user_id], []], t.event_type, t.user_id).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


PRIORITY = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END"


@query("SELECT user_id, event_type, props, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type, props")
def fingerprint_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def time_bucket_60s(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT event_type AS category, {PRIORITY} AS priority, count(*) AS n, count(DISTINCT user_id) AS n_mods, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("priority", F.expr(PRIORITY))
    return T.seen(rows, ["event_type", "priority"], "user_id", "ts").withColumnsRenamed({"event_type": "category", "n_distinct": "n_mods"})


MESSAGES = (
    "Fatal(Crash) at start", "Incorrect MOD descriptor in x", "[jomini_script_system.cpp:12] bad", "trait brave not defined", "wrong SCOPE here", "eventmanager.cpp:3 x", "Duplicate localization key k",
    "Key is missing localization k", "pdx_gui_layout", "portraitcontext.cpp bone", "audio2_fmod_sound x", "nothing to see",
)
MESSAGE_SQL = "(CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END)"


@query("""SELECT category, priority, count(*) AS n FROM events JOIN (VALUES (0, 'fatal_crash', 1), (1, 'encoding_error', 2), (2, 'script_system_error', 2), (3, 'missing_reference', 3), (4, 'scope_error', 3), (5, 'event_error', 3),
  (6, 'duplicate_key', 4), (7, 'localization_missing', 4), (8, 'gui_warning', 4), (9, 'scope_error', 3), (10, 'audio_error', 5), (11, 'unknown', 5)) AS m (k, category, priority) ON event_id % 12 = k GROUP BY 1, 2""")
def first_match_category(spark: SparkSession, sf: str) -> DataFrame:
    """Log messages by the first category that they match; a portrait context counts as a scope error, which comes first."""
    told = table(spark, sf, "events").select(rules.log_category(F.expr(MESSAGE_SQL)).alias("c"))
    return told.groupBy("c.category", "c.priority").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events)
  SELECT r.event_id, count(*) AS n_children, min(c.event_id) AS first_child FROM e r JOIN e c ON c.pos BETWEEN r.pos - 50 AND r.pos + 149 AND c.pos <> r.pos AND abs(date_diff('second', r.ts, c.ts)) <= 3600 AND c.event_type = 'view'
  WHERE r.event_type = 'error' GROUP BY 1 HAVING count(*) >= 3""")
def cascade_script(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select("event_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    placed = O.positions(seen, "hour", ["ts", "event_id"]).drop("hour")
    pairs = O.near(placed.where("event_type = 'error'"), placed.where("event_type = 'view'"), "pos", 50, 149)
    close = pairs.where(F.abs(F.expr("timestampdiff(SECOND, date_trunc('SECOND', root_ts), date_trunc('SECOND', ts))")) <= 3600)
    return close.groupBy(F.col("root_event_id").alias("event_id")).agg(F.count("*").alias("n_children"), F.min("event_id").alias("first_child")).where("n_children >= 3")


@query("SELECT r.event_id, count(*) AS n_later FROM events r JOIN events c ON c.user_id = r.user_id AND c.ts > r.ts AND c.event_type = 'click' WHERE r.event_type = 'error' GROUP BY 1 HAVING count(*) >= 5")
def cascade_mod(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("day", "ts").alias("day"))
    return O.later_counts(seen, "user_id", "ts", "event_type = 'error'", "event_type = 'click'", "day").where("n_later >= 5").select("event_id", "n_later")


@query("SELECT regexp_replace(substr(text, 1, 100), '\\d+', 'N', 'g') AS signature, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def spam_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy(rules.signature(F.col("text")).alias("signature")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 3")


@query(f"SELECT event_id, {PRIORITY} AS priority, value FROM events WHERE {PRIORITY} >= 2 ORDER BY {PRIORITY} DESC, value DESC, event_id LIMIT 50")
def actionable_topk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", f"{PRIORITY} AS priority", "value").where("priority >= 2").orderBy(F.desc("priority"), F.desc("value"), "event_id").limit(50)


@query("""WITH r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations)
  SELECT conv_id, record::BIGINT AS record, string_agg(text, '|' ORDER BY turn, text) AS message, count(*) AS n_lines FROM r GROUP BY 1, 2""")
def multiline_stitch(spark: SparkSession, sf: str) -> DataFrame:
    return O.stitch(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], "text", "role = 'user'", "|")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_fill(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr("CASE WHEN event_type = 'signup' THEN event_id END").alias("mark"))
    return O.sections(lines, ["user_id"], ["ts", "event_id"], "mark").select("event_id", "section")


@query("SELECT conv_id, string_agg('## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.sinks.export import chat_markdown

    return chat_markdown(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS sd, count(*) AS n FROM documents) SELECT doc_id, round((n_chars - m) / sd, 4) AS z FROM documents, s WHERE n >= 100 AND (n_chars - m) / sd >= 2 ORDER BY z DESC, doc_id LIMIT 50""")
def outlier_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return T.outliers(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", least_rows=100, least_z=2.0).select("doc_id", F.round("z", 4).alias("z")).orderBy(F.desc("z"), "doc_id").limit(50)


@query("SELECT event_type AS step, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 2) AS total FROM events GROUP BY 1")
def run_step_stats(spark: SparkSession, sf: str) -> DataFrame:
    told = T.summary(table(spark, sf, "events"), ["event_type"], "value")
    return told.select(F.col("event_type").alias("step"), "n", F.round("mean", 4).alias("mean"), "least", "most", F.round("total", 2).alias("total"))


@query("SELECT source, count(*) AS n, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / count(*)::DOUBLE, 1) AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source")
def coverage_pct(spark: SparkSession, sf: str) -> DataFrame:
    return T.coverage(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", ["source"]).withColumnRenamed("n_covered", "n_labelled")


READY = "CASE WHEN n IS NULL THEN 'missing' WHEN pending = 0 THEN 'ready' WHEN pending = n THEN 'not_indexed' ELSE 'pending' END"


@query(f"WITH f AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS pending FROM lineitem GROUP BY 1) SELECT s_suppkey, coalesce(n, 0) AS n_files, coalesce(pending, 0) AS n_pending, {READY} AS status FROM supplier LEFT JOIN f ON k = s_suppkey")
def playset_readiness(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_returnflag") == "N").alias("pending"))
    return T.readiness(table(spark, sf, "supplier").select("s_suppkey"), files, "s_suppkey", "pending")


@query("SELECT k, event_type, count(*) AS n FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events) WHERE k >= 50 GROUP BY k, event_type")
def json_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").where("k >= 50").groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '#[^\\n]*', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS node_hash
  FROM documents WHERE text IS NOT NULL""")
def node_hash_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(rules.node_text(F.col("text")), 256).alias("node_hash"))


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def loc_regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern references in a text: exploded, then counted by (name, page) first, so a common name is summed map-side."""
    found = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return found.groupBy("tag", "page_id").agg(F.count("*").alias("n")).groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))


@query("SELECT l_orderkey AS file, l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def lint_duplicate_key(spark: SparkSession, sf: str) -> DataFrame:
    return T.repeated(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("key")), ["file", "key"])


@query("SELECT o_orderkey AS file FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def lint_required(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("key"))
    return T.lacking(table(spark, sf, "orders").select(F.col("o_orderkey").alias("file")), entries, "file", F.col("key") == 1)


# --- script text: no SQL can say a parse; held against small fixtures in tests/ -------------------


def _script(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a script file: a block a document whose words are the items of its slots."""
    word = F.regexp_replace(F.coalesce("text", F.lit("")), r'[{}"#=<>!?;`@$,\s]+', " ")
    body = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(" = {\n\tevents = {\n"), word, F.lit("\n\t}\n\tsource = "), F.coalesce("source", F.lit("none")), F.lit("\n}\n"))
    return table(spark, sf, "documents").select("doc_id", "source", body.alias("script"))


@query()
def script_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table of every document's script, each distinct content parsed once."""
    from palimpsest.sources.script import nodes

    files = _script(spark, sf).select(F.sha2("script", 256).alias("digest"), "script")
    return nodes(files.groupBy("digest").agg(F.first("script").alias("script")), "digest", "script")


@query("SELECT doc_id, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[{}\"#=<>!?;`@$,\\s]+', ' ', 'g'), '[^\\s]+'))::BIGINT AS n_items FROM documents WHERE len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[{}\"#=<>!?;`@$,\\s]+', ' ', 'g'), '[^\\s]+')) > 0")
def script_slot_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the events slot of each container, counted from the parsed nodes."""
    from palimpsest.sources.script import SLOTS, nodes, slots

    tree = nodes(_script(spark, sf).withColumnRenamed("doc_id", "digest").select("digest", "script"), "digest", "script", SLOTS)
    return slots(tree, ("events",)).groupBy(F.col("digest").alias("doc_id")).agg(F.count("*").alias("n_items"))

