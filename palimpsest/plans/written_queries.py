"""Registered queries over script, logs and files written from the rows of the supplied tables, so that their work grows
with the tables and the SQL beside them can say what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import lint
from palimpsest.operators import resolve as R
from palimpsest.plans.registry import query
from palimpsest.session import table
from palimpsest.sources import files as P
from palimpsest.sources import logs as G
from palimpsest.sources import script


def _parts(spark: SparkSession, sf: str, text: str, where: str = "true", digest: str = "p_partkey") -> DataFrame:
    """A text of script for each part."""
    return table(spark, sf, "part").where(where).selectExpr(f"{digest} AS digest", f"{text} AS text")


# --- parsing and its errors --------------------------------------------------------------------------


@query("""SELECT 'f' || p_partkey || '.txt' AS relpath, CASE p_size % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 + p_size % 3 END::BIGINT AS n_errors,
  CASE p_size % 4 WHEN 1 THEN 'unclosed block' WHEN 2 THEN 'not parsed' ELSE 'stray }' END AS first_error FROM part WHERE p_size % 4 <> 0""")
def unresolvable_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder that cannot be resolved: without a parsed text, or with errors in it."""
    texts = _parts(spark, sf, "CASE p_size % 4 WHEN 0 THEN concat('x = ', p_partkey) WHEN 1 THEN concat('x = { y = ', p_partkey) WHEN 3 THEN repeat('}\\n', 1 + p_size % 3) END")
    files = table(spark, sf, "part").selectExpr("p_partkey AS digest", "concat('f', p_partkey, '.txt') AS relpath")
    return R.unresolvable(files, script.nodes(texts)).select("relpath", F.col("n_errors").cast("long").alias("n_errors"), "first_error")


@query("""SELECT p_partkey AS digest, 1 AS line, length('a_' || p_partkey || ' = 1 ')::BIGINT AS start_off, 'stray }' AS error FROM part UNION ALL SELECT p_partkey, 2, length('a_' || p_partkey || ' = 1 ') + 2, 'stray }' FROM part WHERE p_size % 3 > 0
  UNION ALL SELECT -1 - p_partkey, 1, 0, 'operator = without key' FROM part WHERE p_size % 5 = 0""")
def parse_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The first two errors of each text; what stands around them is parsed."""
    rows = _parts(spark, sf, "concat('a_', p_partkey, ' = 1 }\\n', repeat('}\\n', p_size % 3))").unionByName(_parts(spark, sf, "concat('= ', p_size)", "p_size % 5 = 0", "-1 - p_partkey"))
    return script.diagnostics(script.nodes(rows), most=2).select("digest", F.col("line").cast("int").alias("line"), F.col("start_off").cast("long").alias("start_off"), "error")


BUNDLE = "['/etc/x', 'common/../x', 'src/x', 'common/a', 'events/e', 'events/b', 'events/ok']"


@query(f"""SELECT {BUNDLE}[p_partkey % 7 + 1] || p_partkey || CASE WHEN p_partkey % 7 = 3 THEN '_patched' ELSE '' END || '.txt' AS path, ['PATH_ABSOLUTE', 'PATH_TRAVERSAL', 'PATH_TOPLEVEL', 'NAME_STYLE', 'EMPTY_CONTENT', 'PARSE_ERROR'][p_partkey % 7 + 1] AS code,
  CASE WHEN p_partkey % 7 = 3 THEN 'warning' ELSE 'error' END AS level, CASE WHEN p_partkey % 7 = 5 THEN 1 + p_size % 3 END::INT AS line FROM part WHERE p_partkey % 7 < 6""")
def bundle_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the files of a bundle: their paths, names, and texts that are empty or do not parse."""
    stem = f"element_at(array({BUNDLE[1:-1]}), cast(p_partkey % 7 + 1 AS int))"
    rows = table(spark, sf, "part").selectExpr(f"concat({stem}, p_partkey, if(p_partkey % 7 = 3, '_patched', ''), '.txt') AS path", "CASE p_partkey % 7 WHEN 4 THEN '  ' WHEN 5 THEN concat(repeat('\\n', p_size % 3), 'a = { b') ELSE concat('a = ', p_size) END AS content")
    return P.validated_bundle(rows, script.nodes(rows.selectExpr("path AS path_of_file", "content"), "path_of_file", "content"))


# --- symbols, references, containers -----------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey AS k, p_size % 3 AS kind FROM part)
  SELECT 'events/' || k || '.txt' AS relpath, 'ns.' || k AS name, 'event' AS symbol_type, 4 AS line FROM s WHERE kind = 0
  UNION ALL SELECT 'common/religion/religions/' || k || '.txt', unnest(['rel_' || k, 'empty_' || k, 'fa_' || k, 'fb_' || k]), unnest(['religion', 'religion', 'faith', 'faith']), unnest([1, 2, 1, 1]) FROM s WHERE kind = 1
  UNION ALL SELECT 'common/landed_titles/' || k || '.txt', unnest(['e_' || k, 'color', 'k_' || k, 'd_' || k, 'c_' || k, 'b_' || k]), 'title', 1 FROM s WHERE kind = 2""")
def symbol_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """What event files define, religions with their faiths, and titles in titles; neither constants nor short or
    numeric names, nor what stands below them."""
    text = """CASE p_size % 3 WHEN 0 THEN concat('namespace = ns\\n@local = 5\\n\\nns.', p_partkey, ' = {\\n\\ttype = character_event\\n\\ttrigger = { a = b }\\n}\\nx = 5\\n12 = { }\\n')
      WHEN 1 THEN concat('rel_', p_partkey, ' = { faiths = { fa_', p_partkey, ' = { a = 1 } fb_', p_partkey, ' = { } b = { } } doctrine = d1 }\\nempty_', p_partkey, ' = { faiths = 3 }')
      ELSE concat('e_', p_partkey, ' = { color = { 1 2 3 } k_', p_partkey, ' = { d_', p_partkey, ' = { c_', p_partkey, ' = { b_', p_partkey, ' = { } } } 7 = { c_lost = { } } } }') END"""
    path = "concat(CASE p_size % 3 WHEN 0 THEN 'events/' WHEN 1 THEN 'common/religion/religions/' ELSE 'common/landed_titles/' END, p_partkey, '.txt')"
    files = table(spark, sf, "part").selectExpr("p_partkey AS digest", "'base' AS source", f"{path} AS relpath")
    return script.symbols(script.nodes(_parts(spark, sf, text)), files).select("relpath", "name", "symbol_type", F.col("line").cast("int").alias("line"))


@query("""SELECT p_partkey AS digest, unnest(['brave_' || p_partkey, 'amb_' || p_partkey, 'ev.' || p_partkey, '$EFFECT$', 'cu_' || p_size]) AS name, unnest(['trait', 'trait', 'event', 'scripted_effect', 'culture']) AS ref_type,
  unnest(['trigger', 'trigger', 'trigger_event', 'run_scripted_effect', 'limit']) AS context, unnest([3, 3, 4, 4, 5]) AS line FROM part""")
def reference_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The names that events refer to, with the nearest context; neither parameters of keys that take none nor empty names."""
    text = """concat('ns.', p_partkey, ' = {\\n\\ttype = character_event\\n\\ttrigger = { has_trait = brave_', p_partkey, ' NOT = { has_trait = amb_', p_partkey, ' } }\\n\\timmediate = { trigger_event = ev.', p_partkey,
      ' has_culture = $CULTURE$ run_scripted_effect = $EFFECT$ add_trait = "" }\\n\\toption = { limit = { culture = cu_', p_size, ' } faith = { x = y } }\\n}')"""
    return script.references(script.nodes(_parts(spark, sf, text))).select("digest", "name", "ref_type", "context", F.col("line").cast("int").alias("line"))


def _sources(spark: SparkSession, sf: str, texts: list[tuple[str, str]]) -> DataFrame:
    """Each part's text in each of some sources, where it has one: digest is the source's number and the part's."""
    made = None
    for i, (text, where) in enumerate(texts):
        rows = _parts(spark, sf, text, where, f"concat('f{i}_', p_partkey)")
        made = rows if made is None else made.unionByName(rows)
    return made


@query("""WITH s AS (SELECT 'on_' || p_partkey AS container, p_partkey AS k, p_size AS z FROM part)
  SELECT container, 'events' AS slot, 'a.' || k || CASE WHEN z % 2 = 0 THEN ',b.' || k ELSE '' END || ',c.' || k AS merged, 2 + (z % 2 = 0)::INT AS n_items, 2 AS n_sources, 1 AS winner, false AS conflict FROM s
  UNION ALL SELECT container, 'trigger', CASE WHEN z % 3 = 0 THEN 't=1' ELSE 't=0' END, 1 + (z % 3 = 0)::INT, 1 + (z % 3 = 0)::INT, (z % 3 = 0)::INT, z % 3 = 0 FROM s
  UNION ALL SELECT container, 'effect', CASE WHEN z % 4 = 0 THEN 'gain=2' ELSE 'gain=0' END, 1 + (z % 4 = 0)::INT, 1 + (z % 4 = 0)::INT, 2 * (z % 4 = 0)::INT, z % 4 = 0 FROM s
  UNION ALL SELECT container, 'random_events', '100=r.' || k, 1, 1, 1, false FROM s WHERE z % 3 = 0
  UNION ALL SELECT container, unnest(['first_valid', 'weight_multiplier']), unnest(['v.' || k, 'base=2']), 1, 1, 2, false FROM s WHERE z % 4 = 0""")
def container_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of three sources merged by the policy of each slot; a weighted item keeps its weight."""
    tree = script.nodes(
        _sources(
            spark,
            sf,
            [
                ("concat('on_', p_partkey, ' = { trigger = { t = 0 } events = { a.', p_partkey, if(p_size % 2 = 0, concat(' b.', p_partkey), ''), ' } effect = { gain = 0 } }')", "true"),
                ("concat('on_', p_partkey, ' = { events = { c.', p_partkey, ' }', if(p_size % 3 = 0, concat(' trigger = { t = 1 } random_events = { 100 = r.', p_partkey, ' }'), ''), ' }')", "true"),
                ("concat('on_', p_partkey, ' = { effect = { gain = 2 } first_valid = { v.', p_partkey, ' } weight_multiplier = { base = 2 } }')", "p_size % 4 = 0"),
            ],
        )
    )
    items = script.slots(tree, (*rules.APPENDED_SLOTS, *rules.SINGLE_SLOTS)).withColumn("load_order", F.substring("digest", 2, 1).cast("int"))
    return R.merge_containers(items, "container", ["load_order", "pos"], "item", "slot", rules.APPENDED_SLOTS)


@query("""SELECT 'part_' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS load_order, (p_size % 2 = 0)::BIGINT + (p_size % 3 = 0)::BIGINT AS overridden_count,
  CASE WHEN p_size % 3 = 0 THEN 'prowess=1' WHEN p_size % 2 = 0 THEN 'cost=' || (p_size + 1) || ',adv=6' ELSE 'cost=' || p_size END AS text FROM part""")
def override_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """The last of up to three sources wins a name, and its block comes along."""
    texts = _sources(
        spark,
        sf,
        [
            ("concat('part_', p_partkey, ' = { cost = ', p_size, ' }')", "true"),
            ("concat('part_', p_partkey, ' = { cost = ', p_size + 1, ' adv = 6 }')", "p_size % 2 = 0"),
            ("concat('part_', p_partkey, ' = { prowess = 1 }')", "p_size % 3 = 0"),
        ],
    )
    tree = script.nodes(texts)
    files = texts.select("digest", F.substring("digest", 2, 1).cast("int").alias("source"), F.concat(F.lit("common/culture/traditions/"), "digest", F.lit(".txt")).alias("relpath"))
    won = R.winners(script.symbols(tree, files), ["name"], ["source", "line", "node_id"], ["digest"])
    inner = tree.where("depth = 1").groupBy("digest", F.col("top_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("=", "key", "value").alias("s")))), lambda x: x["s"]), ",").alias("text"))
    return won.join(inner, ["digest", "node_id"]).select("name", F.col("source").alias("load_order"), "overridden_count", "text")


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT 'same_' || k AS name, 'same' AS change_type, 1 AS old_line, 2 AS new_line FROM s UNION ALL SELECT 'ch_' || k, 'changed', 2, 1 FROM s
  UNION ALL SELECT 'gone_' || k, 'removed', 3, NULL FROM s WHERE z % 2 = 0 UNION ALL SELECT 'new_' || k, 'added', NULL, 3 FROM s WHERE z % 3 = 0""")
def file_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level keys of two versions of every part's file: moved text is the same."""
    old = _parts(spark, sf, "concat('same_', p_partkey, ' = { x = 1 y = { 2 3 } }\\nch_', p_partkey, ' = { x > ', p_size, ' }', if(p_size % 2 = 0, concat('\\ngone_', p_partkey, ' = 5'), ''))")
    new = _parts(spark, sf, "concat('ch_', p_partkey, ' = { x < ', p_size, ' }\\nsame_', p_partkey, ' = { x = 1 y = { 2 3 } }', if(p_size % 3 = 0, concat('\\nnew_', p_partkey, ' = { }'), ''))")
    return script.top_changes(script.nodes(old), script.nodes(new))


# --- lint and edges ----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT 'duplicate_key' AS rule, 'a_' || k || '.x' AS path, 2::BIGINT AS n FROM s WHERE z % 2 = 0 UNION ALL SELECT unnest(['empty_block', 'missing', 'missing', 'deprecated']), unnest(['b_' || k, 'b_' || k, 'c_' || k, 'c_' || k || '.old']), 1 FROM s""")
def lint_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated keys, empty blocks, deprecated keys, blocks without a required key, in every part's text."""
    tree = script.nodes(_parts(spark, sf, "concat('a_', p_partkey, ' = { x = 1 need = y', if(p_size % 2 = 0, ' x = 2', ''), ' }\\nb_', p_partkey, ' = { }\\nc_', p_partkey, ' = { old = ', p_size, ' }')"))
    found = lint.duplicate_keys(tree).unionByName(lint.empty_blocks(tree)).unionByName(lint.deprecated(tree, ["old"])).unionByName(lint.missing_keys(tree, ["need"]))
    return found.select("rule", "path", F.col("n").cast("long").alias("n"))


@query("SELECT unnest(['peace_' || p_partkey, 'gain_' || p_partkey, 'gain_' || p_partkey]) AS source, unnest(['calls', 'uses', 'calls']) AS relation, unnest(['gain_' || p_partkey, 'brave_' || p_partkey, 'gain_' || p_partkey]) AS target FROM part")
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from definitions to the definitions they use as values or call as keys."""
    return lint.edges(script.nodes(_parts(spark, sf, "concat('gain_', p_partkey, ' = { add = brave_', p_partkey, ' gain_', p_partkey, ' = yes }\\npeace_', p_partkey, ' = { gain_', p_partkey, ' = yes other = ', p_size, ' }\\nbrave_', p_partkey, ' = { x = 1 }')")))


@query("SELECT context, key, count(*) AS n_files FROM (SELECT unnest(['trigger', 'effect', CASE WHEN p_size % 2 = 0 THEN 'trigger' END, CASE WHEN p_size % 3 = 0 THEN 'effect' END]) AS context, unnest(['age', 'gain', 'is_alive', 'lose_' || p_size % 5]) AS key FROM part) WHERE context IS NOT NULL GROUP BY ALL")
def learned_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys seen inside triggers and inside effects, by how many files use them."""
    text = "concat('a = { trigger = { age > ', p_size, if(p_size % 2 = 0, ' is_alive = yes', ''), ' } effect = { gain = 1 gain = 2', if(p_size % 3 = 0, concat(' lose_', p_size % 5, ' = 1'), ''), ' } }')"
    return lint.keys_by_context(script.nodes(_parts(spark, sf, text)), ("trigger", "effect"))


# --- units, files, logs ------------------------------------------------------------------------------

UNIT_DOMAINS = "['event', 'defines', 'maa_type', 'localization', 'casus_belli', 'trait', 'character_interaction']"


@query(f"""WITH s AS (SELECT p_partkey, {UNIT_DOMAINS}[p_size % 7 + 1] AS domain, [NULL, '', 'ns' || p_size][p_partkey % 3 + 1] AS namespace, 'x' || p_partkey AS name FROM part)
  SELECT p_partkey, CASE WHEN domain IN ('event', 'defines') AND namespace <> '' THEN domain || ':' || namespace || '.' || name ELSE CASE domain WHEN 'maa_type' THEN 'maa' WHEN 'localization' THEN 'loc' WHEN 'casus_belli' THEN 'cb' WHEN 'character_interaction' THEN 'interaction' ELSE domain END || ':' || name END AS unit_key FROM s""")
def unit_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"element_at(array({UNIT_DOMAINS[1:-1]}), p_size % 7 + 1) AS domain", "element_at(array(NULL, '', concat('ns', p_size)), cast(p_partkey % 3 + 1 AS int)) AS namespace", "concat('x', p_partkey) AS name")
    return rows.select("p_partkey", rules.unit_key(F.col("domain"), F.col("name"), F.col("namespace")).alias("unit_key"))


@query("""SELECT c_custkey, ['utf-8-sig', 'utf-16-le', 'utf-16-be', 'binary', 'utf-8', 'latin-1'][c_custkey % 6 + 1] AS encoding, CASE c_custkey % 6 WHEN 3 THEN NULL WHEN 4 THEN 'é' || c_name WHEN 5 THEN 'é' || c_name ELSE c_name END AS text FROM customer""")
def sniffed_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """The encoding of files told by their bytes, and their texts."""
    content = """CASE c_custkey % 6 WHEN 0 THEN concat(unhex('EFBBBF'), encode(c_name, 'UTF-8')) WHEN 1 THEN concat(unhex('FFFE'), encode(c_name, 'UTF-16LE')) WHEN 2 THEN concat(unhex('FEFF'), encode(c_name, 'UTF-16BE'))
      WHEN 3 THEN concat(encode(c_name, 'UTF-8'), unhex('00')) WHEN 4 THEN encode(concat('é', c_name), 'UTF-8') ELSE concat(unhex('E9'), encode(c_name, 'UTF-8')) END AS content"""
    return table(spark, sf, "customer").selectExpr("c_custkey", content).select("c_custkey", P.encoding(F.col("content")).alias("encoding"), P.decoded(F.col("content")).alias("text"))


@query("WITH s AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_acctbal, s_name) - 1 AS i, s_name = (SELECT max(s_name) FROM supplier) AS moved FROM supplier), r AS (SELECT name, moved, row_number() OVER (PARTITION BY moved ORDER BY i) - 1 AS k FROM s) SELECT name, (CASE WHEN moved THEN 2 WHEN k < 2 THEN k ELSE k + 1 END)::INT AS load_order FROM r")
def reordered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A load order with one source moved, numbered anew."""
    rows = table(spark, sf, "supplier")
    last = rows.agg(F.max("s_name")).first()[0]
    listed = rows.select(F.col("s_name").alias("name"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s_acctbal", "s_name")).alias("load_order"))
    return P.reordered(listed, last, 2).select("name", F.col("load_order").cast("int").alias("load_order"))


@query("""WITH e AS (SELECT ['system_init', 'gpu_info', 'dlc_info', 'dlc_info', 'mod_info', 'settings_info', 'define_warning', 'unknown'][event_id % 8 + 1] AS category FROM events)
  SELECT c.*, count(e.category) AS n FROM (VALUES ('system_init', 5, 'System initialization'), ('gpu_info', 5, 'GPU/graphics information'), ('dlc_info', 5, 'DLC loading information'), ('mod_info', 5, 'Mod loading information'), ('network_info', 5, 'Network/online services'), ('settings_info', 5, 'Settings loading'), ('define_warning', 4, 'Missing defines (usually harmless)'), ('unknown', 5, NULL)) AS c (category, priority, about) LEFT JOIN e USING (category) GROUP BY ALL""")
def debug_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a debug log by category, those without a line included."""
    said = "element_at(array('Log system initialized ', 'Selected adapter: ', 'DLC: a', 'DLC: b', 'Mod: c', 'loading settings ', 'Define N|K not specified ', 'hello '), cast(event_id % 8 + 1 AS int))"
    rows = table(spark, sf, "events").selectExpr(f"concat({said}, event_id) AS text").select(rules.log_category(F.col("text"), rules.DEBUG_LOG_CATEGORIES)["category"].alias("category"))
    return G.category_counts(rows, rules.DEBUG_LOG_CATEGORIES)


@query("SELECT 'n' || s_nationkey AS file, s_suppkey % 3 * 1000000 + s_suppkey + 1 AS line, ['dlc', 'mods_enabled', 'mods_disabled'][s_suppkey % 3 + 1] AS section, s_name AS item FROM supplier")
def debug_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Items below the headings of a debug log for each nation: its suppliers."""
    own = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS file", "s_suppkey % 3 * 1000000 + s_suppkey + 1 AS line", "concat('  ', s_name, ' ') AS text")
    heads = own.select("file").distinct().selectExpr("file", "inline(array(struct(-1, 'started'), struct(0, 'DLC:'), struct(1000000, 'Enabled mods:'), struct(1999999, '  '), struct(2000000, 'Disabled mods:'))) AS (line, text)")
    return G.debug_lists(own.unionByName(heads.selectExpr("file", "cast(line AS long) AS line", "text")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE '1.' || s_suppkey END AS game_version, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE 'KIND_' || s_nationkey END AS exception_type,
  CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE '0x00' || s_suppkey END AS exception_address, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'frame a' || s_suppkey || '|frame b' END AS stack, CASE WHEN s_suppkey % 4 > 0 THEN 'x: ' || s_name END AS note FROM supplier""")
def crash_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What exception and meta files tell."""
    text = """if(s_suppkey % 4 = 0, 'nothing', concat('Application: g\\r\\nVersion: 1.', s_suppkey, '\\nUnhandled Exception C0000005 (KIND_', s_nationkey, ') at address 0x00', s_suppkey, ' here\\n\\nStack Trace:\\n frame a', s_suppkey, '\\n\\n frame b\\nApplication: end\\n')) AS text"""
    meta = "if(s_suppkey % 4 = 0, 'none', concat('when: now\\nnote : x\\nnote: x: ', s_name, '\\n')) AS meta"
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", text, meta)
    parts = rows.select("s_suppkey", *G.exception_parts(F.col("text")), F.try_element_at(G.meta_pairs(F.col("meta")), F.lit("note")).alias("note"))
    return parts.withColumn("stack", F.array_join("stack", "|"))
