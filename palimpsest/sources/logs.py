"""Logs, crash folders, build records and chat sessions as DataFrames, with the filters and counts asked of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators.ordered import sections, stitch

# Extensions of files that log lines name, and what crash folders' names begin with.
EXTENSIONS = ("yml", "txt", "gui", "gfx", "mod")
CRASH_PREFIX = "ck3_"
# End of fixed values.
BLOCK = 4096  # lines of a log that one task counts
_digits = lambda x: (F.length(x) > 0) & (F.translate(x, "0123456789", "") == "")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their number from 1.

    A file is read in blocks by as many tasks as it has; a line's number is its place in its block, in the order in which
    one task reads it, and the number of lines of the blocks before it. No task holds a file.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("text"))
    sizes = rows.groupBy("file", "at.block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("i"))
    placed = rows.select("file", "at.block", "at.i", "text").withColumn("k", inside)
    return placed.join(before, ["file", "block"]).select("file", (F.col("k") + F.col("before")).cast("long").alias("line"), "text")


def window_of_lines(lines: DataFrame, start: int = 1, end: int | None = None, most: int | None = None, last: bool = False) -> DataFrame:
    """Lines ``start`` to ``end`` of each file, the first ``most`` of them or the ``last`` ones, as a feature of the view."""
    rows = lines.where(F.col("line") >= start)
    if end is not None:
        rows = rows.where(F.col("line") <= end)
    if most is None:
        return rows
    if not last:
        return rows.where(F.col("line") < start + most)
    ends = rows.groupBy("file").agg(F.max("line").alias("__end"))
    return rows.join(ends, "file").where(F.col("line") > F.col("__end") - most).drop("__end")


def head_parts(line: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a line begins a record, ``[time][level][source]: message``, and the four parts."""
    cut = F.split(line, "]", 4)
    part = lambda i: F.substring(F.get(cut, F.lit(i)), 2, 1 << 20)
    bracket = lambda i: F.get(cut, F.lit(i)).startswith("[") & (F.length(F.get(cut, F.lit(i))) > 1)
    level = part(1)
    ok = (F.size(cut) == 4) & bracket(0) & bracket(1) & bracket(2) & F.get(cut, F.lit(3)).startswith(":") & (F.length(level) == 1) & level.between("A", "Z")
    return F.coalesce(ok, F.lit(False)), {"time": part(0), "level": level, "source": part(2), "head": F.ltrim(part(3))}


def _leading_number(text: Column) -> Column:
    own = F.ltrim(text)
    rest = F.ltrim(own, F.lit("0123456789"))
    return F.nullif(F.substring(own, F.lit(1), F.length(own) - F.length(rest)), F.lit("")).try_cast("int")


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``, null without one."""
    return F.when(text.contains(mark), F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.length(text)))


def _quoted_file(text: Column, quote: str) -> Column:
    """The first text between quotes that ends in a known extension."""
    parts = F.split(text, quote)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.get(F.filter(inner, lambda x: F.substring_index(x, ".", -1).isin(*EXTENSIONS) & x.contains(".")), F.lit(0))


def entries(lines: DataFrame, categories: Sequence[tuple] = rules.LOG_CATEGORIES) -> DataFrame:
    """A row for each head line with its continuation lines: second of day, level, source, head, script file and line that
    it names, mod id, category, priority, signature, message. The category is told by head line and source alone."""
    is_head, _ = head_parts(F.col("text"))
    marked = lines.withColumn("is_head", is_head)
    whole = stitch(marked, ["file"], ["line"], "text", "is_head", "\n", BLOCK).where("record > 0")
    _, part = head_parts(F.substring_index("message", "\n", 1))
    clock = F.split(part["time"], ":")
    unit = lambda i: F.get(clock, F.lit(i)).try_cast("int")
    second = F.when(F.size(clock) == 3, unit(0) * 3600 + unit(1) * 60 + unit(2))
    message = F.col("message")
    named = _after(message, "file:")
    place = F.when(named.contains("line:"), F.trim(F.substring_index(named, "line:", 1)))
    ugc = _after(message, "ugc_")
    mod = F.nullif(F.substring(ugc, F.lit(1), F.length(ugc) - F.length(F.ltrim(ugc, F.lit("0123456789")))), F.lit(""))
    archive = F.when(message.contains("mod/ugc_"), F.concat(F.lit("mod/ugc_"), mod, F.lit(".mod")))
    first_line = F.substring_index("message", "\n", 1)
    told = rules.log_category(F.concat_ws(" ", part["source"], part["head"]), categories)
    return whole.select(
        "file", "record", second.alias("second"), part["level"].alias("level"), part["source"].alias("source"), part["head"].alias("head"),
        F.coalesce(F.nullif(place, F.lit("")), _quoted_file(message, "'"), _quoted_file(message, '"'), archive).alias("script_file"),
        _leading_number(_after(message, "line:")).alias("script_line"), mod.alias("mod_id"), told.alias("c"), rules.signature(part["head"]).alias("signature"), "message",
    ).select("*", "c.category", "c.priority").drop("c")


def chosen(rows: DataFrame, category: str | None = None, worst: int | None = None, mod: str | None = None, mod_like: str | None = None, level: str | None = None, without_children: bool = False) -> DataFrame:
    """Log records by category, priority up to ``worst``, mod exactly or in part, level; without children of a cascade."""
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if worst is not None:
        rows = rows.where(F.col("priority") <= worst)
    if mod is not None:
        rows = rows.where(F.col("mod_id") == mod)
    if mod_like is not None:
        rows = rows.where(F.lower("mod_id").contains(mod_like.lower()))
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if without_children:
        rows = rows.where(~F.coalesce(F.col("is_child"), F.lit(False)))
    return rows


def with_text(rows: DataFrame, text: str, columns: Sequence[str] = ("message", "script_file")) -> DataFrame:
    """Records that hold a text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def category_counts(rows: DataFrame, categories: Sequence[tuple]) -> DataFrame:
    """Records by category with priority and what the category is about; categories without a record have 0."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(c[0], c[2], c[3] if len(c) > 3 else None) for c in categories] + [("unknown", 5, None)], "category string, priority int, about string")
    n = rows.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(n, "category", "left").select("category", "priority", "about", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # the fixed table


def statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by each of some columns in one pass: what, value, n."""
    t = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in by])
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in by])
    return t.select(F.explode(pairs).alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


# --- what the debug log lists ----------------------------------------------------------------------

# Headings of the debug log's lists.
DEBUG_SECTIONS = (("DLC", "dlc"), ("Enabled mods", "mods_enabled"), ("Disabled mods", "mods_disabled"))
# End of fixed values.


def debug_lists(lines: DataFrame, headings: Sequence[tuple[str, str]] = DEBUG_SECTIONS) -> DataFrame:
    """Items below each heading of a log (a line "heading:"), up to the next: file, line, section, item. A heading and an
    empty line have no item, and lines before the first heading none at all."""
    text = F.trim("text")
    mark = rules.first_of([(text == f"{h}:", F.lit(name)) for h, name in headings], F.lit(None).cast("string"))
    told = sections(lines.withColumn("mark", mark), ["file"], ["line"], "mark", span=BLOCK)
    return told.where("section IS NOT NULL AND mark IS NULL").select("file", "line", "section", F.trim("text").alias("item")).where("item <> ''")


# --- crash folders ---------------------------------------------------------------------------------


def crashes(spark: SparkSession, root: str, prefix: str = CRASH_PREFIX) -> DataFrame:
    """Crash folders ``<prefix>YYYYMMDD_HHMMSS`` below ``root``: crash_id, at, game_version, exception_type, address, the
    first 20 frames of the stack (a feature of the report), and the key: value pairs of meta.yml."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder, name = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    own = files.where(folder.startswith(prefix) & name.isin("exception.txt", "meta.yml")).select(folder.alias("crash_id"), name.alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    text = lambda n: F.max(F.when(F.col("name") == n, F.col("text"))).alias(n.split(".")[0])
    both = own.groupBy("crash_id").agg(text("exception.txt"), text("meta.yml"))
    stamp = F.substring("crash_id", len(prefix) + 1, 15)
    return both.select("crash_id", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).alias("at"), *exception_parts(F.col("exception")), meta_pairs(F.col("meta")).alias("meta"))


def exception_parts(text: Column) -> list[Column]:
    """Version, kind, address and stack of an exception file's text; "unknown" for what it does not tell."""
    rows = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    line = lambda mark: F.get(F.filter(rows, lambda x: x.contains(mark)), F.lit(0))
    told = lambda c, name: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")).alias(name)
    thrown = _after(line("Unhandled Exception"), "(")
    address = F.split_part(F.ltrim(_after(line("at address"), "at address")), F.lit(" "), F.lit(1))
    start = F.array_position(F.transform(rows, lambda x: x.contains("Stack Trace:")), True)
    frames = F.filter(F.transform(F.when(start > 0, F.slice(rows, (start + 1).cast("int"), F.size(rows))), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("Application:"))
    stack = F.coalesce(F.slice(frames, 1, 20), F.array().cast("array<string>"))
    return [told(_after(line("Version:"), "Version:"), "game_version"), told(F.when(thrown.contains(")"), F.substring_index(thrown, ")", 1)), "exception_type"), told(F.when(address.startswith("0x"), address), "exception_address"), stack.alias("stack")]


def meta_pairs(text: Column) -> Column:
    """key: value lines as a map; of a repeated key the last counts."""
    rows = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + F.lit(1), F.length(x))).alias("value"))
    pairs = F.transform(rows, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def crash_summary(found: DataFrame) -> DataFrame:
    """Crashes by kind of exception, with the first and the last."""
    return found.groupBy("exception_type").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


# --- records of other tools ------------------------------------------------------------------------

BUILD = "ts double, event string, run_id string, step string, status string, seconds double, message string"
SESSION = "creationDate long, customTitle string, requests array<struct<message:struct<text:string>,response:array<struct<value:string>>>>"


def build_log(spark: SparkSession, path: str, event: str | None = None, run_id: str | None = None) -> DataFrame:
    """Records of a build log in JSON lines; lines that are no JSON are left out."""
    rows = spark.read.schema(f"{BUILD}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad IS NULL AND event IS NOT NULL").drop("_bad")
    for column, value in (("event", event), ("run_id", run_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def chat_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Turns of chat sessions in JSON lines: session (file), title, turn, role, text. An answer in parts is joined."""
    rows = spark.read.schema(SESSION).json(path).select(F.col("_metadata.file_name").alias("session"), F.col("customTitle").alias("title"), F.posexplode("requests").alias("i", "r"))
    answer = F.array_join(F.transform("r.response", lambda x: F.coalesce(x["value"], F.lit(""))), "\n")
    turn = lambda k, role, text: F.struct((F.col("i") * 2 + k).alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    both = F.array(turn(0, "user", F.col("r.message.text")), turn(1, "assistant", answer))
    return rows.select("session", "title", F.explode(both).alias("t")).select("session", "title", "t.turn", "t.role", "t.text").where("text IS NOT NULL AND text <> ''")


__all__ = ["build_log", "category_counts", "chat_sessions", "chosen", "crash_summary", "crashes", "debug_lists", "entries", "log_lines", "statistics", "window_of_lines", "with_text"]


def actionable(rows: DataFrame, worst: int = 3, top: int = 50) -> DataFrame:
    """Records of priority up to ``worst`` that are no child of a cascade, the most urgent first, roots before others, then
    in order of appearance. ``top`` is the report's length."""
    root = F.coalesce(F.col("is_root"), F.lit(False))
    kept = chosen(rows, worst=worst, without_children=True)
    return kept.orderBy("priority", root.desc(), "record", *(["file"] if "file" in rows.columns else [])).limit(top)


def with_mod(rows: DataFrame, mods: DataFrame, path: str = "script_file") -> DataFrame:
    """Records with the mod (mod_id, name) that their path names: by its id, else by its name as a slug in the path, the
    longest one if several fit. ``mods`` (mod_id, name) is the list of a playset, a few hundred rows."""
    slug = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_")
    known = mods.select(F.col("mod_id").alias("__id"), F.col("name").alias("mod_name"), slug.alias("__slug"))
    by_id = known.groupBy("__id").agg(F.max("mod_name").alias("__by_id"))
    told = rows.join(F.broadcast(by_id), F.col("mod_id") == F.col("__id"), "left").drop("__id")  # the playset's list
    one = known.where("__slug <> ''").agg(F.sort_array(F.collect_list(F.struct(F.length("__slug").alias("l"), "__slug", "__id", "mod_name")), asc=False).alias("__all"))
    told = told.crossJoin(F.broadcast(one))  # one row: the same list
    hit = F.get(F.filter("__all", lambda m: F.lower(path).contains(m["__slug"])), F.lit(0))
    guess = F.when(F.col("mod_id").isNull(), hit)
    name = F.when(F.col("mod_id").isNotNull(), F.coalesce("__by_id", F.concat(F.lit("Mod "), "mod_id"))).otherwise(guess["mod_name"])
    return told.withColumn("mod_name", name).withColumn("mod_id", F.coalesce("mod_id", guess["__id"])).drop("__by_id", "__all")
