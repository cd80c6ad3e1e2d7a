"""Folders, playsets, localization and logs as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.rules import route

PLAYSET = "playset_name string, vanilla struct<version:string,path:string,enabled:boolean>, mods array<struct<name:string,steam_id:string,path:string,load_order:int,enabled:boolean,is_compatch:boolean,notes:string>>"


def manifest(spark: SparkSession, root: str, source: str, routes: Sequence[str] = ("SCRIPT", "LOCALIZATION")) -> DataFrame:
    """Every routed file below ``root``: source, relpath (lower case, forward slashes), size, mtime, digest, content.

    Hidden and thumbnail files are left out. Files are read once, by the tasks that own them.
    """
    prefix = root.rstrip("/").split("://")[-1].replace("file:", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.lower(F.substring_index(F.col("path"), prefix + "/", -1))
    return (
        files.select(F.lit(source).alias("source"), rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"), "content")
        .withColumn("route", route(F.col("relpath"))["route"])
        .where(F.col("route").isin(*routes) & ~F.col("relpath").rlike(r"(^|/)\.|thumbnail"))
    )


def encoding(content: Column) -> Column:
    """By byte order mark; else binary if the first 8 KB hold a zero byte; else UTF-8 if valid; else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(F.hex(F.substring(content, 1, 8192)).rlike("^(..)*?00"), "binary")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("latin-1")
    )


def decoded(content: Column) -> Column:
    """Text of a file's bytes without its byte order mark; null for binary content."""
    kind = encoding(content)
    rest = lambda n: F.substring(content, n, 2147483647)
    return (
        F.when(kind == "utf-8-sig", F.make_valid_utf8(rest(4).cast("string")))
        .when(kind == "utf-16-le", F.decode(rest(3), "UTF-16LE"))
        .when(kind == "utf-16-be", F.decode(rest(3), "UTF-16BE"))
        .when(kind == "utf-8", content.cast("string"))
        .when(kind == "latin-1", F.decode(content, "ISO-8859-1"))
    )


def contents(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The store's new rows: one for each digest that ``known`` lacks, with size, encoding and text."""
    fresh = files if known is None else files.join(known.select("digest"), "digest", "left_anti")
    one = fresh.groupBy("digest").agg(F.first("content").alias("content"))
    return one.select("digest", F.length("content").cast("long").alias("size"), encoding(F.col("content")).alias("encoding"), decoded(F.col("content")).alias("text"), "content")


def load_order(spark: SparkSession, path: str) -> DataFrame:
    """The sources of playset files: the base at 0, then the enabled ones in their order."""
    plays = spark.read.option("multiLine", True).schema(PLAYSET).json(path)
    base = plays.where("vanilla.enabled IS NULL OR vanilla.enabled").select("playset_name", F.lit(0).alias("load_order"), F.lit("base").alias("name"), F.col("vanilla.path").alias("path"))
    mods = plays.select("playset_name", F.posexplode("mods").alias("i", "m")).where("m.path IS NOT NULL AND coalesce(m.enabled, true)")
    return base.unionByName(mods.select("playset_name", (F.col("i") + 1).alias("load_order"), F.col("m.name").alias("name"), F.col("m.path").alias("path")))


_NAME = "abcdefghijklmnopqrstuvwxyz0123456789_"


def _made_of(text: Column, letters: str) -> Column:
    return (F.length(text) > 0) & (F.translate(F.lower(text), letters, "") == "")


def _entry(line: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a line is an entry, ``key:version "value"``, and its parts: the line is cut at the first colon, the first
    quote after it and the quote that ends it."""
    key = F.ltrim(F.substring_index(line, ":", 1))
    rest = F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line))
    head = F.substring_index(rest, '"', 1)
    version = F.rtrim(F.translate(head, "\t", " "))
    value = F.substring(rest, F.length(head) + 2, F.length(rest) - F.length(head) - 2)
    quoted = rest.endswith('"') & (F.length(rest) >= F.length(head) + 2)
    ok = line.contains(":") & _made_of(key, _NAME + ".") & ~key.startswith(".") & quoted & (F.length(head) > F.length(version)) & ((version == "") | _made_of(version, "0123456789"))
    return F.coalesce(ok, F.lit(False)), {"loc_key": key, "version": F.coalesce(F.nullif(version, F.lit("")).try_cast("int"), F.lit(0)), "value": value}


def _language(line: Column) -> Column:
    """The language of a header line such as ``l_english:``, else null."""
    name = F.trim(F.translate(line, "\t", " "))
    inner = F.substring(name, F.lit(3), F.length(name) - 3)
    return F.when(name.startswith("l_") & name.endswith(":") & _made_of(inner, "abcdefghijklmnopqrstuvwxyz") & (F.lower(inner) == inner), inner)


def _scripted(value: Column) -> Column:
    """Texts between square brackets."""
    cut = F.slice(F.split(value, "[\\[]"), 2, 1 << 20)
    return F.filter(F.transform(F.filter(cut, lambda x: x.contains("]")), lambda x: F.substring_index(x, "]", 1)), lambda x: x != "")


def _variables(value: Column) -> Column:
    """Names between dollar signs; a sign ends one name only."""
    cut = F.split(value, "[$]")
    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("taken"))
    is_name = lambda x: _made_of(x, _NAME) & ~F.substring(x, 1, 1).between("0", "9")
    step = lambda s, x: F.when(~s["taken"] & is_name(x), F.struct(F.array_append(s["found"], x).alias("found"), F.lit(True).alias("taken"))).otherwise(F.struct(s["found"].alias("found"), F.lit(False).alias("taken")))
    return F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), start, step, lambda s: s["found"])


def _icons(value: Column) -> Column:
    """Names after an at sign."""
    cut = F.slice(F.split(value, "@"), 2, 1 << 20)
    rest = lambda x: F.ltrim(x, F.lit(_NAME + _NAME[:26].upper()))
    names = F.transform(cut, lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(rest(x))))
    return F.filter(names, lambda x: (x != "") & ~F.substring(x, 1, 1).between("0", "9"))


def _loc_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    lines = F.split(swap(swap(F.col(text), "\r\n", "\n"), "\r", "\n"), "\n")
    headers = F.filter(F.transform(lines, _language), lambda x: x.isNotNull())
    rows = files.select(key, F.coalesce(F.get(headers, F.lit(0)), F.lit("unknown")).alias("language"), F.posexplode(lines).alias("i", "line_text"))
    return rows.where(~F.ltrim("line_text").startswith("#")).withColumn("line", (F.col("i") + 1).cast("long"))


def localization(files: DataFrame, key: str = "relpath", text: str = "text") -> DataFrame:
    """Entries of localization files: key columns, line, language, loc_key, version, value and the names that the value
    refers to. The first header names the file's language; comments and other lines are left out."""
    ok, part = _entry(F.col("line_text"))
    rows = _loc_lines(files, key, text).where(ok).select(key, "line", "language", *[c.alias(n) for n, c in part.items()])
    value = F.col("value")
    return rows.select("*", _scripted(value).alias("scripted"), _variables(value).alias("variables"), _icons(value).alias("icons"))


def malformed(files: DataFrame, key: str = "relpath", text: str = "text") -> DataFrame:
    """Lines that look like entries, with a colon and a quote, but are none: key columns, line, line_text."""
    line = F.col("line_text")
    ok, _ = _entry(line)
    return _loc_lines(files, key, text).where(~ok & _language(line).isNull() & line.contains(":") & line.contains('"')).select(key, "line", F.trim(line).alias("line_text"))


def localization_refs(entries: DataFrame, key: str = "relpath") -> DataFrame:
    """A row for each name that an entry's value refers to: key columns, loc_key, ref_type, ref_value."""
    named = lambda c, t: F.transform(F.col(c), lambda x: F.struct(F.lit(t).alias("ref_type"), x.alias("ref_value")))
    every = [named("scripted", "scripted"), named("variables", "variable"), named("icons", "icon")]
    return entries.select(key, "loc_key", F.explode(F.concat(*every)).alias("r")).select(key, "loc_key", "r.ref_type", "r.ref_value")


def glob_files(files: DataFrame, pattern: str, most: int | None = 500, path: str = "relpath") -> DataFrame:
    """Files whose path meets a glob (``**``: any folders, ``*``: within a name, ``?``: one character), in order; ``most``
    is the report's length."""
    out = ""
    for piece in pattern.replace("**/", "\0").replace("**", "\1"):
        out += {"\0": "(.*/)?", "\1": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, piece if piece.isalnum() or piece in "/_-" else f"[{piece}]" if piece != "^" else r"\^")
    found = files.where(F.col(path).rlike(f"^{out}$"))
    return found if most is None else found.orderBy(path).limit(most)


def content_folders(files: DataFrame, path: str = "relpath") -> DataFrame:
    """Folders that hold script text: below common/, and events."""
    p = F.col(path)
    folder = F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)
    return files.where(p.endswith(".txt") & (p.startswith("common/") | p.startswith("events/"))).select(folder.alias("folder")).distinct()


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, str], known: DataFrame | None = None, key: str = "digest") -> dict[str, DataFrame]:
    """Tables of a snapshot, one folder of (gzip) JSON each; of the contents only those that ``known`` lacks."""
    tables = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
    if known is not None and "contents" in tables:
        tables["contents"] = tables["contents"].join(known.select(key).distinct(), key, "left_anti")
    return tables


def reordered(order: DataFrame, name: str, position: int) -> DataFrame:
    """A load order with one source moved to a position (from 0), the others in their order, numbered anew. A load order is
    the list that one user keeps, so one task numbers it."""
    from pyspark.sql import Window

    others = order.where(F.col("name") != name).withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("load_order", "name")) - 1)
    rest = others.withColumn("load_order", F.when(F.col("__k") >= position, F.col("__k") + 1).otherwise(F.col("__k")).cast("int")).drop("__k")
    n = others.agg(F.count("*").alias("__n"))
    moved = order.where(F.col("name") == name).crossJoin(F.broadcast(n)).withColumn("load_order", F.least(F.lit(position).cast("long"), F.col("__n")).cast("int")).drop("__n")  # one row
    return rest.unionByName(moved)


def enumerated(spark: SparkSession, root: str, resume_after: str | None = None) -> DataFrame:
    """Every file below ``root`` with its fingerprint, in order of its path: relpath, size, mtime, digest. With
    ``resume_after`` only paths beyond it, so a broken run goes on where it was."""
    prefix = root.rstrip("/").split("://")[-1].replace("file:", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(F.substring_index(F.col("path"), prefix + "/", -1).alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"))
    if resume_after is not None:
        rows = rows.where(F.col("relpath") > resume_after)
    return rows.orderBy("relpath")


def files_of(files: DataFrame, version: int, file_type: str | None = None, column: str = "cvid") -> DataFrame:
    """Live files of a version, of one type if given, in order of their path."""
    from palimpsest.operators.tables import live

    own = live(files).where(F.col(column) == version)
    return (own if file_type is None else own.where(F.col("file_type") == file_type)).orderBy("relpath")


def folder_sources(files: DataFrame, folder: str) -> DataFrame:
    """Script files directly in a folder of each source, in order of source and name."""
    rest = F.substring("relpath", len(folder.rstrip("/")) + 2, 1 << 20)
    return files.where(F.col("relpath").startswith(f"{folder.rstrip('/')}/") & ~rest.contains("/") & rest.endswith(".txt")).orderBy("source", "relpath")


def definitions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Province definitions: province_id, r, g, b, name. Lines whose id is no number, and id 0, are left out."""
    rows = spark.read.option("sep", ";").schema("id string, r int, g int, b int, name string").csv(path)
    return rows.select(F.col("id").try_cast("long").alias("province_id"), "r", "g", "b", "name").where("province_id > 0")


# Folders that a bundle may write to.
TOP_FOLDERS = ("common", "events", "gfx", "gui", "history", "localization", "map_data", "music", "sound")
# End of fixed values.


def validated_bundle(artifacts: DataFrame, tree: DataFrame, allowed: Sequence[str] = TOP_FOLDERS) -> DataFrame:
    """What is wrong with files of a bundle (path, content): path, code, level, line. The first fault of a path counts;
    empty contents and parse errors (from the node table, key = path) are told beside it."""
    path = F.translate("path", "\\", "/")
    parts = F.split(path, "/")
    fault = F.when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "PATH_ABSOLUTE").when(F.array_contains(parts, ".."), "PATH_TRAVERSAL").when(~F.get(parts, F.lit(0)).isin(*allowed), "PATH_TOPLEVEL")
    none = F.lit(None).cast("int")
    paths = artifacts.select("path", fault.alias("code"), F.lit("error").alias("level"), none.alias("line")).where("code IS NOT NULL")
    style = artifacts.where(fault.isNull() & path.endswith("_patched.txt")).select("path", F.lit("NAME_STYLE").alias("code"), F.lit("warning").alias("level"), none.alias("line"))
    empty = artifacts.where(F.coalesce(F.trim("content"), F.lit("")) == "").select("path", F.lit("EMPTY_CONTENT").alias("code"), F.lit("error").alias("level"), none.alias("line"))
    broken = tree.where("error IS NOT NULL").select("path_of_file", F.lit("PARSE_ERROR").alias("code"), F.lit("error").alias("level"), "line").withColumnRenamed("path_of_file", "path")
    return paths.unionByName(style).unionByName(empty).unionByName(broken)


def content_type(path: Column, registry: dict[str, str]) -> Column:
    """The type of a file by the longest folder of a registry (folder to name) that it lies in; null outside all."""
    low = F.lower(F.translate(path, "\\", "/"))
    from palimpsest.functions.rules import first_of

    return first_of([(low.startswith(f"{folder.lower().rstrip('/')}/"), F.lit(name)) for folder, name in sorted(registry.items(), key=lambda x: (-len(x[0]), x[0]))], F.lit(None).cast("string"))
