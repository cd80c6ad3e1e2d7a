"""Cascades of log records: which record is the root of many others, which are its children, and the marks of each.

Three patterns are looked for, one after the other, and their cascades numbered in that order: a script error and what
goes wrong close to it, a file that cannot be decoded and what its mod reports later, one message again and again. A
record may be in several; the cascade found last names it, which is the greatest number, so marks are a grouped maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordered import latest_before, later_counts, near, positions
from palimpsest.session import shared_folder, tasks

# Categories, thresholds and confidences of the patterns.
SCRIPT_ROOT, MOD_ROOT = "script_system_error", "encoding_error"
SCRIPT_CHILDREN = ("missing_reference", "scope_error", "event_error")
PATTERNS = ("script_parse_cascade", "mod_load_cascade", "repeated_error_spam")
BEFORE, AFTER, SECONDS = 50, 149, 5
LEAST = (3, 5, 10)  # children near, children later, records alike
MANY = 10  # children from which a script error is sure to be a root
CONFIDENCE = (0.6, 0.8, 0.9, 1.0)
# End of fixed values.

BUCKET = 4096  # places, or seconds, that one task numbers or looks back over
MARKED = 250_000  # records whose marks one task reduces


def _numbered(found: DataFrame) -> DataFrame:
    """Cascades (file, kind, record) numbered from 1 in each file, in two levels."""
    placed = positions(found.withColumn("bucket", F.struct("file", "kind", F.floor(F.col("record") / BUCKET))), "bucket", ["record"], "place").drop("bucket")
    first = placed.groupBy("file").agg(F.min("place").alias("first"))
    return placed.join(first, "file").withColumn("cascade_group", F.col("place") - F.col("first") + 1).drop("place", "first")


def _close(roots: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of a script error (columns with root_ in front) and what goes wrong close to it."""
    own = F.coalesce("script_file", F.lit(""))
    pairs = near(roots, others, "record", BEFORE, AFTER, by=["file"])
    return pairs.where((F.abs(F.col("second") - F.col("root_second")) <= SECONDS) & ((own == "") | (own == F.col("root_script_file"))))


def find(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cascades of log records, and marks of the records in them.

    ``records``: file, record (place in the file), second (null: no time, in no cascade by time), category, mod_id,
    source, script_file, signature. Rows are read several times, so give a stored table.

    Returns (file, cascade_group, pattern, record of the root, n_children, confidence) and (file, record, is_root,
    is_child, cascade_group). No records, no cascades.
    """
    slim = records.select("file", "record", F.col("second").cast("long").alias("second"), "category", "mod_id", "script_file", F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce("signature", F.lit(""))).alias("alike"))
    timed = slim.where("second IS NOT NULL")

    # What goes wrong close to a script error, in the same file of script or in none.
    columns = ["file", "record", "second", "script_file"]
    errors, wrong = timed.where(F.col("category") == SCRIPT_ROOT).select(*columns), timed.where(F.col("category").isin(*SCRIPT_CHILDREN)).select(*columns)
    script = _close(errors, wrong).groupBy("file", F.col("root_record").alias("record")).agg(F.count("*").alias("n_children")).where(F.col("n_children") >= LEAST[0])

    # What a mod reports after one of its files could not be decoded.
    of_mod = timed.where("mod_id IS NOT NULL").withColumn("mod", F.struct("file", "mod_id")).withColumn("bucket", F.floor(F.col("second") / BUCKET))
    later = later_counts(of_mod, "mod", "second", f"category = '{MOD_ROOT}'", "true", "bucket").where(F.col("n_later") >= LEAST[1])

    # The same message, but for its numbers, of the same source.
    alike = slim.groupBy("file", "alike").agg(F.min("record").alias("record"), F.count("*").alias("n")).where(F.col("n") >= LEAST[2])

    of = lambda df, kind, n: df.select("file", F.lit(kind).alias("kind"), "record", n.alias("n_children"))
    numbered = _numbered(of(script, 0, F.col("n_children")).unionByName(of(later, 1, F.col("n_later"))).unionByName(of(alike, 2, F.col("n") - 1)))
    path = shared_folder(records.sparkSession, "cascades")  # read five times
    numbered.write.parquet(path)
    found = records.sparkSession.read.parquet(path)
    sure = F.when(F.col("kind") == 2, CONFIDENCE[3]).when(F.col("kind") == 1, CONFIDENCE[2]).when(F.col("n_children") >= MANY, CONFIDENCE[1]).otherwise(CONFIDENCE[0])

    root = lambda kind: found.where(F.col("kind") == kind).select("file", F.col("record").alias("root_record"), "cascade_group")
    mark = lambda df, is_root: df.select("file", "record", "cascade_group", F.lit(is_root).alias("is_root"))
    # Pairs are made again, of errors that are roots, with their numbers: a child's pairs meet in one block and are reduced there.
    in_scripts = errors.join(root(0).withColumnRenamed("root_record", "record"), ["file", "record"])
    close = _close(in_scripts, wrong).groupBy("file", "record").agg(F.max("root_cascade_group").alias("cascade_group"))
    in_mods = of_mod.drop("bucket").join(root(1).withColumnRenamed("root_record", "record"), ["file", "record"]).select("mod", "second", "cascade_group")
    after = latest_before(of_mod.select("file", "record", "mod", "second"), in_mods, "mod", "second", "cascade_group", BUCKET, "cascade_group").where("cascade_group IS NOT NULL")
    repeated = slim.select("file", "record", "alike").join(alike.select("file", "alike", F.col("record").alias("root_record")), ["file", "alike"]).where("record <> root_record").join(root(2), ["file", "root_record"])
    marks = mark(found, True).unionByName(mark(close, False)).unionByName(mark(after, False)).unionByName(mark(repeated, False))
    parts = tasks(records, rows=MARKED)
    if parts > int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marks = marks.repartition(parts, "file", "record")  # few records have one mark only, so nothing is reduced before
    told = marks.groupBy("file", "record").agg(F.bool_or("is_root").alias("is_root"), F.bool_or(~F.col("is_root")).alias("is_child"), F.max("cascade_group").alias("cascade_group"))
    name = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), F.col("kind") + 1)
    return found.select("file", "cascade_group", name.alias("pattern"), "record", "n_children", sure.alias("confidence")), told


def marked(records: DataFrame) -> DataFrame:
    """The records with is_root, is_child (false outside cascades) and cascade_group (null outside)."""
    _, marks = find(records)
    told = records.join(marks, ["file", "record"], "left")
    return told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_root", "is_child")})
