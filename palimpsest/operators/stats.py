"""Counts, rates and checks over stored tables; all are partial aggregations, joined back where a row is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(files: DataFrame, digest: str, file_id: str, size: str) -> DataFrame:
    """Each distinct content once: digest, n_files, first (least file id), size."""
    return files.groupBy(digest).agg(F.count("*").alias("n_files"), F.min(file_id).alias("first"), F.max(size).alias("size"))


def root_hash(files: DataFrame, source: str, path: str, digest: str) -> DataFrame:
    """Identity of a source's state, whatever the order of its files: a tree of two levels, so no task holds a source.
    Returns source, root_hash, n_files."""
    rows = files.select(source, F.substring(F.sha2(path, 256), 1, 4).alias("bucket"), F.struct(F.col(path).alias("path"), F.col(digest).alias("digest")).alias("f"))
    leaf = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: F.concat(x["path"], x["digest"])), ""), 256)
    leaves = rows.groupBy(source, "bucket").agg(leaf.alias("h"), F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")
    return leaves.groupBy(source).agg(F.sha2(joined, 256).alias("root_hash"), F.sum("n").alias("n_files"))


def flat_root_hash(files: DataFrame, source: str, path: str, digest: str) -> DataFrame:
    """The same as one hash over all (path, digest) in order of the path's lower case, for sources whose manifest fits a
    row; it equals hashes made so elsewhere. Returns source, root_hash, n_files."""
    entry = F.struct(F.lower(path).alias("k"), F.col(path).alias("path"), F.col(digest).alias("digest"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.concat(x["path"], x["digest"])), "")
    return files.groupBy(source).agg(F.sha2(whole, 256).alias("root_hash"), F.count("*").alias("n_files"))


def branch_totals(tree: DataFrame, rows: DataFrame, on: str, by: Sequence[str], value: str) -> DataFrame:
    """Rows and their sum under each branch of a hierarchy; rows are summed by leaf before they are joined."""
    own = rows.groupBy(on).agg(F.count("*").alias("__n"), F.sum(value).alias("__v"))
    return tree.join(own, on, "left").groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("total"))


def seen(rows: DataFrame, by: Sequence[str], distinct: str, time: str) -> DataFrame:
    """Rows, distinct values of a column, first and last time, by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def outliers(rows: DataFrame, value: str, least_rows: int = 100, least_z: float = 2.0) -> DataFrame:
    """Rows whose value lies ``least_z`` sample deviations above the mean, with z; none below ``least_rows`` rows."""
    stats = rows.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count("*").alias("__n"))
    z = (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(stats)).where((F.col("__n") >= least_rows) & (z >= least_z)).withColumn("z", z).drop("__m", "__s", "__n")  # one row on the right


def summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"))


def coverage(rows: DataFrame, done: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """How many rows of each group have a partner, and per cent of them, to one place."""
    known = done.select(on, F.lit(1).alias("__seen")).distinct()
    joined = rows.join(known, on, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count("__seen").alias("n_covered"), F.round(100.0 * F.count("__seen") / F.count("*"), 1).alias("pct"))


def readiness(sources: DataFrame, files: DataFrame, on: str, pending: str) -> DataFrame:
    """Each source as missing (no files), ready (none pending), not_indexed (all pending) or pending."""
    counts = files.groupBy(on).agg(F.count("*").alias("__n"), F.count_if(pending).alias("__p"))
    n, p = F.col("__n"), F.col("__p")
    status = F.when(n.isNull(), "missing").when(p == 0, "ready").when(p == n, "not_indexed").otherwise("pending")
    zero = F.lit(0).cast("long")
    return sources.join(counts, on, "left").select(*sources.columns, F.coalesce(n, zero).alias("n_files"), F.coalesce(p, zero).alias("n_pending"), status.alias("status"))


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def lacking(files: DataFrame, entries: DataFrame, on: str, required: Column) -> DataFrame:
    """Files with entries but without a required one: one grouped pass, then a semi join."""
    without = entries.groupBy(on).agg(F.max(required).alias("__has")).where("NOT __has")
    return files.join(without, on, "left_semi")


def counts_by(rows: DataFrame, by: str) -> DataFrame:
    """Rows by kind, the most frequent first, ties by name."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def tree_stats(contents: DataFrame, tree: DataFrame, key: str = "digest") -> DataFrame:
    """One row: contents, those that parsed without an error, those that did not, and their nodes."""
    each = tree.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    told = contents.select(key).distinct().join(each, key, "left")
    return told.agg(F.count("*").alias("n_contents"), F.count_if(F.col("bad") == 0).alias("n_ok"), F.count_if((F.col("bad") > 0) | F.col("bad").isNull()).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_nodes"))


def children(files: DataFrame, path: str, folder: str = "") -> DataFrame:
    """Immediate children of a folder: name, is_folder, number of files."""
    lead = f"{folder.rstrip('/')}/" if folder else ""
    rest = F.substring(path, len(lead) + 1, 1 << 20)
    return files.where(F.col(path).startswith(lead) & (rest != "")).groupBy(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_folder")).agg(F.count("*").alias("n"))


def build_status(stages: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """How far each stage has come: stage, n (rows it should cover), n_done, pct. Stages are (rows, done, on); stages
    without a row are complete."""
    made = None
    for name, (rows, done, on) in stages.items():
        seen = done.select(*on).distinct().withColumn("__d", F.lit(1))
        row = rows.select(*on).distinct().join(seen, list(on), "left").agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.count("__d").alias("n_done"))
        made = row if made is None else made.unionByName(row)
    return made.withColumn("pct", F.coalesce(F.round(100.0 * F.col("n_done") / F.nullif(F.col("n"), F.lit(0).cast("long")), 1), F.lit(100.0)))


def recommended(counts: DataFrame, actions: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """What to do next, the most urgent first: of the actions (name of a count, priority, phase, action) those whose count
    in ``counts`` (name, n) is above 0. Counts that belong to one action add up."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(a[0], a[1], a[2], a[3]) for a in actions], "name string, priority int, phase string, action string")
    return counts.join(F.broadcast(known), "name").groupBy("priority", "phase", "action").agg(F.sum("n").alias("n")).where("n > 0").orderBy("priority")  # the fixed table


def health(items: DataFrame, status: str, started: str, now: Column, stale_seconds: int = 300) -> DataFrame:
    """One row: items by state, those still in work, and those in work for too long."""
    age = F.unix_timestamp(now) - F.unix_timestamp(started)
    working = F.col(status) == "processing"
    return items.agg(F.count("*").alias("n"), F.count_if(F.col(status) == "pending").alias("n_pending"), F.count_if(working).alias("n_processing"), F.count_if(working & (age > stale_seconds)).alias("n_stale"), F.count_if(F.col(status) == "error").alias("n_error"))


def version_stats(files: DataFrame, contents: DataFrame, version: str, digest: str, size: str) -> DataFrame:
    """Files, distinct contents and their bytes of each version."""
    each = files.groupBy(version, digest).agg(F.count("*").alias("__n")).join(contents.select(digest, size), digest, "left")
    return each.groupBy(version).agg(F.sum("__n").alias("n_files"), F.count("*").alias("n_contents"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("n_bytes"))
