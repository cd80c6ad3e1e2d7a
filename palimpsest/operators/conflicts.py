"""Conflict groups of names and files between sources, and their summaries. All are partial aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import dealt


def conflicts(defs: DataFrame, key: Sequence[str], source: str, sep: str = ",") -> DataFrame:
    """Keys that more than one source defines: number of sources and definitions, the winning (highest) source, and the
    losing ones, highest first. A key's list is one entry a source: bounded by the load order, not by the rows."""
    sources = F.sort_array(F.collect_set(source), asc=False)
    found = defs.groupBy(*key).agg(sources.alias("__s"), F.count("*").alias("n_definitions")).where(F.size("__s") > 1)
    losing = F.transform(F.slice("__s", 2, F.size("__s") - 1), lambda x: x.cast("string"))
    return found.select(*key, F.size("__s").cast("long").alias("n_sources"), "n_definitions", F.col("__s")[0].alias("winner"), F.array_join(losing, sep).alias("losers"))


def conflict_counts(defs: DataFrame, key: Sequence[str], source: str, by: str) -> DataFrame:
    """How many keys of each group conflict, and how many definitions those have. Two sources show as min < max, which
    needs no set of sources."""
    groups = defs.groupBy(*key, by).agg(F.min(source).alias("__a"), F.max(source).alias("__b"), F.count("*").alias("__n"))
    clash = F.col("__a") < F.col("__b")
    return groups.groupBy(by).agg(F.count_if(clash).alias("n_conflicts"), F.coalesce(F.sum(F.when(clash, F.col("__n"))), F.lit(0)).cast("long").alias("n_definitions"), F.count("*").alias("n_keys"))


def size_delta(files: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """(max - min) / max of the positive sizes of each key; 0 without any."""
    positive = F.when(F.col(size) > 0, F.col(size))
    ratio = (F.max(positive) - F.min(positive)) / F.max(positive)
    return files.groupBy(*key).agg(F.count("*").alias("candidates"), F.coalesce(ratio, F.lit(0.0)).alias("size_delta"))


def compare_manifests(old: DataFrame, new: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Each key of two manifests as new, deleted, changed or same. A key must be unique on each side."""
    a = old.select(*key, F.col(digest).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*key, F.col(digest).alias("__new"), F.lit(True).alias("__in_new"))
    status = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "deleted").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"))


def without(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner: unused symbols, undefined references, orphans, unparsed contents."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def visible(df: DataFrame, column: str, sources: Sequence[int] | None, empty_means: str = "none") -> DataFrame:
    """Rows of the visible sources. None lets all through; an empty list none, or all with ``empty_means="all"``."""
    if sources is None or (not sources and empty_means == "all"):
        return df
    return df.where(F.col(column).isin(*sources)) if sources else df.where(F.lit(False))


def file_conflicts(files: DataFrame, path: str = "relpath", source: str = "source", order: str = "load_order") -> DataFrame:
    """Paths that more than one source has: number of sources and files, the winning source, and whether the file's name
    begins with zzz_, which mods give files that should come last."""
    each = files.groupBy(path, source).agg(F.max(order).alias(order), F.count("*").alias("n"))
    found = each.groupBy(path).agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_files"), F.max(F.struct(order, source)).alias("w")).where("n_sources > 1")
    name = F.lower(F.substring_index(F.col(path), "/", -1))
    return found.select(path, "n_sources", "n_files", F.col("w")[source].alias("winner"), name.startswith("zzz_").alias("is_last_by_name"))


def folder_counts(paths: DataFrame, path: str = "relpath", depth: int = 2, top: int = 20) -> DataFrame:
    """The folders with most rows, by the first ``depth`` parts of their path; a file's own name is no folder. ``top`` is
    the report's length; ties go by name."""
    folder = F.substring_index(F.substring(F.col(path), F.lit(1), F.length(path) - F.length(F.substring_index(F.col(path), "/", -1)) - 1), "/", depth)
    return paths.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(top)


def conflicts_by_policy(defs: DataFrame, key: Sequence[str], source: str, order: str, path: str, name_of_source: str, with_patches: bool = False) -> DataFrame:
    """Names that several sources define, each won by the policy of its first file's folder: the lowest load order under
    "fios", the highest under any other. A name that a compatibility patch also defines is left out unless asked for.

    Returns key, n_sources, policy, winner (source), has_patch.
    """
    from palimpsest.functions.rules import is_compatibility_patch, policy

    each = defs.groupBy(*key, source, name_of_source).agg(F.max(order).alias(order), F.min(path).alias(path))
    told = each.groupBy(*key).agg(
        F.count("*").alias("n_sources"), F.min(F.struct(order, path))[path].alias("first_path"), F.max(F.struct(order, source))[source].alias("last"), F.min(F.struct(order, source))[source].alias("first"), F.max(is_compatibility_patch(F.col(name_of_source))).alias("has_patch")
    ).where("n_sources > 1")
    rule = policy(F.col("first_path"))
    found = told.select(*key, "n_sources", rule.alias("policy"), F.when(rule == "fios", F.col("first")).otherwise(F.col("last")).alias("winner"), "has_patch")
    return found if with_patches else found.where("NOT has_patch")


def enriched(rows: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows with what is known of their key, nulls where nothing is. A null key knows nothing; a key known twice gives
    its row twice. Both are counted first and dealt to as many tasks as that takes, so give stored tables."""
    rows, known = dealt(key, rows, known)
    return rows.join(known, list(key), "left")


def all_names(*tables: DataFrame) -> DataFrame:
    """The rows that any of several tables with equal columns holds, each once."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.distinct()
