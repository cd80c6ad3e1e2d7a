"""Rules and learned facts over the node table: each is a plan from nodes to findings, so a rule of one's own is too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _finding(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.select(key, F.lit(rule).alias("rule"), "path", "line", F.col("n").cast("long").alias("n"))


def duplicate_keys(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Keys that a block assigns more than once: path of the first, its line, how often."""
    own = tree.where((F.col("node_type") == "assignment") & (F.col("depth") > 0))
    groups = own.groupBy(key, "parent_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("node_id", "path", "line")).alias("w")).where("n > 1")
    return _finding(groups.select(key, "w.path", "w.line", "n"), "duplicate_key", key)


def empty_blocks(tree: DataFrame, key: str = "digest") -> DataFrame:
    children = tree.where("parent_id IS NOT NULL").select(key, F.col("parent_id").alias("node_id")).distinct()
    rows = tree.where("node_type = 'block'").join(children, [key, "node_id"], "left_anti").withColumn("n", F.lit(1))
    return _finding(rows, "empty_block", key)


def deprecated(tree: DataFrame, names: Sequence[str], key: str = "digest") -> DataFrame:
    return _finding(tree.where(F.col("key").isin(*names)).withColumn("n", F.lit(1)), "deprecated", key)


def missing_keys(tree: DataFrame, names: Sequence[str], key: str = "digest") -> DataFrame:
    """Top-level blocks without one of the required keys: one finding for each block, n: how many it lacks."""
    has = tree.where((F.col("depth") == 1) & F.col("key").isin(*names)).groupBy(key, F.col("top_id").alias("node_id")).agg(F.count_distinct("key").alias("k"))
    rows = tree.where("depth = 0 AND node_type = 'block'").join(has, [key, "node_id"], "left").withColumn("n", F.lit(len(names)) - F.coalesce("k", F.lit(0).cast("long")))
    return _finding(rows.where("n > 0"), "missing", key)


def edges(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct edges between top-level blocks: one uses another as a value, or calls it as a key."""
    defined = tree.where("depth = 0 AND node_type = 'block'").select(F.col("key").alias("target")).distinct()
    heads = tree.where("depth = 0 AND node_type = 'block'").select(key, "top_id", F.col("key").alias("source"))
    inner = tree.where("depth > 0")
    used = inner.where("value IS NOT NULL").select(key, "top_id", F.lit("uses").alias("relation"), F.col("value").alias("target"))
    called = inner.where("key IS NOT NULL").select(key, "top_id", F.lit("calls").alias("relation"), F.col("key").alias("target"))
    return used.unionByName(called).join(defined, "target", "left_semi").join(heads, [key, "top_id"]).select("source", "relation", "target").distinct()


def keys_by_context(tree: DataFrame, contexts: Sequence[str], key: str = "digest") -> DataFrame:
    """Keys directly inside blocks of the given names, with the number of contents that use them so."""
    around = F.get("ancestors", F.size("ancestors") - 1)
    each = tree.where(F.col("key").isNotNull() & around.isin(*contexts)).groupBy(around.alias("context"), "key", key).count()
    return each.groupBy("context", "key").agg(F.count("*").alias("n_files"))
