"""Changes to stored tables as plans over the old rows and the new: upserts, tombstones, cascades, versions.

A stored table is a Parquet folder that a job replaces, so a change is the whole new content as a DataFrame; which rows
are touched is decided by equality joins and grouped maxima, never by a loop over keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], mode: str = "replace") -> DataFrame:
    """The old rows with the new ones: of rows with equal keys, "replace" keeps the new side's greatest by ``order`` and
    "ignore" the old side's row, if it has one, else the new side's least by ``order``. Null keys are one key.

    ``order`` should end in tie-breaks. Both sides have the same columns.
    """
    if mode not in ("replace", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    columns = old.columns
    lead = [F.col(c) for c in order] + [F.col(c) for c in columns if c not in order and c not in key]
    rows = old.withColumn("__side", F.lit(0)).unionByName(new.select(*columns).withColumn("__side", F.lit(1)))
    best = (F.max if mode == "replace" else F.min)(F.struct("__side", *lead)).alias("__w")
    return rows.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col("__w")[c].alias(c) for c in columns])


def live(files: DataFrame, flag: str = "deleted") -> DataFrame:
    """Rows that are not marked as deleted; null is not a mark."""
    return files.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def tombstoned(files: DataFrame, gone: DataFrame, key: Sequence[str], flag: str = "deleted") -> DataFrame:
    """All rows, those whose key is in ``gone`` marked as deleted."""
    marks = gone.select(*key).distinct().withColumn("__gone", F.lit(True))
    return files.join(marks, list(key), "left").withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) | F.coalesce("__gone", F.lit(False))).drop("__gone")


def purged(tables: dict[str, tuple[DataFrame, str | None, Sequence[str]]], root: str, keep: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once the rows of ``root`` outside ``keep`` go, and with them all that hang on those.

    ``tables``: name to (rows, parent table or None, columns shared with the parent), parents before children.
    """
    left = {root: keep}
    for name, (rows, parent, columns) in tables.items():
        if name != root:
            left[name] = rows.join(left[parent].select(*columns).distinct(), list(columns), "left_semi") if parent is not None else rows
    return left


def orphan_counts(counts: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows of each table without a partner, as a dry run of a cleanup: name, n. Pairs are (rows, partners, on)."""
    made = None
    for name, (rows, partners, on) in counts.items():
        row = rows.join(partners.select(*on).distinct(), list(on), "left_anti").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        made = row if made is None else made.unionByName(row)
    return made


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: name, n."""
    made = None
    for name, rows in tables.items():
        row = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        made = row if made is None else made.unionByName(row)
    return made


def versions(roots: DataFrame, known: DataFrame) -> DataFrame:
    """Known content versions and a new one for each root (name, source_path, workshop_id) that none of them matches by
    workshop id, or by path where it has none. The id of a new one is a hash of what identifies it, so a rerun agrees."""
    ident = F.coalesce(F.concat(F.lit("w:"), "workshop_id"), F.concat(F.lit("p:"), F.lower("source_path")))
    fresh = roots.withColumn("__i", ident).groupBy("__i").agg(F.min(F.struct("name", "source_path", "workshop_id")).alias("r"))
    fresh = fresh.join(known.select(ident.alias("__i")).distinct(), "__i", "left_anti")
    return known.unionByName(fresh.select(F.xxhash64("__i").alias("cvid"), "r.name", "r.source_path", "r.workshop_id").select(*known.columns))


def resolved_versions(mods: DataFrame, known: DataFrame) -> DataFrame:
    """Each mod with its content version: the latest of its workshop id, else the latest of its path."""
    path = F.lower(F.translate("source_path", "\\", "/"))
    latest = F.max(F.struct("ingested_at", "cvid"))["cvid"]
    by_id = known.where("workshop_id IS NOT NULL").groupBy("workshop_id").agg(latest.alias("__a"))
    by_path = known.groupBy(path.alias("__p")).agg(latest.alias("__b"))
    told = mods.withColumn("__p", path).join(by_id, "workshop_id", "left").join(by_path, "__p", "left")
    return told.withColumn("cvid", F.coalesce("__a", "__b")).drop("__a", "__b", "__p")


def base_or_enabled(files: DataFrame, order: DataFrame, base: int, source: str = "cvid") -> DataFrame:
    """Files of the base or of an enabled source, each with its load order (the base's is -1): two equality joins in
    place of one on alternatives, of which no row meets both."""
    own = order.where((F.col(source) != base) & F.coalesce(F.col("enabled"), F.lit(True))).groupBy(source).agg(F.max("load_order").alias("load_order"))
    return files.join(own, source).unionByName(files.where(F.col(source) == base).withColumn("load_order", F.lit(-1).cast(own.schema["load_order"].dataType)))


def merged_files(parts: DataFrame, file_no: str = "file_no", pos: str = "pos", name: str = "name") -> DataFrame:
    """Files combined into one: a later file's entry takes the place of an earlier one's of the same name, so every name
    stands where it first stood. Entries without a name all stay."""
    lead = F.struct(file_no, pos)
    same = parts.where(F.col(name).isNotNull())
    rest = [c for c in parts.columns if c not in (file_no, pos, name)]
    one = same.groupBy(name).agg(F.min(lead).alias("place"), F.max(F.struct(file_no, pos, *rest)).alias("w"))
    named = one.select("place", name, *[F.col("w")[c].alias(c) for c in (*rest,)])
    bare = parts.where(F.col(name).isNull()).select(lead.alias("place"), name, *rest)
    return named.unionByName(bare).select(F.col("place")[file_no].alias("first_file"), F.col("place")[pos].alias("first_pos"), name, *rest)
