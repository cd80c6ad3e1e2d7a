"""Tables stored by content digest: contents, trees, symbols, references and files are written into the same number of
buckets of the same key, sorted in each, so that joins on it neither shuffle nor sort either side again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 32


def store(df: DataFrame, name: str, by: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table of the warehouse in buckets of ``by``, replaced if it is there, and read back. One task a bucket
    writes, so that a bucket is a file; rows with a null key share a bucket."""
    df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return df.sparkSession.table(name)


def defined_in(symbols: DataFrame, trees: DataFrame, files: DataFrame, versions: DataFrame, digest: str = "digest") -> DataFrame:
    """Symbols (or references) with every file that holds their content, and that file's version: the trees and files are
    met on the digest, by bucket; versions are few and met on their id."""
    return symbols.join(trees.select(digest), digest).join(files, digest).join(versions, "cvid")


def unparsed(contents: DataFrame, trees: DataFrame, digest: str = "digest") -> DataFrame:
    """Contents without a tree."""
    return contents.join(trees.select(digest), digest, "left_anti")


def orphaned(contents: DataFrame, files: DataFrame, digest: str = "digest") -> DataFrame:
    """Contents that no file holds any more."""
    return contents.join(files.select(digest), digest, "left_anti")


def drop(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
