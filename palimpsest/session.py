"""Session settings and table access shared by every query."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

ROWS = 1_000_000  # rows that one task sorts or joins, some 300 MB


def session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC time and ANSI SQL; ``conf`` adds to or overrides these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables, read through Spark whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(*tables: DataFrame, rows: int = ROWS) -> int:
    """To how many tasks tables that meet in one step are dealt: the session's number of shuffle partitions, more where a
    task would get over ``rows`` rows. Tables are counted, so give stored ones, or columns of such."""
    n = sum(t.count() for t in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))


def dealt(key: Sequence[str], *tables: DataFrame, rows: int = ROWS) -> list[DataFrame]:
    """Tables that are to meet by ``key``, dealt to more tasks than the session's where those would get over ``rows`` rows,
    so that a task's memory does not grow with the tables. Smaller tables are returned as they are."""
    n = tasks(*tables, rows=rows)
    if n <= int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return list(tables)
    return [t.repartition(n, *key) for t in tables]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints that nothing refers to any more. Its cleaner waits for the
    driver's garbage collection, for which a driver that only plans has little cause; here that is done between steps,
    as ``spark.cleaner.periodicGC.interval`` does it by the clock."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stored tables where driver and executors both see it: below the session's checkpoint folder, or
    below the warehouse where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
