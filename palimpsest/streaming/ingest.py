"""Incremental ingestion: files arrive as a stream, each fingerprint is worked on once, and a re-run changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.rules import normal_path, route
from palimpsest.sources.files import contents

PER_BATCH = 1000
FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, per_batch: int = PER_BATCH) -> DataFrame:
    """New files below ``root``, at most ``per_batch`` a micro-batch."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).schema(FILE).load(root)


def fingerprints(files: DataFrame) -> DataFrame:
    """Path, route, size and digest of each file that is not skipped."""
    path = normal_path(F.col("path"))
    told = files.select(path.alias("relpath"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), "content")
    return told.withColumn("route", route(F.regexp_extract("relpath", "((?:common|events|history|localization)/.*)$", 1))["route"]).where("route <> 'SKIP'")


def runs(n: int) -> list[tuple[int, int]]:
    """Ranges of batches, from the first, whose digests the first ``n`` batches have in one folder each: a range for each
    binary digit of ``n``, the longest first. Of 1000 batches that is 6 folders."""
    out, at = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


def _run(store: str, span: tuple[int, int]) -> str:
    return f"{store}/digests/run={span[0]}-{span[1]}"


def ingest(stream: DataFrame, store: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run until no file is left. Each micro-batch writes the files and the contents that the store lacks into folders
    named by the batch, replacing them if the batch is run again: exactly once without a transaction log.

    Which contents the store has is asked of its digests, which are merged as batches come: a batch reads a folder for
    each binary digit of its number and writes one, in which the newest of those are merged. Folders are never changed,
    so a batch that is run again finds what it found before.

    ``work``: made of a batch's new contents and written beside them, such as node tables.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        seen = fingerprints(df).persist()
        done = None
        if batch_id > 0:
            known = spark.read.schema("digest string").parquet(*[_run(store, r) for r in runs(batch_id)])
            # A batch holds maxFilesPerTrigger files at most, so its digests go to the store's and the store stays where it is.
            done = known.join(F.broadcast(seen.select("digest").distinct()), "digest", "left_semi")
        fresh = contents(seen, done)
        fresh.write.mode("overwrite").parquet(f"{store}/contents/batch={batch_id}")
        added = spark.read.parquet(f"{store}/contents/batch={batch_id}")
        merged = runs(batch_id + 1)[-1]
        older = [_run(store, r) for r in runs(batch_id) if r[0] >= merged[0]]
        digests = added.select("digest") if not older else added.select("digest").unionByName(spark.read.schema("digest string").parquet(*older))
        # A file for each million digests, and at least one.
        digests.repartition(max(1, (merged[1] - merged[0]) * PER_BATCH // 1_000_000), "digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(_run(store, merged))
        if work is not None:
            work(added).write.mode("overwrite").parquet(f"{store}/work/batch={batch_id}")
        seen.drop("content").write.mode("overwrite").parquet(f"{store}/files/batch={batch_id}")
        seen.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_now(spark: SparkSession, store: str) -> DataFrame:
    """A row for each path: what the last batch that brought the file says of it."""
    rows = spark.read.parquet(f"{store}/files")
    columns = [c for c in rows.columns if c not in ("relpath", "batch")]
    last = rows.groupBy("relpath").agg(F.max(F.struct("batch", *columns)).alias("w"))
    return last.select("relpath", *[F.col("w")[c].alias(c) for c in (*columns, "batch")])


def event_counts(events: DataFrame, time: str, by: str, window: str = "60 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window of event time; works on streams and tables. Rows later than ``late`` are left out of a stream."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, window, slide or window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with gaps of less than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_of_each(events: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each fingerprint once, as long as its repeats come within ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
