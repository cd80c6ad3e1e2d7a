"""Stored indexes: postings of words with their places, and trigrams of names, as sorted Parquet tables.

Rows are below one folder for each of ``BUCKETS`` buckets of terms, where keys deal them to files that are sorted by term
and key. A query names its terms' buckets, so Spark lists and opens those folders only, and the terms are pushed down to
row groups. The postings of a term that every text holds are spread over all files of its bucket.

An index grows by segments. A segment is a batch's postings, and the keys that the batch replaces or removes; older
segments are never rewritten, and a query leaves out what a later segment took back. ``merge`` makes one segment of all.

Postings are some four times their texts in a shuffle, so a batch's are none: texts are dealt by key, and what a task makes
of them is a share already. ``merge`` shuffles them, so many buckets at a time that ``ROUND`` rows are on their way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.rules import MATCH_TYPES, first_of
from palimpsest.operators.search import grep_files, patterns
from palimpsest.session import release

WORD = "[a-z0-9]+"
BUCKETS = 64
SENT = 20_000  # postings sent at once
TEXT = 1 << 26  # characters whose postings a task sorts, some 6 million
LEAST = 1 << 20  # characters that are worth a task
SORTED = 4_000_000  # postings that a task of a merge sorts, some 500 MB
ROUND = 64_000_000  # postings that a merge shuffles at once, some 2 GB
FEW = 4_000_000  # keys that may be sent to every task


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _sorted_by(rows: DataFrame, term: str, path: str) -> None:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _dealt(rows.withColumn("bucket", _bucket(F.col(term))), term, path, parts, BUCKETS)


def _dealt(placed: DataFrame, term: str, path: str, parts: int, buckets: int, mode: str = "overwrite") -> None:
    share = F.pmod(F.xxhash64("key"), F.lit(-(-4 * parts // buckets)))  # about four shares a task in all
    _stored(placed.repartition(parts, "bucket", share), term, path, mode)


def _stored(placed: DataFrame, term: str, path: str, mode: str = "overwrite") -> None:
    placed.sortWithinPartitions("bucket", term, "key").write.mode(mode).partitionBy("bucket").parquet(path)


def _of_terms(rows: DataFrame, term: str, wanted: Sequence[str]) -> DataFrame:
    buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in wanted})
    return rows.where(F.col("bucket").isin(*buckets) & F.col(term).isin(*wanted))


# --- words -------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, len, tf, places): each word of each text with its places from 0, and the text's number of words. Keys are
    unique: a text's words meet in its own row, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(b.column(0), b.column(1)):
                words = re.findall(WORD, t.as_py())
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
                for c, of in zip(rows, (places, [k.as_py()] * len(places), [len(words)] * len(places), map(len, places.values()), places.values())):
                    c.extend(of)
                if len(rows[0]) >= SENT:
                    yield out(rows, b.column(0).type)
                    rows = ([], [], [], [], [])
            yield out(rows, b.column(0).type)

    def out(rows: tuple[list, ...], kind: pa.DataType) -> pa.RecordBatch:
        kinds = pa.string(), kind, pa.int64(), pa.int64(), pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["term", "key", "len", "tf", "places"])

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("key"), low.alias("text")).mapInArrow(run, f"term string, key {docs.schema[key].dataType.simpleString()}, len long, tf long, places array<int>")


def _live(rows: DataFrame, gone: DataFrame, few: bool = False) -> DataFrame:
    """Rows that no later segment took back. ``few``: these were counted and are sent to every task."""
    g = gone.select(F.col("key").alias("__key"), F.col("segment").alias("__at"))
    g = F.broadcast(g) if few else g
    return rows.join(g, (F.col("key") == F.col("__key")) & (F.col("segment") < F.col("__at")), "left_anti")


def add_segment(docs: DataFrame, key: str, text: str, root: str, segment: int, removed: DataFrame | None = None) -> None:
    """Index a batch of texts as segment number ``segment`` (from 0, one higher each time) below ``root``.

    Keys that an earlier segment holds are replaced; those of ``removed`` (a column named as ``key``) go. Keys are unique in
    a batch and not null; null texts have no words. Only folders of this segment are written, and written again if the
    batch is run again.
    """
    spark = docs.sparkSession
    at = lambda table: f"{root}/{table}/segment={segment}"
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST + 1)  # a task writes a file a bucket
    parts = max(parts, -(-size // TEXT))
    dealt = docs.select(key, text).repartition(parts, key)  # few and well compressed files make many postings
    _stored(postings(dealt, key, text).withColumn("bucket", _bucket(F.col("term"))), "term", at("postings"))
    del dealt
    release(spark)
    n_words = F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD)).cast("long")
    docs.select(F.col(key).alias("key"), n_words.alias("len")).write.mode("overwrite").parquet(at("texts"))
    texts = spark.read.parquet(at("texts"))
    taken = texts.select("key") if removed is None else texts.select("key").unionByName(removed.select(F.col(key).alias("key"))).distinct()
    if segment:
        earlier = _live(_table(spark, root, "texts", segment), _table(spark, root, "gone", segment))
        gone = earlier.join(taken, "key", "left_semi").select("key", "len")
    else:
        gone = texts.where("false").select("key", "len")
    gone.write.mode("overwrite").parquet(at("gone"))
    both = texts.select(F.lit(1).alias("n"), "len").unionByName(spark.read.parquet(at("gone")).select(F.lit(-1).alias("n"), (-F.col("len")).alias("len")))
    both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).coalesce(1).write.mode("overwrite").parquet(at("totals"))


def _table(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows if before is None else rows.where(F.col("segment") < before)


def live_postings(spark: SparkSession, root: str, terms: Sequence[str]) -> DataFrame:
    """Postings of the terms that count: read from the buckets of those terms only."""
    return _live(_of_terms(_table(spark, root, "postings"), "term", terms), _table(spark, root, "gone"))


def search(spark: SparkSession, root: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of every text that holds a word of the query, by bm25. Equal to ``operators.search.bm25`` over the
    texts, from the postings of the query's words and a row of totals for each segment. A query without words finds
    nothing."""
    terms = sorted(set(re.findall(WORD, query.lower())))
    rows = live_postings(spark, root, terms or [""]).select("term", "key", "len", "tf")
    counts = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    totals = _table(spark, root, "totals").agg(F.sum("texts").alias("n"), (F.sum("words") / F.sum("texts")).alias("mean"))
    told = rows.join(F.broadcast(counts), "term").crossJoin(F.broadcast(totals))  # one row
    tf, df = F.col("tf"), F.col("df")
    score = F.log1p((F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return told.groupBy("key").agg(F.sum(score).alias("score"))


def _moved_by(n: int):
    return lambda place: place - n


def phrase(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(key, n, first): texts that hold the query's words one behind the other, how often, and the first word's first place."""
    words = re.findall(WORD, query.lower())
    rows = live_postings(spark, root, sorted(set(words)) or [""])
    held = rows.groupBy("key").agg(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{i}") for i, w in enumerate(words)])
    starts = F.col("p0") if words else F.array().cast("array<int>")
    for i in range(1, len(words)):
        starts = F.array_intersect(starts, F.transform(F.col(f"p{i}"), _moved_by(i)))
    return held.withColumn("at", starts).where(F.size("at") > 0).select("key", F.size("at").cast("long").alias("n"), F.array_min("at").cast("long").alias("first"))


def merge(spark: SparkSession, root: str, to: str) -> None:
    """All that counts of an index as one segment of a new one, which searches answer alike."""
    gone = _table(spark, root, "gone")
    few = gone.count() <= FEW
    every = _table(spark, root, "postings")
    rounds = min(BUCKETS, max(1, -(-every.count() // ROUND)))
    at_once = -(-BUCKETS // rounds)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if rounds == 1 else max(1, ROUND // SORTED)
    for low in range(0, BUCKETS, at_once):
        rows = every.where(F.col("bucket").between(low, low + at_once - 1))
        _dealt(_live(rows, gone, few).drop("segment"), "term", f"{to}/postings/segment=0", parts, at_once, "append" if low else "overwrite")
        del rows
        release(spark)
    _live(_table(spark, root, "texts"), gone, few).drop("segment").write.mode("overwrite").parquet(f"{to}/texts/segment=0")
    gone.where("false").drop("segment").write.mode("overwrite").parquet(f"{to}/gone/segment=0")
    totals = _table(spark, root, "totals").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))
    totals.write.mode("overwrite").parquet(f"{to}/totals/segment=0")


# --- trigrams ----------------------------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters, in lower case; none in shorter texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def index_grams(rows: DataFrame, key: str, text: str, root: str, keep_text: bool = True) -> None:
    """Postings of the trigrams of a column. ``keep_text``: each with the whole text beside it, for names, so that what is
    found is checked and shown without reading the table; else with the key alone, for long texts. Equal rows count once
    if they have equal keys."""
    own = [F.col(text).alias("text")] if keep_text else []
    _sorted_by(rows.select(F.col(key).alias("key"), *own, F.explode(trigrams(F.col(text))).alias("gram")).distinct(), "gram", root)


def grams_of(pattern: str) -> list[str]:
    """The trigrams that whatever is LIKE ``pattern`` holds."""
    return sorted({piece[i : i + 3] for piece in re.split("[%_]", pattern.lower()) for i in range(len(piece) - 2)})


def _holders(spark: SparkSession, root: str, grams: Sequence[str], columns: Sequence[str]) -> DataFrame:
    hits = _of_terms(spark.read.parquet(root), "gram", grams).select("gram", *columns).distinct()
    return hits.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).drop("n")


def like(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """(key, text) of the indexed names LIKE ``pattern``, whatever the case; None if the pattern has no three characters in
    a row, for which an index of trigrams knows nothing."""
    grams = grams_of(pattern)
    return _holders(spark, root, grams, ["key", "text"]).where(F.col("text").ilike(pattern)) if grams else None


def adjacent(spark: SparkSession, root: str, query: str, names: DataFrame, key: str, column: str, sep: str = "_") -> DataFrame:
    """(key, text, match_type): the names that ``operators.search.adjacent`` finds, from the postings of the patterns'
    trigrams. A pattern of too short pieces needs ``names`` itself, which is read only then."""
    ways = patterns(query, sep)
    found = [like(spark, root, p) for p, _ in ways]
    if any(f is None for f in found):
        rows = names.select(F.col(key).alias("key"), F.col(column).alias("text"))
    else:
        rows = found[0]
        for f in found[1:]:
            rows = rows.unionByName(f)
        rows = rows.distinct()
    low = F.lower("text")
    best = first_of([(low.like(p), F.lit(t)) for p, t in ways], F.lit(None).cast("string"))
    return rows.withColumn("match_type", best).where(F.col("match_type").isin(*MATCH_TYPES))


def grep(docs: DataFrame, key: str, text: str, terms: Sequence[str], root: str) -> DataFrame:
    """``operators.search.grep_files`` over the texts that hold every trigram of every term; where no term has three
    characters, over all."""
    grams = sorted({t.lower()[i : i + 3] for t in terms for i in range(len(t) - 2)})
    if grams:
        docs = docs.join(_holders(docs.sparkSession, root, grams, ["key"]).withColumnRenamed("key", key), key, "left_semi")
    return grep_files(docs, text, terms)
