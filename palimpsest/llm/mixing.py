"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Within a source the documents are dealt into about sqrt(rows) buckets that are
ranges of the key, so a source's order is its buckets' order and, inside a bucket, the key's. The running sum of sizes
is a bucket's offset (a window over bucket totals) plus a window inside the bucket: a distributed prefix sum in which
no task holds a whole source. The budget is cut at its exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import word_count

#: Hex digits of the random key; 52 bits stay exact in a double.
KEY_DIGITS = 13


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """How many words the mix takes of each document.

    Sources in code point order (null last) weigh ``weights`` in turn. Together they get ``share`` times all words;
    a target stops at ``cap`` times its source's words and the excess goes to the others by weight. A source takes
    ``floor(target / words)`` whole passes over its documents; the rest is a prefix of its documents in key order,
    cut inside a document if need be, so a source's words taken equal its rounded target.

    Defined cases: null text has size 0 and takes 0; null source is a source of its own; a source without words has
    target 0; rows without an id get the key of their text; equal keys are ordered by id and size, so equal rows may swap but not
    their sum; an empty table gives
    no rows. With ``carry`` the input row comes along as struct ``row``; otherwise only the columns below are
    returned, so other columns may have any name.

    Returns doc_id, size, source_size, target, passes, taken (and ``row``).
    """
    buckets = max(1, round(docs.count() ** 0.5))
    # Rows without an id are told apart by their text, so that they do not share one key and with it one bucket.
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, KEY_DIGITS), 16, 10).cast("long")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("key"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    ).withColumn("bucket", F.floor(F.col("key") / float(16**KEY_DIGITS) * buckets))

    # One row for each source and bucket; all that follows up to the join is of that size.
    dealt = sized.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    sources = dealt.groupBy("src").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy((F.col("src") == "null").asc(), F.col("src"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("full_at", F.col("source_size") * cap / F.col("weight"))
    before = Window.orderBy("full_at", "src").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    levels = (
        weighed.withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(everywhere) * share)
        .withColumn("level", F.when(F.col("full_before") + F.col("full_at") * F.col("weight_left") >= F.col("budget"), (F.col("budget") - F.col("full_before")) / F.col("weight_left")))
    )
    # The first source, in the order in which they fill up, that the budget does not fill sets the level for all.
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("full_at", "src"))).over(everywhere)
    full = F.col("source_size") * cap
    targets = levels.select("src", "source_size", F.least(full, F.coalesce(level * F.col("weight"), full)).alias("target")).select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("passes")
    )
    up_to = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.select("src", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("offset")).join(targets, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.floor(F.col("target") + 0.5) - F.col("passes") * F.col("source_size")
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return sized.join(offsets, ["src", "bucket"]).select(
        "doc_id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"), *(["row"] if carry else [])
    )
