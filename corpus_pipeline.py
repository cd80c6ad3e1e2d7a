"""From raw documents to a weighted training mix: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. A stage's output is a table in the shared folder, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.jaccard import near_duplicates
from palimpsest.llm.langid import UNDECIDED, fit, identify
from palimpsest.llm.mixing import mix_sources
from palimpsest.llm.shared import cut, release, row_key, shared_dir, word_count
from palimpsest.llm.substring_dedup import remove_repeats
from palimpsest.session import table

#: Bytes of a repeated passage. Of the 51-word passages of sf0.1, 98.6 % have as many (5.5 % have op1's 400).
PASSAGE = 250
#: The languages that stay, None for all that the labels teach.
LANGUAGES: tuple[str, ...] | None = None
#: How far the score of a text of ``JUDGED`` words or more must lie between an even choice (0) and certainty (1): among four
#: languages a score of 0.4. On sf0.1 the least of a clean text is 0.51; texts in scripts and languages that were not
#: learned reach 0.28 to 0.38.
MIN_CERTAINTY, JUDGED = 0.2, 10


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model knows the language of, as they are: those that it gives one of ``LANGUAGES`` (None: any
    that it has learned) with a certainty of ``MIN_CERTAINTY`` or more.

    Texts of fewer than ``JUDGED`` words say too little for a score and need the language only. Null texts and texts
    without a letter go. Where ``docs`` has no language to learn from, every text goes. Equal rows go or stay together; an
    empty table gives none.
    """
    model = fit(docs)
    even = 1 / len(model.languages) if model else 1.0
    told = identify(docs, model, carry=True).where(F.col("lang_pred") != UNDECIDED)
    told = told.where((F.col("score") >= even + MIN_CERTAINTY * (1 - even)) | (word_count(F.col("text")) < JUDGED))
    if LANGUAGES is not None:
        told = told.where(F.col("lang_pred").isin(*LANGUAGES))
    return told.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies, the row of the least id, nulls last, and of the least hash among those.

    Rows are told apart by all their columns, so ids may repeat or lack; of equal rows one stays. Texts without a word
    are no copies of each other and all stay. Columns may have any name; an empty table gives no rows.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), row_key(docs).alias("key"))
    place = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), F.col("key"))
    told = near_duplicates(named.select(place.alias("place"), F.col("row.text").alias("text")), id_col="place").where("n_shingles > 0")
    rows = told.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    rows = cut(rows.select(F.col("doc_id.key").alias("key"), (F.col("doc_id") == F.col("component_id")).alias("least"), "n").where("n > 1 OR NOT least"))
    release(spark)  # what told the copies is done with
    kept = named.join(rows, "key", "left_anti")
    equal = rows.where("least").select("key")
    if not equal.isEmpty():
        kept = kept.unionByName(named.join(equal, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")))
    return kept.select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text without the passages of ``PASSAGE`` bytes or more that repeat; a character that a removed run cuts
    becomes U+FFFD. No row goes: a null text stays null, equal rows lose equal passages (all of a text of that length is
    one), an empty table gives none."""
    removed = F.col("n_removed") > 0
    # A row that lost nothing keeps its text, null included.
    text = F.when(removed, F.make_valid_utf8(F.col("kept").cast("string"))).when(~F.col("no_text"), F.col("kept").cast("string"))
    n_chars = F.when(removed, F.length(text).cast("long"))
    done = remove_repeats(docs, length=PASSAGE, carry=True)
    row = lambda c: text if c == "text" else F.coalesce(n_chars, F.col("row.n_chars")).cast("long") if c == "n_chars" else F.col("row")[c]
    return done.select(*[row(c).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or reworded. A null text holds none; equal rows go or stay together;
    without a benchmark item, or without documents, nothing goes."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``taken`` words each: ``passes`` whole readings and a part of the next.

    Null texts and texts without a word take nothing and go; equal rows are rows of their own; an empty table gives none.
    Where ``docs`` has a column of one of the mix's names, the mix's gets ``mix_`` in front.
    """
    mix = mix_sources(docs, carry=True).where("taken > 0")
    names = {}
    for c in ("size", "source_size", "target", "passes", "taken"):
        names[c] = c
        while names[c] in docs.columns:
            names[c] = f"mix_{names[c]}"
    return mix.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in names.items()])


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("mix", mixed),
]

#: No stage but the last can be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
