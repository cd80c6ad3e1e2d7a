"""Registered queries over stored indexes, each beside SQL that scans the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import index as I
from palimpsest.operators.search import patterns
from palimpsest.plans.registry import query
from palimpsest.session import shared_folder, table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def _indexed(spark: SparkSession, sf: str) -> str:
    root = shared_folder(spark, "words")
    I.add_segment(_texts(spark, sf), "doc_id", "text", root, 0)
    return root


def bm25_sql(words: list[str], rows: str) -> str:
    """bm25 over ``rows`` (doc_id, text) for words of letters and digits."""
    count = lambda w: f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9]+', '  ', 'g') || ' ', ' {w} '))"
    tf = ", ".join(f"{count(w)}::DOUBLE AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    part = lambda i: f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END"
    return f"""WITH r AS ({rows}), c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len, {tf} FROM r), t AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM c)
SELECT doc_id, round({' + '.join(part(i) for i in range(len(words)))}, 6) AS score FROM c, t WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(words)))}"""


ALL_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query(bm25_sql(["license", "rights"], ALL_TEXTS))
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a word of the query, scored from its stored postings."""
    return I.search(spark, _indexed(spark, sf), "Rights, license").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


CHANGED = """SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'license moved ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents WHERE source IS NULL OR source NOT LIKE '%2'"""


@query(bm25_sql(["license", "moved"], CHANGED))
def index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same after a second segment that replaces the documents of some sources and removes those of others, and after
    both are merged."""
    root, merged = _indexed(spark, sf), shared_folder(spark, "merged")
    texts = _texts(spark, sf)
    changed = texts.where(F.col("source").like("%1")).withColumn("text", F.concat(F.lit("license moved "), F.coalesce("text", F.lit(""))))
    I.add_segment(changed, "doc_id", "text", root, 1, removed=texts.where(F.col("source").like("%2")))
    I.merge(spark, root, merged)
    return I.search(spark, merged, "license moved").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), '  ') || ' ' AS words FROM documents),
  h AS (SELECT doc_id, words, ' all  rights  reserved ' AS p FROM t)
  SELECT doc_id, ((length(words) - length(replace(words, p, ''))) // length(p))::BIGINT AS n, (len(regexp_extract_all(words[1:strpos(words, p)], '[a-z0-9]+')))::BIGINT AS first FROM h WHERE strpos(words, p) > 0""")
def index_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a phrase, from the places of its words."""
    return I.phrase(spark, _indexed(spark, sf), "All rights reserved").select(F.col("key").alias("doc_id"), "n", "first")


def _case(column: str, q: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({column}) LIKE '{p}' THEN '{t}'" for p, t in patterns(q, " ")) + " END"


@query(f"SELECT * FROM (SELECT p_partkey AS key, p_name AS text, {_case('p_name', 'small ring')} AS match_type FROM part) WHERE match_type IS NOT NULL")
def index_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """Part names near a query, from the trigrams of its patterns."""
    root, parts = shared_folder(spark, "grams"), table(spark, sf, "part")
    I.index_grams(parts, "p_partkey", "p_name", root)
    return I.adjacent(spark, root, "small ring", parts, "p_partkey", "p_name", " ")


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example.net/en/%' AND lower(url) LIKE '%7%'")
def index_like(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by an infix of their address."""
    root = shared_folder(spark, "grams")
    I.index_grams(table(spark, sf, "pages"), "page_id", "url", root)
    found = I.like(spark, root, "%example.net/en/%")
    return found.where(F.lower("text").contains("7")).select(F.col("key").alias("page_id"), F.col("text").alias("url"))
