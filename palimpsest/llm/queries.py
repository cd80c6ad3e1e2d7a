"""The operators applied to their whole tables, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 at 150 % of their words."""
    from palimpsest.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).drop("passes")


ORACLES["op5_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS key
  FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS k
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM weighed),
levels AS (
  SELECT *, coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS full_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM filled WINDOW w AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((budget - full_before) / weight_left, (full_at, k)) AS level FROM levels
  WHERE full_before + full_at * weight_left >= budget),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(level * weight, source_size * 2.0::DOUBLE)) AS target
  FROM levels, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - passes * source_size - start)))::BIGINT AS taken
FROM placed
"""


@query
def op4_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as FLAC, decoded again into PCM blocks, from which digests and features are taken."""
    from palimpsest.llm.flac import encode_media, media_features

    return media_features(encode_media(table(spark, sf_dir, "documents")))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own control strings, formatted and read back."""
    from palimpsest.llm.chat import format_chat, read_back

    trap = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.unionByName(more)))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each whole document encoded once."""
    from palimpsest.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    from palimpsest.llm.langid import fit, identify
    from palimpsest.llm.shared import crc_mod

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose crc32(doc_id) mod 3 is not 1."""
    from palimpsest.llm.quality import fit, score_quality
    from palimpsest.llm.shared import crc_mod

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1).select("doc_id", "quality")
    model = fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's trigram stupid-backoff score under all other documents."""
    from palimpsest.llm.ngram_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, by latent semantic retrieval and common subsequences."""
    from palimpsest.llm.decontaminate import find_contaminated

    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 80 % Jaccard similarity of 5-word shingles."""
    from palimpsest.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 400-byte strings that occur twice."""
    from palimpsest.llm.substring_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, entries filtered by segment-mean bounds."""
    from palimpsest.llm.vector_codes import coded_table

    return coded_table(table(spark, sf_dir, "embeddings"))


def _assigned(k: int) -> str:
    return f"""
a{k} AS (
  SELECT p.vec_id, p.part, min_by(b.entry, (d.dist, b.entry)) AS entry, min(d.dist) AS dist
  FROM parts p JOIN book{k} b USING (part),
       LATERAL (SELECT (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2 + (p.x4 - b.x4) ** 2 AS dist) d
  GROUP BY p.vec_id, p.part)"""


def _moved(k: int) -> str:
    mean = ", ".join(f"coalesce(floor(m.s{i}::DOUBLE / m.n)::BIGINT, b.x{i}) AS x{i}" for i in range(1, 5))
    sums = ", ".join(f"sum(p.x{i}) AS s{i}" for i in range(1, 5))
    return f"""
book{k + 1} AS (
  SELECT b.part, b.entry, {mean}
  FROM book{k} b LEFT JOIN (
    SELECT part, entry, count(*) AS n, {sums} FROM parts p JOIN a{k} USING (vec_id, part) GROUP BY part, entry) m USING (part, entry))"""


ORACLES["op11_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, part, q[part * 4 + 1] AS x1, q[part * 4 + 2] AS x2, q[part * 4 + 3] AS x3, q[part * 4 + 4] AS x4
  FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS (
  SELECT part, entry, x1, x2, x3, x4
  FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and piece tokens of all documents."""
    from palimpsest.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), as_digest=True)


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose SimHash fingerprints differ in three bits or fewer."""
    from palimpsest.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))
