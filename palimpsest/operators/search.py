"""Finding names and lines: adjacency patterns, grep, snippets, ranked search over postings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.rules import MATCH_TYPES, first_of


def patterns(query: str, sep: str = "_") -> list[tuple[str, str]]:
    """LIKE patterns of a query, each with its match type, in the order of ``MATCH_TYPES``."""
    q = query.lower().strip()
    found = {"exact": q, "prefix": f"{q}%", "suffix": f"%{q}", "contains": f"%{q}%"}
    words = q.split(sep)
    if len(words) > 1:
        found |= {"stem": sep.join(words[:-1]) + "%", "suffix_tokens": "%" + sep.join(words[1:]), "flex_underscore": "%" + "%".join(words) + "%"}
    return [(found[t], t) for t in MATCH_TYPES if t in found]


def adjacent(names: DataFrame, column: str, query: str, sep: str = "_") -> DataFrame:
    """Rows whose name matches the query in any way, with the best way as match_type: one scan, one CASE."""
    low = F.lower(F.col(column))
    best = first_of([(low.like(p), F.lit(t)) for p, t in patterns(query, sep)], F.lit(None).cast("string"))
    return names.withColumn("match_type", best).where("match_type IS NOT NULL")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term, whatever the case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")


def grep_files(docs: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose text holds every term, with the number of occurrences of all of them."""
    low = F.lower(F.col(text))
    for t in terms:
        docs = docs.where(low.contains(t.lower()))
    return docs.withColumn("n_occurrences", sum((occurrences(F.col(text), t) for t in terms[1:]), occurrences(F.col(text), terms[0])))


def grep_lines(docs: DataFrame, key: str, text: str, terms: Sequence[str], most: int | None = None, before: int = 30, after: int = 50) -> DataFrame:
    """Lines that hold any term: line number from 1 and the text around its first match. ``most``: lines of a document,
    as a feature of the report. Lines are taken inside the row, so nothing is shuffled."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("value")))
    low = lambda x: F.lower(x["value"])
    any_term = lambda x: sum((low(x).contains(t.lower()).cast("int") for t in terms[1:]), low(x).contains(terms[0].lower()).cast("int")) > 0
    hits = F.filter(lines, any_term)
    if most is not None:
        hits = F.slice(hits, 1, most)
    row = docs.select(key, F.explode(hits).alias("hit")).select(key, F.col("hit.line").cast("long").alias("line"), F.col("hit.value").alias("value"))
    places = [F.nullif(F.instr(F.lower("value"), t.lower()), F.lit(0)) for t in terms]
    at = F.least(*places) if len(places) > 1 else places[0]
    return row.select(key, "line", snippet(F.col("value"), at, before, after).alias("snippet"))


def snippet(text: Column, at: Column, before: int, after: int) -> Column:
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start.cast("int"), (at + after - start).cast("int"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Score of every document that holds a term of the query.

    Two scans, one for the counts of documents and one for the scores: each yields a document's length and its counts of
    the few query terms as columns, so postings of other terms are never made. The counts are one row, joined back.
    """
    words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    if not words:
        return docs.where("false").select(key, F.lit(0.0).alias("score"))
    low = F.lower(F.col(text))
    count = lambda w: F.regexp_count(low, F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])")).cast("long")
    listed = docs.select(F.col(key), F.regexp_count(low, F.lit("[a-z0-9]+")).cast("long").alias("len"), *[count(w).alias(f"tf{i}") for i, w in enumerate(words)])
    totals = listed.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    held = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log1p((F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return listed.where(held).crossJoin(F.broadcast(totals)).select(key, score.alias("score"))  # one row on the right


def filtered(df: DataFrame, wanted: dict[str, object], columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows by a table of wishes: equality; LIKE without case where a text holds %; ``_gte`` and ``_lte`` for ranges; a truth
    value also meets 0 and 1 in a column of numbers. ``limit`` is the answer's length, as a feature of the view."""
    kinds = dict(df.dtypes)
    for name, value in wanted.items():
        if name not in kinds and name.endswith("_gte"):
            df = df.where(F.col(name[:-4]) >= value)
        elif name not in kinds and name.endswith("_lte"):
            df = df.where(F.col(name[:-4]) <= value)
        elif isinstance(value, bool) and kinds[name] != "boolean":
            df = df.where(F.col(name) == int(value))
        elif isinstance(value, str) and "%" in value:
            df = df.where(F.col(name).ilike(value))
        else:
            df = df.where(F.col(name) == value)
    if columns is not None:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def tagged(scope: str, df: DataFrame, key: str, label: str) -> DataFrame:
    """One branch of a search over several tables."""
    return df.select(F.lit(scope).alias("scope"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))


def ranked(docs: DataFrame, key: str, text: str, path: str, query: str, top: int = 20, context: int = 60) -> DataFrame:
    """The best documents by bm25, one for each path (its best, ties by key), with the text around the first of the
    query's words. ``top`` is the answer's length."""
    scored = bm25(docs, key, text, query)
    words = [w for w in query.lower().split() if w]
    places = [F.nullif(F.instr(F.lower(F.col(text)), w), F.lit(0)) for w in words]
    at = F.least(*places) if len(places) > 1 else places[0]
    rows = docs.join(scored, key).select(key, path, "score", snippet(F.col(text), F.coalesce(at, F.lit(1)), context // 2, context // 2).alias("snippet"))
    best = rows.groupBy(path).agg(F.max(F.struct("score", F.col(key).alias("k"), "snippet")).alias("w"))
    return best.select(path, F.col("w.k").alias(key), F.col("w.score").alias("score"), F.col("w.snippet").alias("snippet")).orderBy(F.desc("score"), path).limit(top)


def merged_scopes(scopes: dict[str, DataFrame], key: str, top: int = 20) -> DataFrame:
    """Scored rows (key, score) of several searches in one list, the most relevant first."""
    made = None
    for scope, rows in scopes.items():
        part = rows.select(F.lit(scope).alias("scope"), F.col(key).cast("string").alias("key"), "score")
        made = part if made is None else made.unionByName(part)
    return made.orderBy(F.desc("score"), "scope", "key").limit(top)


def grep_raw(lines: DataFrame, query: str, is_regex: bool = False, path: str = "file", pattern: str | None = None, text: str = "text") -> DataFrame:
    """Lines that hold a text or match a pattern, whatever the case, in files whose path is LIKE ``pattern`` if given."""
    if pattern is not None:
        lines = lines.where(F.col(path).ilike(pattern))
    return lines.where(F.col(text).rlike(f"(?i){query}") if is_regex else F.lower(text).contains(query.lower()))


def with_tags(rows: DataFrame, tags: str, wanted: Sequence[str], text: str | None = None, part: str = "") -> DataFrame:
    """Rows whose array ``tags`` holds every wanted tag, and whose ``text``, if given, holds ``part`` whatever the case."""
    for t in wanted:
        rows = rows.where(F.array_contains(tags, t))
    return rows if text is None else rows.where(F.lower(text).contains(part.lower()))
