"""Asking for names: definitions, references, whether a name exists, which names are like it, and who defines it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.rules import first_of
from palimpsest.operators.search import patterns


def definitions(symbols: DataFrame, name: str, kind: str | None = None, sources: Sequence[int] | None = None, source: str = "cvid") -> DataFrame:
    """Rows that define exactly this name, of a kind and in visible sources if given. No source is visible in an empty list."""
    found = symbols.where(F.col("name") == name)
    if kind is not None:
        found = found.where(F.col("symbol_type") == kind)
    if sources is not None:
        found = found.where(F.col(source).isin(*sources)) if sources else found.where(F.lit(False))
    return found


def exists(symbols: DataFrame, name: str, kind: str | None = None, sources: Sequence[int] | None = None) -> bool:
    return not definitions(symbols, name, kind, sources).isEmpty()


def references_to(refs: DataFrame, names: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """References to any of the found names."""
    return refs.join(names.select(*by).distinct(), list(by), "left_semi")


def confirm_absent(symbols: DataFrame, queries: Sequence[str], similar: int = 20, sep: str = "_") -> DataFrame:
    """For each asked name: how often it is defined, up to ``similar`` names like it (a feature of the report), and whether
    its absence may be claimed: no definition and nothing adjacent.

    One scan whatever the number of queries. Returns query, n_exact, n_similar, similar, absent.
    """
    low = F.lower("name")
    asked = None
    for q in queries:
        near = first_of([(low.like(p.replace("\\", "\\\\")), F.lit(t)) for p, t in patterns(q, sep)], F.lit(None).cast("string"))
        one = F.struct(F.lit(q).alias("query"), near.alias("match"))
        asked = [one] if asked is None else [*asked, one]
    hits = symbols.select("name", F.explode(F.filter(F.array(*asked), lambda x: x["match"].isNotNull())).alias("q"))
    each = hits.groupBy("q.query", "name").agg(F.count("*").alias("n"), F.max(F.col("q.match") == "exact").alias("exact"))
    told = each.groupBy("query").agg(F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("n_exact"), F.count_if(~F.col("exact")).alias("n_similar"))
    # The first names in order, without a list of all: a name's place among its query's.
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy("name"))
    some = each.where("NOT exact").withColumn("i", place).where(F.col("i") <= similar).groupBy("query").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("similar"))
    every = symbols.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    zero = F.lit(0).cast("long")
    counted = every.join(told, "query", "left").join(some, "query", "left")
    n, m = F.coalesce("n_exact", zero), F.coalesce("n_similar", zero)
    return counted.select("query", n.alias("n_exact"), m.alias("n_similar"), F.coalesce("similar", F.lit("")).alias("similar"), ((n == 0) & (m == 0)).alias("absent"))


def validated(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with how many definitions of their name and kind exist, and in how many files of which kinds the name is
    defined at all: resolved, of another kind, or missing."""
    exact = symbols.groupBy("name", F.col("symbol_type").alias("ref_type")).agg(F.count("*").alias("n_definitions"))
    kinds = symbols.groupBy("name", "symbol_type").count().groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("symbol_type")), ",").alias("defined_as"))
    told = refs.join(exact, ["name", "ref_type"], "left").join(kinds, "name", "left")
    status = F.when(F.col("n_definitions") > 0, "resolved").when(F.col("defined_as").isNotNull(), "other_kind").otherwise("missing")
    return told.withColumn("status", status).fillna(0, ["n_definitions"])


def by_source(rows: DataFrame, source: str, name: str = "name", sep: str = ",") -> DataFrame:
    """Distinct names that each source defines or uses: counts, the first and the last. A list of them is a query away."""
    each = rows.groupBy(source, name).agg(F.count("*").alias("n"))
    return each.groupBy(source).agg(F.count("*").alias("n_names"), F.sum("n").alias("n_rows"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def kinds_touched(symbols: DataFrame, source: str) -> DataFrame:
    """Distinct names of each kind that a source defines."""
    return symbols.groupBy(source, "symbol_type", "name").count().groupBy(source, "symbol_type").agg(F.count("*").alias("n_names"))


def mod_search(mods: DataFrame, query: str, name: str = "name", external_id: str = "workshop_id") -> DataFrame:
    """Sources found by their exact id, by a part of their name, by an abbreviation in capitals (each letter begins a part
    of the name, in order), or by all words in order; the best way is told."""
    low, q = F.lower(F.col(name)), query.lower().strip()
    cases = [(F.col(external_id) == query, F.lit("id")), (low == q, F.lit("exact")), (low.contains(q), F.lit("contains"))]
    if query.isupper() and query.isalpha():
        cases.append((F.col(name).like("%".join(query) + "%"), F.lit("abbreviation")))
    cases.append((low.like("%" + "%".join(q.split()) + "%"), F.lit("words")))
    return mods.withColumn("match_type", first_of(cases, F.lit(None).cast("string"))).where("match_type IS NOT NULL")


def fts_terms(query: str, prefix: bool = False) -> list[str]:
    """Words of a full-text query, quotes and operators taken as text; with ``prefix`` each one stands for its beginnings."""
    words = [w.replace('"', "").lower() for w in query.split()]
    return [w + ("*" if prefix else "") for w in words if w]


def fts(rows: DataFrame, text: str, query: str, prefix: bool = False) -> DataFrame:
    """Rows with any word of the query: a lone word as it is, several as alternatives. Returns the rows and n_terms."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def has(term: str) -> Column:
        return F.exists(words, lambda w: w.startswith(term[:-1])) if term.endswith("*") else F.array_contains(words, term)

    terms = fts_terms(query, prefix)
    if not terms:
        return rows.where(F.lit(False)).withColumn("n_terms", F.lit(0))
    n = sum((has(t).cast("int") for t in terms[1:]), has(terms[0]).cast("int"))
    return rows.withColumn("n_terms", n).where("n_terms > 0")


def values_in_tree(tree: DataFrame, text: str) -> DataFrame:
    """Nodes whose value holds a text, whatever the case."""
    return tree.where(F.lower("value").contains(text.lower()))


def blocks_named(tree: DataFrame, name: str) -> DataFrame:
    return tree.where((F.col("node_type") == "block") & (F.col("key") == name))


def at_path(tree: DataFrame, path: str) -> DataFrame:
    """The node at a dotted path, the first of repeated keys on every level."""
    return tree.where(F.col("path") == path)


def keys_of(tree: DataFrame) -> DataFrame:
    """Distinct keys and how often each occurs."""
    return tree.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
