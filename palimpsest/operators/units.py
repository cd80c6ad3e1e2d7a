"""What each source contributes to each unit of content, where contributions compete, and the report over both.

A unit is a domain and a name, such as ``decision:found_kingdom``. Everything is a grouped pass over contributions; lists
are built by unit and hold one entry a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rules


def contributions(symbols: DataFrame, cvid: str = "cvid", file_id: str = "file_id") -> DataFrame:
    """A row for each definition (name, relpath, line, node_id, node_hash, source version, file): its unit, domain, how it
    merges, and an id that stays the same as long as version, file and place do.

    Returns the input's columns and domain, unit_key, merge_behavior, contrib_id.
    """
    domain = rules.domain(F.col("relpath"))
    behavior = rules.merge_behavior(rules.policy(F.col("relpath")))
    place = F.concat_ws(":", F.col(cvid).cast("string"), F.col(file_id).cast("string"), F.col("node_id").cast("string"))
    return symbols.withColumns({"domain": domain, "merge_behavior": behavior, "contrib_id": F.substring(F.sha2(place, 256), 1, 16)}).withColumn("unit_key", rules.unit_key(F.col("domain"), F.col("name")))


def conflict_units(contribs: DataFrame, order: str = "load_order", source: str = "source", base_order: int = 0, least: int = 2) -> DataFrame:
    """Units to which ``least`` sources or more contribute.

    A source that defines a unit several times is one candidate, with its last definition. Returns conflict_id, unit_key,
    domain, candidate_count, merge_behavior, merge_capability, risk_score, risk, uncertainty, reasons, winner_order,
    winner_source, candidates (text "order:source", ascending).
    """
    each = contribs.groupBy("unit_key", "domain", "merge_behavior", order, source).agg(F.count("*").alias("n"), F.min("node_hash").alias("h1"), F.max("node_hash").alias("h2"))
    told = each.groupBy("unit_key", "domain", "merge_behavior").agg(
        F.count("*").alias("candidate_count"), F.max(F.struct(order, source)).alias("w"), F.max(F.col(order) == base_order).alias("over_base"),
        (F.min("h1") != F.max("h2")).alias("differ"), F.sort_array(F.collect_list(F.struct(order, source))).alias("c"),
    ).where(F.col("candidate_count") >= least)
    n, behavior = F.col("candidate_count"), F.col("merge_behavior")
    score = rules.unit_risk(F.col("domain"), n, behavior, F.col("over_base"), F.lit(False), F.lit(False))
    return told.select(
        F.substring(F.sha2("unit_key", 256), 1, 16).alias("conflict_id"), "unit_key", "domain", "candidate_count", "merge_behavior", rules.merge_capability(behavior).alias("merge_capability"),
        score.alias("risk_score"), rules.risk_bucket(score).alias("risk"), rules.uncertainty(F.col("domain"), behavior, F.coalesce("differ", F.lit(False))).alias("uncertainty"),
        rules.unit_reasons(n, behavior, F.col("over_base"), F.lit(False), F.lit(False)).alias("reasons"), F.col(f"w.{order}").alias("winner_order"), F.col(f"w.{source}").alias("winner_source"),
        F.array_join(F.transform("c", lambda x: F.concat_ws(":", x[order].cast("string"), x[source].cast("string"))), ",").alias("candidates"),
    )


def candidates(contribs: DataFrame, units: DataFrame, order: str = "load_order") -> DataFrame:
    """The contributions to units in conflict, with their unit's id and whether they are of its winning source."""
    return contribs.join(units.select("unit_key", "conflict_id", "winner_order"), "unit_key").withColumn("is_winner", F.col(order) == F.col("winner_order")).drop("winner_order")


def listed(units: DataFrame, risk: str | None = None, domain: str | None = None, status: str | None = None, least_score: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the list of conflicts, the riskiest first, ties by key."""
    for column, value in (("risk", risk), ("domain", domain), ("resolution_status", status)):
        if value is not None:
            units = units.where(F.col(column) == value)
    if least_score is not None:
        units = units.where(F.col("risk_score") >= least_score)
    return units.orderBy(F.desc("risk_score"), "unit_key").offset(offset).limit(limit)


def with_resolutions(units: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Units with the state of their latest resolution (conflict_id, status, decided_at): unresolved without one."""
    last = resolutions.groupBy("conflict_id").agg(F.max(F.struct("decided_at", "status")).alias("r")).select("conflict_id", F.col("r.status").alias("resolution_status"))
    return units.join(last, "conflict_id", "left").withColumn("resolution_status", F.coalesce("resolution_status", F.lit("unresolved")))


def histogram(units: DataFrame) -> DataFrame:
    """Counts by risk, by domain, by status, and of all, in one pass: what, value, n."""
    rows = units.select("risk", "domain", "resolution_status")
    sets = rows.groupingSets([["risk"], ["domain"], ["resolution_status"], []], "risk", "domain", "resolution_status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "risk").when(F.col("g") == 5, "domain").when(F.col("g") == 6, "status").otherwise("all")
    return sets.select(what.alias("what"), F.coalesce("risk", "domain", "resolution_status").alias("value"), "n")


def losing_source(units_of: DataFrame, source_name: str, source: str = "source") -> DataFrame:
    """Candidates of a source that do not win, so what it loses to others."""
    return units_of.where((F.col(source) == source_name) & ~F.col("is_winner"))


def _chosen(name: Column, include: Sequence[str] | None, exclude: Sequence[str] | None) -> Column:
    ok = name.isin(*include) if include else F.lit(True)
    return ok & ~name.isin(*exclude) if exclude else ok


def report(files: DataFrame, contribs: DataFrame, *, path_like: str | None = None, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, least: int = 2, least_score: int = 0) -> tuple[DataFrame, DataFrame]:
    """The report's two tables: files and units that ``least`` sources or more define.

    ``files``: relpath, source, load_order, size. ``path_like`` is an SQL pattern without regard to case; ``include`` and
    ``exclude`` are report domains; ``least_score`` leaves out lower risks. Units inside a file count towards its risk.
    Returns (file conflicts, unit conflicts), each with domain, candidates, winner, score, level and reasons.
    """
    if path_like is not None:
        files, contribs = files.where(F.col("relpath").ilike(path_like)), contribs.where(F.col("relpath").ilike(path_like))
    kept = contribs.withColumn("report_domain", rules.report_domain(F.col("relpath"))).where(_chosen(F.col("report_domain"), include, exclude))
    each = kept.groupBy("unit_key", "report_domain", "load_order", "source").agg(F.min("relpath").alias("relpath"))
    ids = each.groupBy("unit_key", "report_domain").agg(F.count("*").alias("candidates"), F.max(F.struct("load_order", "source"))["source"].alias("winner"), F.min("relpath").alias("container")).where(F.col("candidates") >= least)
    unsure = F.col("report_domain") == "on_action"
    id_score = rules.id_risk(F.col("report_domain"), F.col("candidates"), F.lit(False), unsure)
    inner = kept.join(ids.select("unit_key"), "unit_key", "left_semi").groupBy("relpath").agg(F.count_distinct("unit_key").alias("inner_conflicts"))
    ids = ids.select("unit_key", F.col("report_domain").alias("domain"), "candidates", "winner", "container", id_score.alias("score"), rules.risk_bucket(id_score).alias("level"), rules.id_uncertainty(F.col("report_domain"), unsure).alias("uncertain"))

    size = F.when(F.col("size") > 0, F.col("size"))
    told = files.groupBy("relpath").agg(F.count_distinct("source").alias("candidates"), F.max(F.struct("load_order", "source"))["source"].alias("winner"), F.coalesce((F.max(size) - F.min(size)) / F.max(size), F.lit(0.0)).alias("size_delta"))
    told = told.where(F.col("candidates") >= least).withColumn("domain", rules.report_domain(F.col("relpath"))).where(_chosen(F.col("domain"), include, exclude))
    told = told.join(inner, "relpath", "left").fillna(0, ["inner_conflicts"])
    args = F.col("domain"), F.col("candidates"), F.col("size_delta"), F.col("inner_conflicts")
    score = rules.file_risk(*args)
    found = told.select("relpath", "domain", rules.report_type(F.col("relpath")).alias("file_type"), "candidates", "winner", F.round("size_delta", 6).alias("size_delta"), "inner_conflicts", score.alias("score"), rules.risk_bucket(score).alias("level"), rules.file_reasons(*args).alias("reasons"))
    return found.where(F.col("score") >= least_score), ids.where(F.col("score") >= least_score)


def report_summary(files: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: conflicts of both kinds, how many are of high risk, how many units are unsure."""
    a = files.agg(F.count("*").alias("file_conflicts"), F.count_if(F.col("level") == "high").alias("high_risk_files"))
    b = ids.agg(F.count("*").alias("id_conflicts"), F.count_if(F.col("level") == "high").alias("high_risk_ids"), F.count_if(F.col("uncertain") != "none").alias("uncertain_ids"))
    return a.crossJoin(F.broadcast(b))  # one row each
