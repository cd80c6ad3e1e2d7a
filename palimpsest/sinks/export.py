"""Reports, resolved folders and snapshots as files, each written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflict_report(conflicts: DataFrame, path: str, fmt: str = "json") -> None:
    """Conflicts as JSON lines, CSV with a header, or Markdown table rows."""
    if fmt == "json":
        conflicts.write.mode("overwrite").json(path)
    elif fmt == "csv":
        conflicts.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "markdown":
        cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in conflicts.columns])
        conflicts.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def resolved_folder(winners: DataFrame, path: str, folder: str = "folder", name: str = "name", text: str = "text", source: str = "source") -> None:
    """The winning definitions' text below a line that names their source, one output folder for each content folder."""
    head = F.concat(F.lit("# from "), F.col(source).cast("string"), F.lit(": "), F.col(name).cast("string"), F.lit("\n"))
    winners.select(F.col(folder), F.concat(head, F.col(text)).alias("value")).write.mode("overwrite").partitionBy(folder).text(path)


def provenance(winners: DataFrame, path: str, folder: str, name: str, columns: list[str]) -> None:
    """Where each winner came from, as JSON lines."""
    winners.select(folder, name, F.struct(*columns).alias("origin")).write.mode("overwrite").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as gzip JSON in its own folder; returns name, rows and a checksum that does not depend on order."""
    made = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
        made = row if made is None else made.unionByName(row)
    return made


def chat_markdown(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation as Markdown, turns in order under a heading with their role."""
    entry = F.struct(turn, F.concat(F.lit("## "), F.coalesce(role, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))).alias("s"))
    return turns.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["s"]), "\n\n").alias("markdown"))


def changes(found: DataFrame, path: str, **about: str) -> None:
    """Change records as JSON lines, each with what the comparison was about."""
    found.select(*[F.lit(v).alias(k) for k, v in about.items()], *found.columns).write.mode("overwrite").json(path)


def change_summary(found: DataFrame, name: str = "name", top_paths: int = 10, of_each: int = 5) -> DataFrame:
    """The change report's lines: counts by type, the paths that change most, and each name's first changes.

    Returns section (types, paths, changes), label, n, detail; the two lengths are features of the report.
    """
    from pyspark.sql import Window

    types = found.groupBy("change_type").agg(F.count("*").alias("n")).select(F.lit("types").alias("section"), F.col("change_type").alias("label"), "n", F.lit(None).cast("string").alias("detail"))
    paths = found.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(top_paths).select(F.lit("paths").alias("section"), F.col("path").alias("label"), "n", F.lit(None).cast("string").alias("detail"))
    place = F.row_number().over(Window.partitionBy(name).orderBy("path", "change_type"))
    said = F.concat_ws(" ", "change_type", "path", F.concat(F.coalesce("old_value", F.lit("-")), F.lit(" -> "), F.coalesce("new_value", F.lit("-"))))
    some = found.withColumn("__i", place).where(F.col("__i") <= of_each).select(F.lit("changes").alias("section"), F.col(name).cast("string").alias("label"), F.col("__i").cast("long").alias("n"), said.alias("detail"))
    return types.unionByName(paths).unionByName(some)


def report_json(files: DataFrame, ids: DataFrame, path: str) -> None:
    """The conflicts report's two tables as JSON lines, told apart by a field."""
    rows = [df.select(F.lit(kind).alias("level_of"), F.to_json(F.struct(*df.columns)).alias("conflict")) for kind, df in (("file", files), ("id", ids))]
    rows[0].unionByName(rows[1]).select(F.to_json(F.struct("level_of", F.parse_json("conflict").alias("conflict"))).alias("value")).write.mode("overwrite").text(path)


def report_text(summary: DataFrame) -> DataFrame:
    """The summary's one row as lines: line number and text."""
    lines = F.array(*[F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.col(c).cast("string")) for c in summary.columns])
    return summary.select(F.posexplode(lines).alias("line", "text"))


def log_report(rows: DataFrame, path: str) -> None:
    """Log records as Markdown list items in a folder."""
    item = F.concat(F.lit("- ["), "category", F.lit("/"), F.col("priority").cast("string"), F.lit("] "), F.replace(F.col("message"), F.lit("\n"), F.lit(" / ")))
    rows.select(item.alias("value")).write.mode("overwrite").text(path)
