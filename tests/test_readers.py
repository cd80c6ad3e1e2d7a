"""Readers and writers of files: logs in blocks, crash folders, JSON lines, snapshots, reports."""

import json

from palimpsest.operators import names, units
from palimpsest.sinks import export
from palimpsest.sources import files, logs, script


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 90) for i in range(1, 4001)]
    (tmp_path / "a.log").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.log").write_text("only\r\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = logs.log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 0
        got = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.log", i + 1): t for i, t in enumerate(rows)} | {("b.log", 1): "only", ("b.log", 2): "two"}
    last = logs.window_of_lines(logs.log_lines(spark, f"{tmp_path}/a.log"), most=3, last=True)
    assert sorted(r.line for r in last.collect()) == [3998, 3999, 4000]


def test_crash_folders(spark, tmp_path):
    for name, text in {"ck3_20240102_030405": "Version: 1\nUnhandled Exception C5 (BAD_ACCESS) at address 0x1\nStack Trace:\nf\n", "ck3_20240101_000000": "nothing", "other": "Version: 9"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "exception.txt").write_text(text)
        (tmp_path / name / "meta.yml").write_text("a: b\n")
    found = logs.crashes(spark, str(tmp_path))
    rows = {r.crash_id: r for r in found.collect()}
    assert set(rows) == {"ck3_20240102_030405", "ck3_20240101_000000"}
    good = rows["ck3_20240102_030405"]
    assert (good.exception_type, good.exception_address, good.stack, good.meta, str(good.at)) == ("BAD_ACCESS", "0x1", ["f"], {"a": "b"}, "2024-01-02 03:04:05")
    assert sorted((r.exception_type, r.n) for r in logs.crash_summary(found).collect()) == [("BAD_ACCESS", 1), ("unknown", 1)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"ts": 1, "event": "step", "run_id": "r", "step": "parse", "seconds": 2.5}\nbroken\n{"ts": 2, "event": "end", "run_id": "r"}\n')
    assert [(r.step, r.seconds) for r in logs.build_log(spark, f"{tmp_path}/b.jsonl", event="step").collect()] == [("parse", 2.5)]
    assert logs.build_log(spark, f"{tmp_path}/b.jsonl", run_id="r").count() == 2
    session = {"customTitle": "t", "requests": [{"message": {"text": "q"}, "response": [{"value": "a"}, {"value": "b"}]}, {"message": {"text": "only"}, "response": []}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(session) + "\n")
    turns = logs.chat_sessions(spark, f"{tmp_path}/s.jsonl").orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in turns] == [(0, "user", "q"), (1, "assistant", "a\nb"), (2, "user", "only")]


def test_snapshot_round_trip(spark, tmp_path):
    schema = "digest string, n long"
    df = spark.createDataFrame([("a", 1), ("b", None)], schema)
    export.snapshot({"contents": df, "files": df}, f"{tmp_path}/s")
    back = files.read_snapshot(spark, f"{tmp_path}/s", {"contents": schema, "files": schema}, known=df.where("digest = 'a'"))
    assert [r.digest for r in back["contents"].collect()] == ["b"] and sorted(back["files"].collect()) == sorted(df.collect())


def test_reports(spark, tmp_path):
    two = [spark.createDataFrame([(1, t)], "name int, text string") for t in ("a = 1 b = { c = 2 }", "a = 1 b = { c = 3 d = 4 }")]
    found = script.diff(*[script.nodes(t, "name", "text") for t in two], keep=("name",))
    export.changes(found, f"{tmp_path}/changes", base="x", other="y")
    assert {(r.base, r.path, r.change_type) for r in spark.read.json(f"{tmp_path}/changes").collect()} == {("x", "b.c", "modified"), ("x", "b.d", "added")}
    lines = export.change_summary(found).collect()
    assert {(r.label, r.n) for r in lines if r.section == "types"} == {("modified", 1), ("added", 1)}
    assert {r.detail for r in lines if r.section == "changes"} == {"modified b.c 2 -> 3", "added b.d - -> 4"}

    rows = [("common/on_action/a.txt", 0, "base", "on_x", 1, "h1"), ("common/on_action/b.txt", 1, "mod", "on_x", 1, "h2"), ("common/on_action/a.txt", 1, "mod", "on_y", 2, "h3")]
    defs = spark.createDataFrame(rows, "relpath string, load_order int, source string, name string, node_id int, node_hash string")
    contribs = units.contributions(defs, "load_order", "relpath")
    per_file = spark.createDataFrame([("common/on_action/a.txt", "base", 0, 10), ("common/on_action/a.txt", "mod", 1, 30)], "relpath string, source string, load_order int, size int")
    tables = units.report(per_file, contribs)
    assert [(r.relpath, r.winner, r.inner_conflicts, r.score, r.reasons) for r in tables[0].collect()] == [("common/on_action/a.txt", "mod", 1, 55, "hotspot_domain; large_size_delta; has_id_conflicts")]
    assert [(r.unit_key, r.winner, r.score, r.level) for r in tables[1].collect()] == [("on_action:on_x", "mod", 50, "medium")]
    export.report_json(*tables, f"{tmp_path}/report")
    said = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert sorted(x["level_of"] for x in said) == ["file", "id"] and any(x["conflict"].get("unit_key") == "on_action:on_x" for x in said)
    assert "file conflicts: 1" in [r.text for r in export.report_text(units.report_summary(*tables)).collect()]
    lost = units.losing_source(units.candidates(contribs, units.conflict_units(contribs)), "base")
    assert [r.name for r in lost.collect()] == ["on_x"]
    assert not names.exists(defs.withColumnRenamed("load_order", "cvid"), "nope") and names.exists(defs.withColumnRenamed("load_order", "cvid"), "on_x", sources=[1])

    logged = spark.createDataFrame([("scope_error", 3, "a\nb")], "category string, priority int, message string")
    export.log_report(logged, f"{tmp_path}/log")
    assert [r.value for r in spark.read.text(f"{tmp_path}/log").collect()] == ["- [scope_error/3] a / b"]


def test_enumeration_resumes_and_definitions(spark, tmp_path):
    for name in ("a/x.txt", "a/y.txt", "b.txt"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(name)
    every = files.enumerated(spark, f"{tmp_path}/root")
    assert [r.relpath for r in every.collect()] == ["a/x.txt", "a/y.txt", "b.txt"]
    assert [r.relpath for r in files.enumerated(spark, f"{tmp_path}/root", resume_after="a/x.txt").collect()] == ["a/y.txt", "b.txt"]
    (tmp_path / "d.csv").write_text("0;0;0;0;x;\n1;42;3;128;VESTFIRDIR;x\nid;r;g;b;n\n")
    assert [tuple(r) for r in files.definitions_csv(spark, f"{tmp_path}/d.csv").collect()] == [(1, 42, 3, 128, "VESTFIRDIR")]


def test_provenance(spark, tmp_path):
    import json

    from palimpsest.sinks.export import provenance

    won = spark.createDataFrame([("common/traits", "brave", "mod_b", "b.txt", 4), ("common/traits", "shy", "base", None, 9)], "folder string, name string, source string, file string, line int")
    provenance(won, str(tmp_path / "p"), "folder", "name", ["source", "file", "line"])
    got = [json.loads(line) for f in (tmp_path / "p").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted((g["name"], g["origin"]["source"], g["origin"].get("file"), g["origin"]["line"]) for g in got) == [("brave", "mod_b", "b.txt", 4), ("shy", "base", None, 9)]
