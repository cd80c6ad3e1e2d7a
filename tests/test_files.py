import json

from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.sinks import export
from palimpsest.sources import files, logs
from palimpsest.sources.script import nodes
from palimpsest.streaming import ingest


def folder(tmp_path):
    root = tmp_path / "src"
    for name, data in {
        "common/traits/A.txt": b"\xef\xbb\xbfbrave = { x = 1 }", "common/traits/b.txt": "café = { }".encode("latin-1"), "events/e.txt": b"brave = { x = 1 }",
        "localization/english/l_english.yml": b'\xef\xbb\xbfl_english:\n # no\n key.1:0 "Hello [Get] $NAME$ @gold!"\n other: "b"\n bad line\n', "gfx/pic.dds": b"\0\1", "notes.txt": b"x", ".hidden/a.txt": b"x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_manifest_contents_localization(spark, tmp_path):
    found = files.manifest(spark, str(folder(tmp_path)), "base").cache()
    assert sorted(r.relpath for r in found.collect()) == ["common/traits/a.txt", "common/traits/b.txt", "events/e.txt", "localization/english/l_english.yml"]
    store = files.contents(found).cache()
    assert sorted((r.encoding, r.text[:5]) for r in store.collect()) == [("latin-1", "café "), ("utf-8", "brave"), ("utf-8-sig", "brave"), ("utf-8-sig", "l_eng")]
    assert files.contents(found, store).count() == 0
    entries = files.localization(store.where("text LIKE 'l\\_%'"), "digest").collect()
    assert [(r.loc_key, r.version, r.language, r.line) for r in entries] == [("key.1", 0, "english", 3), ("other", 0, "english", 4)]
    assert (entries[0].scripted, entries[0].variables, entries[0].icons) == (["Get"], ["NAME"], ["gold"])


def test_encodings(spark):
    raw = [(b"\xff\xfea\0", "utf-16-le", "a"), (b"\xfe\xff\0a", "utf-16-be", "a"), (b"a\0b", "binary", None), (b"", "utf-8", ""), (b"\xe9", "latin-1", "é")]
    df = spark.createDataFrame([(bytearray(r[0]),) for r in raw], "c binary").select(files.encoding(F.col("c")).alias("e"), files.decoded(F.col("c")).alias("t"))
    assert [(r.e, r.t) for r in df.collect()] == [r[1:] for r in raw]


def test_playset_and_log(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"playset_name": "p", "vanilla": {"path": "/g"}, "mods": [{"name": "a", "path": "/a"}, {"name": "b", "path": "/b", "enabled": False}, {"name": "c", "path": "/c"}]}))
    assert [(r.load_order, r.name) for r in files.load_order(spark, f"{tmp_path}/p.json").orderBy("load_order").collect()] == [(0, "base"), (1, "a"), (3, "c")]
    (tmp_path / "error.log").write_text("noise\n[10:00:01][E][jomini_script_system.cpp:12]: bad trigger\n  Error: x not found\n  Script location: file: events/a b.txt line: 7\n[10:00:02][E][gui.cpp:3]: in 'mod/ugc_99.mod' scope wrong 42\n")
    rows = logs.entries(logs.log_lines(spark, f"{tmp_path}/error.log")).orderBy("record").collect()
    assert [(r.second, r.category, r.priority) for r in rows] == [(36001, "script_system_error", 2), (36002, "scope_error", 3)]
    assert (rows[0].script_file, rows[0].script_line, rows[1].mod_id, rows[1].signature) == ("events/a b.txt", 7, "99", "in 'mod/ugc_N.mod' scope wrong N")


def test_stream_ingests_once(spark, tmp_path):
    root = folder(tmp_path)
    run = lambda: ingest.ingest(ingest.file_stream(spark, str(root), 2), f"{tmp_path}/store", f"{tmp_path}/ckpt", lambda c: nodes(c)).awaitTermination()
    run()
    run()
    (root / "events/again.txt").write_bytes(b"brave = { x = 1 }")
    run()
    stored = spark.read.parquet(f"{tmp_path}/store/contents")
    assert stored.count() == stored.select("digest").distinct().count() == 4
    assert spark.read.parquet(f"{tmp_path}/store/files").count() == 5
    assert spark.read.parquet(f"{tmp_path}/store/work").where("node_type = 'block'").count() == 3


def test_digests_are_merged_as_batches_come(spark, tmp_path):
    assert ingest.runs(13) == [(0, 8), (8, 12), (12, 13)] and ingest.runs(0) == []
    root = tmp_path / "src/events"
    root.mkdir(parents=True)
    run = lambda: ingest.ingest(ingest.file_stream(spark, str(tmp_path / "src"), 1), f"{tmp_path}/store", f"{tmp_path}/ckpt").awaitTermination()
    for i in range(11):
        (root / f"e{i % 9}_{i}.txt").write_bytes(b"x = %d" % (i % 7))
    run()
    stored = spark.read.parquet(f"{tmp_path}/store/contents")
    assert stored.count() == stored.select("digest").distinct().count() == 7
    # What the next batch reads: three folders of a file each, in which the digests of all eleven batches are.
    folders = [f"{tmp_path}/store/digests/run={a}-{b}" for a, b in ingest.runs(11)]
    known = spark.read.parquet(*folders)
    assert len(folders) == 3 and len(known.inputFiles()) <= 3 and known.count() == 7
    changed = spark.read.parquet(f"{tmp_path}/store/files/batch=3").withColumn("size", F.lit(99).cast("long"))
    changed.write.parquet(f"{tmp_path}/store/files/batch=11")  # a file that came again
    now = {r.relpath: (r.size, r.batch) for r in ingest.files_now(spark, f"{tmp_path}/store").collect()}
    assert len(now) == 11 and now[changed.first().relpath] == (99, 11)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", "a", "x = 1", "base"), ("g", "b", "y = 2", None)], "folder string, name string, text string, source string")
    for fmt in ("json", "csv", "markdown"):
        export.conflict_report(df, f"{tmp_path}/{fmt}", fmt)
    assert spark.read.text(f"{tmp_path}/markdown").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    export.resolved_folder(df.fillna(""), f"{tmp_path}/out")
    assert "# from base: a" in [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    a, b = (export.snapshot({"t": d}, f"{tmp_path}/snap").first() for d in (df, df.repartition(3)))
    assert a == b and a.n_rows == 2


def test_rules(spark):
    df = spark.createDataFrame([("common/on_action/x.txt",), ("zz/readme.txt",), (None,), ("m/common/widgets/x.txt",)], "p string")
    p = F.col("p")
    got = df.select(rules.route(p)["route"].alias("r"), rules.kind(p).alias("k"), rules.policy(p).alias("m")).collect()
    assert [(r.r, r.k, r.m) for r in got] == [("SCRIPT", "on_action", "container_merge"), ("SKIP", "definition", "override"), ("SKIP", "definition", "override"), ("SKIP", "widget", "override")]
