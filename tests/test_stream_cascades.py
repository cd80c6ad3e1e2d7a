import datetime
import random

from pyspark.sql import functions as F

from palimpsest.operators import cascades as K
from palimpsest.streaming import cascades as S

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "file string, record long, ts timestamp, second int, category string, mod_id string, source string, script_file string, signature string, alike string"


def log(n=500):
    rng = random.Random(9)
    rows, second = [], 0
    for i in range(n):
        second += rng.choice([0, 0, 1, 1, 2, 9])
        source, signature = rng.choice("st"), "m N" if rng.random() < 0.2 else f"x{rng.randrange(60)}"
        category = rng.choice(["script_system_error", "missing_reference", "missing_reference", "scope_error", "event_error", "gui_warning"])
        rows.append((rng.choice("ab"), i, START + datetime.timedelta(seconds=second), second, category, None, source, rng.choice([None, "", "f", "g"]), signature, f"{source}:{signature}"))
    return rows


def stream(spark, path, rows, run):
    """The rows in small files, out of order within a batch and its neighbours, some twice, and an end that moves the watermark on."""
    rng = random.Random(1)
    again = sorted(rows + rng.sample(rows, len(rows) // 5), key=lambda r: r[1] + rng.randrange(12))
    end = [("z", 10_000 + i, START + datetime.timedelta(hours=12 * (i + 1)), 0, "gui_warning", None, "s", None, f"end{i}", f"end{i}") for i in range(3)]
    for k in range(0, len(again), 60):
        spark.createDataFrame(again[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")

    def go():
        q = run(files).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    go()
    for e in end:  # the query goes on from its checkpoint
        spark.createDataFrame([e], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        go()
    return spark.read.parquet(f"{path}/out")


def test_script_cascades_equal_the_table(spark, tmp_path):
    rows = log()
    want = K.find(spark.createDataFrame(rows, SCHEMA))[0].where("pattern = 'script_parse_cascade'").select("file", "record", "n_children", "confidence")
    got = stream(spark, str(tmp_path), rows, lambda s: S.script_cascades(s, late="2 minutes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_repeated_messages_equal_the_table(spark, tmp_path):
    rows = log()
    table = spark.createDataFrame(rows, SCHEMA)
    want = table.groupBy("file", "alike").agg(F.min("record").alias("record"), F.count("*").alias("n")).where("n >= 10").collect()
    got = stream(spark, str(tmp_path), rows, lambda s: S.repeated(s, late="2 minutes", idle=7200)).collect()
    assert sorted((r.file, r.alike, r.record, r.n) for r in got if r.final) == sorted(map(tuple, want)) and want
    assert sorted((r.file, r.alike) for r in got if not r.final) == sorted((r.file, r.alike) for r in want)
