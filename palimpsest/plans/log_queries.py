"""Registered queries over logs written from the events, from their text to marks of cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import cascades as K
from palimpsest.plans.registry import query
from palimpsest.session import shared_folder, table
from palimpsest.sources import logs as G

#: A log for each day, its seconds a hundredth of the day's, a line for each event.
LINE = """concat('[', lpad(cast(second div 3600 as string), 2, '0'), ':', lpad(cast(second div 60 % 60 as string), 2, '0'), ':', lpad(cast(second % 60 as string), 2, '0'), '][E][', CASE event_type
  WHEN 'error' THEN concat('jomini_script_system.cpp:12]: Script error! file: events/f', user_id % 3, '.txt line: 4')
  WHEN 'view' THEN concat('pdx.cpp:1]: trait not defined', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(' file: events/f', user_id % 3, '.txt line: 9') END)
  WHEN 'click' THEN 'scope.cpp:3]: wrong scope'
  WHEN 'signup' THEN concat('reader.cpp:2]: Incorrect MOD descriptor ugc_', user_id % 20)
  ELSE concat('gui_', user_id % 4, '.cpp]: Widget cannot have ugc_', user_id % 20, ' size ', event_id) END)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").selectExpr("event_id", "event_type", "user_id", "concat('day_', lpad(day(ts), 2, '0')) AS file", "(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) div 100 AS second")
    path = shared_folder(spark, "records")
    G.entries(seen.select("file", F.col("event_id").alias("line"), F.expr(LINE).alias("text"))).write.parquet(path)
    return spark.read.parquet(path)


RECORDS = """WITH e AS (SELECT *, 'day_' || strftime(ts, '%d') AS file, date_diff('second', date_trunc('day', ts), ts) // 100 AS second FROM events),
r AS (SELECT file, event_id, second, row_number() OVER (PARTITION BY file ORDER BY event_id) AS record,
  CASE event_type WHEN 'error' THEN 'script_system_error' WHEN 'view' THEN 'missing_reference' WHEN 'click' THEN 'scope_error' WHEN 'signup' THEN 'encoding_error' ELSE 'gui_warning' END AS category,
  CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 3 WHEN 'signup' THEN 2 ELSE 4 END AS priority,
  CASE WHEN event_type = 'error' OR event_type = 'view' AND event_id % 4 <> 0 THEN 'events/f' || user_id % 3 || '.txt' END AS script_file,
  CASE WHEN event_type IN ('signup', 'purchase') THEN user_id % 20 END AS mod_id,
  CASE event_type WHEN 'error' THEN 'a' WHEN 'view' THEN 'b' || (event_id % 4 = 0) WHEN 'click' THEN 'c' WHEN 'signup' THEN 'd' ELSE 'g' || user_id % 4 END AS alike FROM e),
p AS (SELECT a.file, a.record AS root, b.record FROM r a JOIN r b ON a.file = b.file AND b.record BETWEEN a.record - 50 AND a.record + 149 AND abs(a.second - b.second) <= 5 AND b.category IN ('missing_reference', 'scope_error') AND coalesce(b.script_file, a.script_file) = a.script_file WHERE a.category = 'script_system_error'),
m AS (SELECT a.file, a.record AS root, b.record FROM r a JOIN r b ON a.file = b.file AND a.mod_id = b.mod_id AND b.second > a.second WHERE a.category = 'encoding_error'),
s AS (SELECT file, min(record) OVER w AS root, record, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY file, alike)),
every AS (SELECT 0 AS kind, file, root, count(*) AS n FROM p GROUP BY ALL HAVING n >= 3 UNION ALL SELECT 1, file, root, count(*) AS n FROM m GROUP BY ALL HAVING n >= 5 UNION ALL SELECT 2, file, root, count(*) - 1 AS n FROM s WHERE n >= 10 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY kind, root) AS g FROM every),
k AS (SELECT file, root AS record, g, true AS is_root FROM c UNION ALL SELECT p.file, p.record, g, false FROM p JOIN c ON c.kind = 0 AND c.file = p.file AND c.root = p.root
  UNION ALL SELECT m.file, m.record, g, false FROM m JOIN c ON c.kind = 1 AND c.file = m.file AND c.root = m.root UNION ALL SELECT s.file, s.record, g, false FROM s JOIN c ON c.kind = 2 AND c.file = s.file AND c.root = s.root WHERE s.record <> s.root),
t AS (SELECT file, record, bool_or(is_root) AS is_root, bool_or(NOT is_root) AS is_child, max(g) AS cascade_group FROM k GROUP BY ALL),
marked AS (SELECT r.*, coalesce(t.is_root, false) AS is_root, coalesce(t.is_child, false) AS is_child, cascade_group FROM r LEFT JOIN t USING (file, record))"""


@query(f"{RECORDS} SELECT file, g AS cascade_group, ['script_parse_cascade', 'mod_load_cascade', 'repeated_error_spam'][kind + 1] AS pattern, root AS record, n AS n_children, CASE kind WHEN 2 THEN 1.0 WHEN 1 THEN 0.9 ELSE CASE WHEN n >= 10 THEN 0.8 ELSE 0.6 END END::DOUBLE AS confidence FROM c")
def cascades(spark: SparkSession, sf: str) -> DataFrame:
    """All cascades of all logs, from their text."""
    return K.find(_records(spark, sf))[0]


@query(f"{RECORDS} SELECT file, record, category, is_root, is_child, cascade_group FROM marked")
def cascade_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of every log with its marks."""
    return K.marked(_records(spark, sf)).select("file", "record", "category", "is_root", "is_child", "cascade_group")


@query(f"{RECORDS} SELECT file, record, priority, is_root FROM marked WHERE priority <= 3 AND NOT is_child ORDER BY priority, is_root DESC, record, file LIMIT 60")
def actionable_by_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The most urgent records that are no child of a cascade."""
    return G.actionable(K.marked(_records(spark, sf)), top=60).select("file", "record", "priority", "is_root")
