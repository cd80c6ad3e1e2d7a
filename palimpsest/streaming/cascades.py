"""Cascades in a stream of log records, found with arbitrary state: records that come late or twice change nothing.

Both operators hold what has not been decided yet for a key, and let go of it when the watermark says that nothing more
can come, so state follows the rate of records and not the length of the stream. What they emit is what
``operators.cascades`` finds in a table of the same records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.cascades import AFTER, BEFORE, CONFIDENCE, LEAST, MANY, SCRIPT_CHILDREN, SCRIPT_ROOT, SECONDS

FOUND = "file string, record long, n_children long, confidence double"
ALIKE = "file string, alike string, record long, n long, final boolean"


def _once(records: DataFrame, time: str, late: str, columns: list[str]) -> DataFrame:
    """Each record once, as long as its repeats come within ``late``."""
    timed = records.withWatermark(time, late).dropDuplicatesWithinWatermark(["file", "record"])
    return timed.select(*columns, F.col(time).alias("ts"))


def script_cascades(records: DataFrame, time: str = "ts", late: str = "1 minute") -> DataFrame:
    """Script errors that are roots: file, record, n_children, confidence, emitted once all that can be near has come.

    ``records``: file, record (place in the file), a timestamp, category, script_file. A file's state holds the records of
    the last seconds before the watermark and those after it. Records later than ``late`` are left out, as everywhere in
    a stream with a watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in zip(*state.get)] if state.exists else []
        for b in batches:
            script = b.script_file.astype(object).where(b.script_file.notna(), None)
            held += list(zip(b.record.tolist(), (b.ts.astype("datetime64[us]").astype("int64") // 1_000_000).tolist(), b.category.tolist(), script.tolist(), [False] * len(b)))
        now = state.getCurrentWatermarkMs() // 1000
        out, kept = [], []
        for record, second, category, script, done in held:
            if category == SCRIPT_ROOT and not done and second + SECONDS < now:
                n = sum(1 for r, s, c, f, _ in held if c in SCRIPT_CHILDREN and r != record and -BEFORE <= r - record <= AFTER and abs(s - second) <= SECONDS and (not f or f == script))
                if n >= LEAST[0]:
                    out.append((key[0], record, n, CONFIDENCE[1] if n >= MANY else CONFIDENCE[0]))
                done = True
            if second + 2 * SECONDS + 1 >= now:  # an undecided root may still look back at it
                kept.append((record, second, category, script, done))
        if kept:
            state.update(tuple(list(c) for c in zip(*kept)))
            state.setTimeoutTimestamp(max(min(second for _, second, *_ in kept) + 2 * SECONDS + 2, now + 1) * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["file", "record", "n_children", "confidence"])

    rows = _once(records, time, late, ["file", "record", "category", "script_file"]).where(F.col("category").isin(SCRIPT_ROOT, *SCRIPT_CHILDREN))
    held = "record array<long>, second array<long>, category array<string>, script_file array<string>, done array<boolean>"
    return rows.groupBy("file").applyInPandasWithState(step, FOUND, held, "append", GroupStateTimeout.EventTimeTimeout)


def repeated(records: DataFrame, time: str = "ts", late: str = "1 minute", idle: int = 3600) -> DataFrame:
    """Messages that come again and again: file, alike, record of the first, n, final.

    ``records``: file, record, a timestamp, alike (source and signature). A row tells at once when a message reaches the
    threshold; another, ``final``, tells its count and least record when it has been silent for ``idle`` seconds. Then its
    state goes, so that a message seen once is not kept for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, least, last = state.get if state.exists else (0, 1 << 62, 0)
        if state.hasTimedOut:
            state.remove()
            if n >= LEAST[2]:
                yield pd.DataFrame([(*key, least, n, True)], columns=["file", "alike", "record", "n", "final"])
            return
        before = n
        for b in batches:
            n += len(b)
            least = min(least, int(b.record.min()))
            last = max(last, int(b.ts.astype("datetime64[us]").astype("int64").max() // 1000))
        state.update((n, least, last))
        state.setTimeoutTimestamp(max(last + idle * 1000, state.getCurrentWatermarkMs() + 1))
        if before < LEAST[2] <= n:
            yield pd.DataFrame([(*key, least, n, False)], columns=["file", "alike", "record", "n", "final"])

    rows = _once(records, time, late, ["file", "record", "alike"])
    return rows.groupBy("file", "alike").applyInPandasWithState(step, ALIKE, "n long, least long, last long", "append", GroupStateTimeout.EventTimeTimeout)
