"""Lineage cuts in the shared folder, word rules and hashing that several operators use."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import release  # noqa: F401  the operators take it from here

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is taken from the session; only where unset is one chosen."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that no later step depends on an executor's memory or disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, for tables that are large or read by columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing will read again."""
    jvm = table.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, k: int) -> Column:
    """crc32 of a column's text form modulo ``k``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def row_struct(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct, so that none of their names can clash with an operator's own."""
    others = [c for c in docs.columns if c != text_col]
    return F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash over all columns, nulls told apart: the same however often a row is computed, and shared only by
    rows that are equal in every column, which no choice between them can tell apart."""
    every = [F.col(c) for c in docs.columns] + [F.col(c).isNull() for c in docs.columns]
    return F.struct(F.xxhash64(F.lit(1), *every).alias("a"), F.xxhash64(F.lit(2), *every).alias("b"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null, as a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised word hashing -------------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = 1 << 16
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` below STEP, and those of its power STEP: all that a worker keeps, however long its texts."""
    have = _tables.get(int(base))
    if have is None:
        both = []
        for b in (int(base), pow(int(base), STEP, 1 << 64)):
            p = np.full(STEP, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[int(base)] = have = (both[0], both[1])
    return have


def power_at(base: np.uint64, at: np.ndarray) -> np.ndarray:
    """``base`` to each of the powers ``at``, 0 to 2**32 - 1, modulo 2**64."""
    low, high = _steps(base)
    return low[at & (STEP - 1)] * high[at >> 16]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    low, high = _steps(base)
    return low[:n] if n <= STEP else (high[: -(-n // STEP), None] * low).ravel()[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes before each place; a span's difference, times the power of ``_R_INV`` at its
    start, is a hash of its bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    for lo in range(0, len(data), STEP):
        part = data[lo : lo + STEP]
        sums[lo + 1 : lo + 1 + len(part)] = (part.astype(np.uint64) + np.uint64(1)) * (_steps(_R)[0][: len(part)] * _steps(_R)[1][lo >> 16])
    return np.cumsum(sums, out=sums)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array; all separators are single bytes in UTF-8."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


CHUNK = 1 << 18  # bytes hashed at once: the working arrays are eight times as long


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending, disjoint), by prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + CHUNK, side="right")))
        n = int(end[to - 1]) - base
        sums = prefix_sums(data[base : base + n])
        out[at:to] = mix64((sums[end[at:to] - base] - sums[start[at:to] - base]) * power_at(_R_INV, start[at:to] - base))
        at = to
    return out


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams that start at each position where one fits."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m])
    return out
