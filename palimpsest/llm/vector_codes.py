"""Vector code compression: product quantisation in integers, entries filtered by segment-mean lower bounds.

A vector is cut into equal parts; each part is known by the index of its nearest codebook entry. With segment means m
and residual norms r (of what a segment differs from its mean), len * (m_x - m_c)^2 + (r_x - r_c)^2 summed over
segments never exceeds the squared distance. The coarse bound (one segment) is taken for all entries, finer ones for
those that it leaves, and exact integer distances for the survivors. Codebooks are small and broadcast; each round sums
parts by entry in the tasks, so a few thousand sums are shuffled however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 26  # larger components count as this, so that squared distances stay within 64 bits
ROWS = 4096  # vectors whose bounds are taken at once


def segments(width: int) -> list[list[tuple[int, int]]]:
    """Cuts of a part of ``width`` components, coarse to fine: one segment, two, four, as long as each has two."""
    out, n = [], 1
    while n == 1 or 2 * n <= width:
        out.append([(width * k // n, width * (k + 1) // n) for k in range(n)])
        n *= 2
    return out


def moments(x: np.ndarray, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean, times the root of the length, and residual norm of every segment of every row."""
    means, norms = np.empty((len(x), len(cuts))), np.empty((len(x), len(cuts)))
    for k, (a, b) in enumerate(cuts):
        own = x[:, a:b].astype(np.float64)
        mean = own.mean(axis=1) if b > a else np.zeros(len(x))
        means[:, k] = mean * np.sqrt(b - a)
        norms[:, k] = np.sqrt(((own - mean[:, None]) ** 2).sum(axis=1))
    return means, norms


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row (long integers) the nearest entry, the first on a tie, and its squared distance; and how many exact
    distances it took. Bounds are floating point, so they filter with a margin that their rounding can't reach."""
    levels = segments(x.shape[1])
    mx, rx = moments(x, levels[0])
    mc, rc = moments(book, levels[0])
    bound = (mx - mc.T) ** 2 + (rx - rc.T) ** 2
    guess = bound.argmin(axis=1)
    most = ((x - book[guess]) ** 2).sum(axis=1)  # no nearest entry is farther than this
    row, entry = np.nonzero(bound * (1 - 1e-9) - 1 <= most[:, None])
    for cuts in levels[1:]:
        (mx, rx), (mc, rc) = moments(x, cuts), moments(book, cuts)
        bound = ((mx[row] - mc[entry]) ** 2 + (rx[row] - rc[entry]) ** 2).sum(axis=1)
        stay = bound * (1 - 1e-9) - 1 <= most[row]
        row, entry = row[stay], entry[stay]
    exact = np.full((len(x), len(book)), np.iinfo(np.int64).max)
    exact[row, entry] = ((x[row] - book[entry]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(x)), best], np.bincount(row, minlength=len(x))


def integers(vector: Column) -> Column:
    """floor(256 x) of every component, null where the vector is null or has null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")
    return F.when(fine, F.transform(vector, whole))


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * k // parts, width * (k + 1) // parts) for k in range(parts)]


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            some = b.slice(at, ROWS)
            yield some, np.asarray(some.column(column).flatten(), dtype=np.int64).reshape(some.num_rows, -1)


def _improved(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of the means of their parts; unused entries stay."""
    held = kept.sparkSession.sparkContext.broadcast(books)
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        cuts = _cuts(width, len(books))
        sums, count = [np.zeros_like(b) for b in books], np.zeros((len(books), len(books[0])), np.int64)
        for _, x in _matrices(batches, 0):
            for p, (a, b) in enumerate(cuts):
                best, _, _ = nearest(x[:, a:b], books[p])
                np.add.at(sums[p], best, x[:, a:b])
                count[p] += np.bincount(best, minlength=len(books[p]))
        part, entry = np.nonzero(count)
        made = [sums[p][e].tolist() for p, e in zip(part.tolist(), entry.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(made, pa.list_(pa.int64())), pa.array(count[part, entry])], names=["part", "entry", "sums", "n"])

    found = kept.select("q").mapInArrow(run, "part long, entry long, sums array<long>, n long")
    most = max(b.shape[1] for b in books)
    total = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(most)]
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows
        out[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(out[r.part].shape[1])]
    return out


def encode_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the final codebook of each part.

    Components become floor(256 x); rows whose vector is null or holds null or non-finite components go. Codebooks
    start as the parts of the ``entries`` smallest ids (nulls last, repeated ids by their components; fewer rows, fewer
    entries). A vector whose length differs from that of the first of those has no place in the codebooks and goes too.
    Lengths that ``parts`` does not divide are cut as evenly as can be. Components beyond 2**26 count as 2**26. Equal
    rows give equal rows; other columns stay behind; an empty table gives no rows and no codebooks.

    The table returned has vec_id, label, code (two hexadecimal digits a part, more if there are over 256 entries),
    error (squared distance to the entries), compared (exact distances that filtering left).
    """
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integers(F.col(vector_col)).alias("q")).where("q IS NOT NULL")
    first = slim.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    width = len(first[0].q) if first else 0
    cuts = _cuts(width, parts)
    first = [r.q for r in first if len(r.q) == width]
    first = np.array(first, dtype=np.int64).reshape(len(first), width)
    schema = f"vec_id {id_kind}, label {label_kind}, code string, error long, compared long"
    if not len(first):
        return slim.sparkSession.createDataFrame([], schema), []
    kept = slim.where(F.size("q") == width)
    books = [first[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds if width else 0):
        books = _improved(kept, books)
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        digits = max(2, len(f"{len(books[0]) - 1:x}"))
        for some, x in _matrices(batches, 2):
            x = x.reshape(some.num_rows, width)
            code, error, compared = [], np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p, (a, b) in enumerate(cuts):
                best, far, n = nearest(x[:, a:b], books[p])
                code.append(best)
                error += far
                compared += n
            text = ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack(code, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(text, pa.string()), pa.array(error), pa.array(compared)], names=["vec_id", "label", "code", "error", "compared"])

    return kept.select("vec_id", "label", "q").mapInArrow(run, schema), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded_table(vectors: DataFrame, **options) -> DataFrame:
    """``encode_vectors`` as one table: vec_id, code, error, label_error (errors summed over equal labels, nulls together),
    codebooks_sha256. Sums are made in the tasks before they are shuffled and joined back, so a hot label is no one's load."""
    told, books = encode_vectors(vectors, **options)
    told = cut(told.select("vec_id", "label", "code", "error"))
    sums = told.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = told.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
