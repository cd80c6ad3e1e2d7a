"""SimHash near duplicates: fingerprints of 3-word shingles, joined on pigeonhole blocks and verified by Hamming distance.

Fingerprints that differ in at most ``distance`` bits agree in one of ``distance + 1`` blocks of bits, so every distinct
fingerprint is filed under each of its blocks. A block that many fingerprints share (near copies of one text do) is not
multiplied out: what it holds still differs in at most ``distance`` of the bits left, so it is filed again under blocks
of those bits, until no group has more than ``CELL`` members. A group then has so few that a task compares all of them;
it sends a spanning forest of the links that it found, never all pairs. No link is lost and nothing is capped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.components import components
from palimpsest.llm.shared import cut, release, word_spans

SHINGLE = 3
SEED = 42
SLICE = 1 << 20
COUNTED = 1 << 14  # shingles whose bits are counted at once
CELL = 512  # members of a group that a task compares; groups of 9 free bits have no more

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def simhashes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a flat column; 0 for texts without words."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 32, dtype=np.uint8)  # a space after each text, so that no word goes on into the next
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _FOLD[data]
    start, end = word_spans(spaced)
    doc = np.searchsorted(offsets[:-1] + np.arange(n), start, side="right") - 1
    # The words again, each followed by one space.
    length = end - start
    joined = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    word = np.repeat(np.arange(len(length)), length)
    own = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(word))
    joined[np.arange(len(word)) + word] = spaced[own]
    stop = np.cumsum(length + 1) - 1
    begin = stop - length
    # A shingle begins at each word that has two more of its text behind it, or at the first of a shorter text.
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    at = np.arange(len(doc)) - first[doc]
    opens = np.flatnonzero((at + SHINGLE <= words[doc]) | (at == 0))
    closes = np.minimum(opens + SHINGLE, (first + words)[doc[opens]]) - 1
    owner = doc[opens]
    ones = np.zeros((n, 64), dtype=np.int64)
    raw = joined.tobytes()
    for k in range(0, len(opens), COUNTED):
        spans = zip(begin[opens[k : k + COUNTED]].tolist(), stop[closes[k : k + COUNTED]].tolist())
        h = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = owner[k : k + COUNTED]
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ones[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    over = 2 * ones > np.bincount(owner, minlength=n)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text; null, empty and blank texts have 0. Equal rows give equal
    rows, other columns stay behind, an empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhashes(*flat(b.column(1))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@functools.cache
def blocks(mask: int, n: int) -> tuple[int, ...]:
    """``mask`` with one of ``n`` nearly equal runs of its unset bits added, for each run."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * i // n for i in range(n + 1)]
    return tuple(mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:]))


def _filed(rows: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint of (mask, fp) under each block of the bits that its mask leaves: (mask, key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, fp = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
            for m in np.unique(mask).tolist():
                own = fp[mask == np.uint64(m)]
                for finer in blocks(m, distance + 1):
                    key = own & np.uint64(finer)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), finer, np.uint64).view(np.int64)), pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=["mask", "key", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask long, key long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links (i, j) connect it with."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _compared(filed: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all members of a group that hang together by ``distance`` bits or fewer."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        rest = None
        for b in batches:
            now = [np.asarray(b.column(i)) for i in range(3)]
            rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            if not len(rest[0]):
                continue
            other = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            last = int(other[-1]) + 1 if len(other) else 0  # the last group may go on; it is short
            if last:
                yield tuple(x[:last] for x in rest)
                rest = [x[last:] for x in rest]
        if rest and len(rest[0]):
            yield tuple(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, key, fp in groups(batches):
            begin = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            size = np.diff(np.append(begin, len(fp)))
            left = np.repeat(begin + size, size) - np.arange(len(fp))  # members from here to the group's end
            bits, root = fp.view(np.uint64), np.arange(len(fp))
            i = np.arange(len(fp))
            for d in range(1, int(size.max())):
                i = i[left[i] > d]
                near = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= distance]
                if len(near):  # what is joined so far stays joined
                    root = forest(np.concatenate((near, np.arange(len(fp)))), np.concatenate((near + d, root)), len(fp))
            joined = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[root[joined]])], names=["a", "b"])

    # Dealt by a hash of mask and key, not by them: an earlier join by these would be taken for the dealing, and adaptive
    # execution may broadcast that join's other side and leave the rows where they are.
    parts = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return filed.repartition(parts, F.xxhash64("mask", "key")).sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")


def link_fingerprints(fps: DataFrame, *, distance: int = 3, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all that hang together by ``distance`` bits or fewer.

    A link joins fingerprints at most ``distance`` apart or such as a chain of those joins; of a group's links only a
    spanning forest is returned.
    """
    spark = fps.sparkSession
    links, going = None, fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        filed = cut(_filed(going, distance))
        # Once no more bits are free than may differ, a group is small and its members all link.
        large = filed.where(F.bit_count("mask") < 64 - distance).groupBy("mask", "key").agg(F.count("*").alias("n"))
        large = cut(large.where(F.col("n") > cell).select("mask", "key"))
        done = large.isEmpty()
        found = cut(_compared(filed if done else filed.join(large, ["mask", "key"], "left_anti"), distance).distinct())
        links = found if links is None else links.unionByName(found)
        if done:
            return links
        going = filed.join(large, ["mask", "key"], "left_semi")
        release(spark)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, cell: int = CELL) -> DataFrame:
    """Each document's fingerprint and component: the smallest id that links lead to, its own included.

    Words are runs of bytes other than white space, with A-Z in lower case; repeated shingles count each time; texts of
    one or two words are one shingle. Null, empty and blank texts have fingerprint 0 and link like any other. Equal
    fingerprints link, also across equal ids; null ids count only where no other id is in the component. Other columns
    stay behind; an empty table gives no rows.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id.
    """
    summary = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    classes = cut(summary.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(classes.select("fp"), distance=distance, cell=cell))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(lowest, "root").select("fp", "component_id")
    return summary.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
