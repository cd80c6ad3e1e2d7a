"""Stupid-backoff language model scores of every document under the counts of all other documents.

The relations are kept packed, so that a shuffled row holds thousands of n-grams rather than one:

1. blocks: runs of documents (compressed), dealt out by block id;
2. n-grams of a block: its distinct n-gram hashes of all orders, sorted, with counts, cut by leading bits of
   the hash into one row for each bucket - this is the map-side partial count and the probe side in one;
3. count tables: a bucket gathers its rows, sums the counts of equal hashes, and answers each block with the totals of
   the n-grams that the block asked for;
4. scores: a block lines its totals up with its documents' n-grams and sums the logarithms by document.

No table of all n-grams is ever in one place; a bucket and a block have bounded size when the number of buckets
follows the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.shared import chain, span_hashes, word_spans

BLOCK = 7 << 20  # bytes of text
PASSES = 4  # a block's n-grams are handled in so many ranges of the hash, to bound memory


def pack_counts(values: np.ndarray) -> bytes:
    """One byte a count; 255 stands for a larger one that follows at the end, in order."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype(np.uint64).tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n).astype(np.int64)
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers: the first, then differences in the fewest whole bytes that hold all of them."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    steps = np.zeros((1 + (len(raw) - 9) // raw[0], 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _words(offsets: np.ndarray, data: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The document of each word, and for n = 1 to order the n-gram hashes and whether one starts at each word."""
    # A separator between documents keeps words apart.
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 32, dtype=np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    start, end = word_spans(spaced)
    doc = np.searchsorted(offsets[:-1] + np.arange(n), start, side="right") - 1
    first = span_hashes(spaced, start, end)
    grams, fits = [], []
    for k in range(1, order + 1):
        h = np.zeros(len(first), np.uint64)
        ok = np.zeros(len(first), bool)
        if len(first) >= k:
            h[: len(first) - k + 1] = chain(first, k) >> np.uint64(64 - bits)
            ok[: len(first) - k + 1] = doc[k - 1 :] == doc[: len(doc) - k + 1]
        grams.append(h)
        fits.append(ok)
    return doc, grams, fits


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def backoff_scores(doc: np.ndarray, n_docs: int, fits: list[np.ndarray], others: list[np.ndarray], total: np.ndarray, backoff: float) -> np.ndarray:
    """Sum of log scores by document. ``others[n-1][i]``: count elsewhere of the n-gram that starts at word i;
    ``total``: words elsewhere, by document."""
    order, m = len(fits), len(doc)
    log = np.log(np.where(others[0] > 0, others[0], 1.0) / (total[doc] + (others[0] <= 0)))
    level = np.zeros(m, dtype=np.int64)  # the longest n found so far is level + 1
    for n in range(2, order + 1):
        at = np.flatnonzero(fits[n - 1]) + n - 1  # the last word of each n-gram
        seen = others[n - 1][at - n + 1] > 0
        hit = at[seen]
        log[hit] = np.log(others[n - 1][hit - n + 1] / others[n - 2][hit - n + 1])
        level[hit] = n - 1
    within = np.arange(m) - np.searchsorted(doc, doc, side="left") if m else level
    possible = np.minimum(within, order - 1)
    log += (possible - level) * np.log(backoff)
    return np.bincount(doc, weights=log, minlength=n_docs)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, buckets: int | None = None, hash_bits: int = 56) -> DataFrame:
    """Stupid-backoff score of each whole text: S(w | context) = c(context w) / c(context) for the longest context of
    up to ``order`` - 1 words with c(context w) > 0, times ``backoff`` for each word the context was cut by. c counts
    all documents but the scored one (else every n-gram would be found); a word that no other document has counts as
    1 / (words elsewhere + 1). Contexts do not reach into other documents.

    Null and empty texts have no words, log_score 0 and a null mean. Rows with equal ids are documents of their own;
    equal texts see each other, so they score high and alike. An empty table gives no rows; other columns stay behind.

    N-grams are known by ``hash_bits`` of a hash: n distinct ones are expected to hold n**2 / 2**(hash_bits + 1) pairs
    that are taken for each other; give 64 for corpora beyond some 10**9 n-grams. Blocks are made twice from ``docs``,
    so ``docs`` must give the same rows in the same partitions when read again (a table does); if it does not, the
    job fails rather than give wrong scores.

    Returns doc_id, n_words, log_score (sum of natural logarithms), mean_log_score.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    B = max(PASSES, buckets or 1 << (4 * parts - 1).bit_length())
    if B & (B - 1):
        raise ValueError("buckets is a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    shift = np.uint64(hash_bits - (B - 1).bit_length())
    edges = np.concatenate((np.zeros(1, np.uint64), np.arange(1, B, dtype=np.uint64) << shift, np.full(1, 2**64 - 1, np.uint64)))
    top = np.uint64(hash_bits - (PASSES - 1).bit_length())

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        ids: list[pa.Array] = []
        texts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            packed = zstandard.ZstdCompressor(level=3).compress(np.concatenate(texts).tobytes())
            own = pa.concat_arrays(ids)
            name = hashlib.blake2b(packed + repr(own.to_pylist()).encode(), digest_size=8).digest()
            return pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(name, signed=True)]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([size.astype(np.int64).tobytes()], pa.binary()), pa.array([packed], pa.binary())],
                names=["block", "ids", "sizes", "texts"],
            )

        for b in slices(batches, "text", BLOCK // 8):
            offsets, data = flat(b.column(1))
            ids.append(b.column(0))
            texts.append(data.copy())
            sizes.append(np.diff(offsets))
            held += len(data)
            if held >= BLOCK:
                yield out()
                ids, texts, sizes, held = [], [], [], 0
        if ids:
            yield out()

    def opened(sizes: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
        size = np.frombuffer(sizes, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(size.sum()))) if size.sum() else b""
        return np.concatenate(([0], np.cumsum(size))), np.frombuffer(raw, np.uint8)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, grams, fits = _words(*opened(b.column(2)[i].as_py(), b.column(3)[i].as_py()), order, hash_bits)
                words = np.bincount((grams[0] >> shift).astype(np.int64), minlength=B)
                grams = [g[ok] for g, ok in zip(grams, fits)]
                for k in range(PASSES):
                    every = np.concatenate([g[g >> top == k] for g in grams])
                    every.sort()
                    at = _runs(every)
                    count, every = np.diff(np.append(at, len(every))), every[at]
                    own = np.arange(k * B // PASSES, (k + 1) * B // PASSES)
                    cut = np.searchsorted(every, edges[[*own, own[-1] + 1]])
                    cut[-1] = len(every)
                    made = [(pack_sorted(every[x:y]), pack_counts(count[x:y])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), b.column(0).take(pa.array(np.full(len(own), i))), pa.array(words[own]), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())],
                        names=["bucket", "block", "words", "grams", "counts"],
                    )

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(g) for g in table.column("grams").to_pylist()]
        size = [len(a) for a in asked]
        counts = np.concatenate([unpack_counts(c, n) for c, n in zip(table.column("counts").to_pylist(), size)])
        every = np.concatenate(asked)
        where = np.argsort(every, kind="stable")
        at = _runs(every[where])
        totals = np.empty(len(every), np.int64)
        if len(every):
            totals[where] = np.repeat(np.add.reduceat(counts[where], at), np.diff(np.append(at, len(every))))
        ends = np.cumsum(size)
        words = sum(table.column("words").to_pylist())
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "words": pa.array(np.full(len(size), words)),
                "n": pa.array(size, pa.int64()),
                "totals": pa.array([pack_counts(totals[e - n : e]) for e, n in zip(ends.tolist(), size)], pa.binary()),
            }
        )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        right = right.sort_by("bucket").to_pydict()
        # Blocks that are equal in every byte have one name; each then reads the same answers, given once for each.
        copies = max(1, left.num_rows)
        if len(right["bucket"]) != B * left.num_rows:
            raise RuntimeError("the documents changed between two readings")
        first = range(0, len(right["bucket"]), copies)
        corpus = sum(right["words"][i] for i in first)
        for i in range(left.num_rows):
            offsets, data = opened(left.column("sizes")[i].as_py(), left.column("texts")[i].as_py())
            n_docs = len(offsets) - 1
            doc, grams, fits = _words(offsets, data, order, hash_bits)
            others = [np.zeros(len(doc), np.int64) for _ in fits]
            for k in range(PASSES):
                here = [np.flatnonzero(ok & (g >> top == k)) for g, ok in zip(grams, fits)]
                every = np.concatenate([g[h] for g, h in zip(grams, here)])
                where = np.argsort(every, kind="stable")
                gram, owner = every[where], np.concatenate([doc[h] for h in here])[where]
                if not len(gram):
                    continue
                totals = np.concatenate([unpack_counts(right["totals"][j], right["n"][j]) for j in first[k * B // PASSES : (k + 1) * B // PASSES]])
                new = np.concatenate(([True], gram[1:] != gram[:-1]))
                own = np.flatnonzero(new | np.concatenate(([True], owner[1:] != owner[:-1])))
                times = np.diff(np.append(own, len(gram)))
                elsewhere = np.empty(len(gram), np.int64)
                elsewhere[where] = totals[np.cumsum(new) - 1] - np.repeat(times, times)
                at = 0
                for other, h in zip(others, here):
                    other[h] = elsewhere[at : at + len(h)]
                    at += len(h)
            del grams
            n_words = np.bincount(doc, minlength=n_docs)
            log = backoff_scores(doc, n_docs, fits, others, (corpus - n_words).astype(np.float64), backoff)
            ids = left.column("ids").combine_chunks().slice(i, 1).flatten() if left.num_rows else None
            mean = pa.array(log / np.maximum(n_words, 1), mask=n_words == 0)
            made.append(pa.table({"doc_id": ids, "n_words": pa.array(n_words), "log_score": pa.array(log), "mean_log_score": mean}))
        return pa.concat_tables(made) if made else pa.table({"doc_id": pa.nulls(0, left.schema.field("ids").type.value_type), "n_words": pa.nulls(0, pa.int64()), "log_score": pa.nulls(0, pa.float64()), "mean_log_score": pa.nulls(0, pa.float64())})

    blocks = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(block, f"block long, ids array<{kind}>, sizes binary, texts binary")
    )
    asked = blocks.mapInArrow(ask, "bucket long, block long, words long, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, words long, n long, totals binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
