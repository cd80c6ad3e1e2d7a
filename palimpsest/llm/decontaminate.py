"""Benchmark decontamination by latent semantic retrieval.

Only words of the benchmark can tie a passage to it, so documents are read once into the places and numbers of such
words (a packed table in the shared folder). Passages are windows of 32 words, 16 apart. Their TF-IDF matrix A, over
all documents and the benchmark's own parts (weighed to count as much as all documents), gets a randomised SVD: one
distributed pass adds up A'(A G) for a Gaussian G, from which the leading right singular vectors follow by the Nystrom
formula (Halko, Martinsson and Tropp, 2011; Tropp et al., 2017). Coordinates are divided by the root of the singular
value. In that space, every window whose cosine with a part of an item is high enough is a candidate; so is, whatever its
cosine, every place that holds RUN words of an item in a row, which makes verbatim copies certain. A candidate stands if
the longest common subsequence of the item and the text around the window, and that of the item's answer (its last words),
are long enough; so changed, dropped and added words do not hide a passage.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.shared import chain, cut, release, row_key, span_hashes

STEP = 16  # words; a window is two steps
SLICE = 1 << 20
#: Words in more than this share of all steps weigh nothing, unless an item's part would keep fewer than LEAST words.
COMMON, LEAST = 0.01, 5
ITEM_BLOCK = 2000  # items handled in one go; what is broadcast is bounded by this
RUN = 6  # words in a row that make a candidate; an item of fewer words is one run
CHUNK = 64  # vocabulary rows of the sketch in one shuffled row

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _normal(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and two-byte Latin letters."""
    low = _LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        low[1:][capital] += 32
    return low


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and hash of each word: a run of letters, digits and bytes beyond ASCII."""
    n = len(offsets) - 1
    spaced = np.zeros(len(data) + n + 1, dtype=np.uint8)
    spaced[1 + np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _normal(data)
    inside = np.concatenate((_WORD[spaced], [False])).astype(np.int8)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    doc = np.searchsorted(offsets[:-1] + np.arange(n) + 1, start, side="right") - 1
    return doc, span_hashes(spaced, start, end)


@dataclasses.dataclass
class Items:
    """A block of benchmark items as word numbers."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes; a word's number is its place

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        offsets, data = flat(pa.array([t for _, t in rows], type=pa.large_string()))
        doc, hashes = words_of(offsets, data)
        vocabulary = np.unique(hashes)
        number = np.searchsorted(vocabulary, hashes)
        words = [number[doc == i] for i in range(len(rows))]
        full = [i for i, w in enumerate(words) if len(w)]
        return Items([rows[i][0] for i in full], [words[i] for i in full], vocabulary)

    def runs(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, the hashes of the items' runs, ascending, and the item of each."""
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, w in enumerate(self.words):
            r = min(RUN, len(w))
            found.setdefault(r, []).append((np.unique(chain(w.astype(np.uint64), r)), i))
        out = {}
        for r, own in found.items():
            hashes, items = np.concatenate([h for h, _ in own]), np.concatenate([np.full(len(h), i) for h, i in own])
            order = np.argsort(hashes, kind="stable")
            out[r] = (hashes[order], items[order])
        return out

    def parts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Windows of each item, the last one up to its end: item number and words."""
        owner, found = [], []
        for i, w in enumerate(self.words):
            for at in sorted({*range(0, max(1, len(w) - 2 * STEP), 2 * STEP), max(0, len(w) - 2 * STEP)}):
                owner.append(i)
                found.append(w[at : at + 2 * STEP])
        return np.array(owner), found


@dataclasses.dataclass
class Packed:
    """Words of the vocabulary in a slice of documents, by step: number, place in the document, step."""

    ids: pa.Array
    doc: np.ndarray
    place: np.ndarray
    word: np.ndarray

    def weighing(self, idf: np.ndarray) -> Packed:
        """Only words of some weight."""
        keep = idf[self.word] > 0
        return Packed(self.ids, self.doc[keep], self.place[keep], self.word[keep])

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's step (dense), and each step's document and number in it. Two neighbouring steps are a window."""
        key = self.doc * (1 << 40) + self.place // STEP
        own, at = np.unique(key, return_inverse=True)
        return at, own >> 40, own & ((1 << 40) - 1)


def _pack(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in slices(batches, "text", SLICE):
            offsets, data = flat(b.column(1))
            doc, hashes = words_of(offsets, data)
            number = np.searchsorted(known, hashes)
            hit = known[np.minimum(number, len(known) - 1)] == hashes
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = np.flatnonzero(np.bincount(doc[hit], minlength=b.num_rows))  # documents with a word of the benchmark
            dense = np.cumsum(np.bincount(keep, minlength=b.num_rows)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), b.column(0).take(pa.array(keep))),
                    pa.array([dense[doc[hit]].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([place[hit].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([number[hit].astype(np.int32).tobytes()], pa.binary()),
                ],
                names=["ids", "doc", "place", "word"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_squeezed(run), f"ids array<{kind}>, doc binary, place binary, word binary")


def _squeezed(run):
    """Compress the packed columns: they are written to the shared folder."""
    import zstandard

    def out(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([press.compress(x.as_py()) for x in b.column(i)], pa.binary()) for i in (1, 2, 3))], names=b.schema.names)

    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Packed]:
    import zstandard

    opener = zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(b.num_rows):
            doc, place, word = (np.frombuffer(opener.decompress(b.column(c)[i].as_py()), np.int32).astype(np.int64) for c in (1, 2, 3))
            yield Packed(b.column(0).slice(i, 1).flatten(), doc, place, word)


def _run_hits(p: Packed, runs: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, steps and items of the runs that documents hold."""
    docs, steps, items = [], [], []
    for r, (known, owner) in runs.items():
        m = len(p.word) - r + 1
        if m <= 0:
            continue
        # Words that follow each other in the document, all of them of the benchmark's vocabulary.
        whole = (p.doc[r - 1 :] == p.doc[:m]) & (p.place[r - 1 :] == p.place[:m] + r - 1)
        at = np.flatnonzero(whole)
        h = chain(p.word.astype(np.uint64), r)[at]
        lo, hi = np.searchsorted(known, h), np.searchsorted(known, h, side="right")
        n = hi - lo
        hit = np.flatnonzero(n)
        spot = np.repeat(at[hit], n[hit])
        which = owner[np.repeat(lo[hit], n[hit]) + np.arange(int(n[hit].sum())) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])]
        docs.append(p.doc[spot]), steps.append(p.place[spot] // STEP), items.append(which)
    z = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(steps), np.concatenate(items)) if docs else (z, z, z)


def _window_sums(step: np.ndarray, doc: np.ndarray, no: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` (one for each word, in order of step) by window: step i and, if it has words, the next one."""
    first = np.flatnonzero(np.diff(step, prepend=-1))
    sums = np.add.reduceat(rows, first, axis=0)
    follows = np.flatnonzero((doc[1:] == doc[:-1]) & (no[1:] == no[:-1] + 1))
    out = sums.copy()
    out[follows] += sums[follows + 1]
    return out


def _weights(count: np.ndarray, total: int, parts: list[np.ndarray]) -> np.ndarray:
    """IDF of each word, 0 for common ones. The bound for those rises until each part has LEAST words that weigh."""
    idf = np.log((total + 1) / (count + 0.5)).clip(1e-3)
    share = count / max(total, 1)
    bound = max([COMMON, *(float(np.sort(share[p])[min(len(p), LEAST) - 1]) for p in parts)])
    return np.where(share <= bound, idf, 0).astype(np.float32)


def fit_space(packed: DataFrame, items: Items, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the vocabulary over all steps of all documents, and the word vectors in the latent space. The driver
    gets sums: a number, then ``rank`` + 9 numbers, for each word of the vocabulary."""
    size, (_, parts) = len(items.vocabulary), items.parts()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(size, np.int64), 0
        for p in _unpacked(batches):
            step, doc, _ = p.steps()
            count += np.bincount(np.unique(step * size + p.word) % size, minlength=size)
            total += len(doc)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(count[there], total))], names=["word", "n"])

    seen = {r.word: r.n for r in packed.mapInArrow(frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    count = np.array([seen.get(i, 0) for i in range(size)], dtype=np.float64)
    idf = _weights(count, seen.get(-1, 0), parts)
    width = min(size, rank + 8)
    probe = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    held = packed.sparkSession.sparkContext.broadcast((idf, probe))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, probe = held.value
        weighted = idf[:, None] * probe
        total = np.zeros((size, width + 1))
        for p in _unpacked(batches):
            p = p.weighing(idf)
            if not len(p.word):
                continue
            step, doc, no = p.steps()
            windows = _window_sums(step, doc, no, weighted[p.word])
            back = windows.copy()  # a word takes part in the window of its own step and in the one before
            follows = np.flatnonzero((doc[1:] == doc[:-1]) & (no[1:] == no[:-1] + 1))
            back[follows + 1] += windows[follows]
            order = np.argsort(p.word, kind="stable")
            by = p.word[order]
            first = np.flatnonzero(np.diff(by, prepend=-1))
            total[by[first], :width] += np.add.reduceat(back[step[order]], first, axis=0)
            total[:, width] += np.bincount(p.word, minlength=size) * idf
        total *= idf[:, None]
        cuts = range(0, size, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(cuts)))), pa.array([total[i : i + CHUNK].tobytes() for i in cuts], pa.binary())], names=["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partial sums: each task holds one vocabulary x width matrix at most.
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(part.as_py())
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "part"])

    shape = "chunk long, part binary"
    rows = packed.mapInArrow(sketch, shape).repartition("chunk").mapInArrow(add, shape).collect()
    y = np.zeros((size, width + 1))
    for r in rows:
        part = np.frombuffer(r.part).reshape(-1, width + 1)
        y[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] += part
    own = np.zeros((len(parts), size))
    for row, part in zip(own, parts):
        np.add.at(row, part, idf[part])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    trace = max(2 * float(y[:, width].sum()), 1.0)  # of A'A; each word is in two windows
    y = y[:, :width] + trace / len(parts) * (own.T @ (own @ probe))
    return idf, idf[:, None] * nystrom(y, probe.astype(np.float64), rank)


def nystrom(y: np.ndarray, probe: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix M from y = M probe, each over the fourth root of its eigenvalue."""
    nu = 1e-10 * (np.linalg.norm(y) + 1e-30)
    y = y + nu * probe
    core = probe.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value[-1] * 1e-12
    half = y @ (vector[:, keep] / np.sqrt(value[keep]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    n = min(rank, int((s > 1e-9 * s[0]).sum()) or 1)
    return (u[:, :n] / np.sqrt(np.maximum(s[:n], 1e-30))).astype(np.float32)


def common(masks: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence with a word sequence given as bit masks of its places."""
    state = 0
    for w in words:
        m = masks.get(w)
        if m is not None:
            x = state | m
            state = x & ~(x - (state << 1 | 1))
    return state.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rank: int = 128,
    min_cosine: float = 0.45,
    min_common: float = 0.7,
    answer_words: int = 5,
    min_answer: float = 0.6,
) -> DataFrame:
    """One row for each document and benchmark item that it holds, verbatim or reworded.

    Benchmark items are a stated query set, taken in blocks of ``ITEM_BLOCK``; all documents are searched for each
    block. Words are compared without case and punctuation. Null or empty texts and items match nothing; equal items
    are reported each; documents with equal ids share rows; empty tables give no rows; other columns stay behind.

    Returns doc_id, item_id, first_word (place of the best window), cosine, common_share, answer_share.
    """
    query = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    blocks = max(1, -(-query.count() // ITEM_BLOCK))
    found = None
    release(docs.sparkSession)
    for k in range(blocks):
        part = query if blocks == 1 else query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        one = _find(docs, Items.of([(r.item_id, r.text) for r in part.collect()]), query.schema["item_id"].dataType.simpleString(), id_col, text_col, rank, min_cosine, min_common, answer_words, min_answer)
        found = one if found is None else found.unionByName(one)
    return found


def _find(docs, items, item_kind, id_col, text_col, rank, min_cosine, min_common, answer_words, min_answer) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, cosine double, common_share double, answer_share double"
    if not items.ids:
        return spark.createDataFrame([], schema)
    packed = cut(_pack(docs, id_col, text_col, items.vocabulary))
    idf, weighted = fit_space(packed, items, rank)
    owner, parts = items.parts()
    queries = np.stack([weighted[p].sum(axis=0) for p in parts])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    held = spark.sparkContext.broadcast((items, idf, weighted, owner, queries.astype(np.float32)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, weighted, owner, queries = held.value
        masks = [_masks(w) for w in items.words]
        answers = [_masks(w[-answer_words:]) for w in items.words]
        runs = items.runs()
        first_part = np.searchsorted(owner, np.arange(len(items.words) + 1))
        for full in _unpacked(batches):
            p = full.weighing(idf)
            if len(p.word):
                step, doc, no = p.steps()
                windows = _window_sums(step, doc, no, weighted[p.word])
                norm = np.linalg.norm(windows, axis=1)
                cosine = windows @ queries.T / np.maximum(norm, 1e-9)[:, None]
            else:
                doc, no, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(owner)), np.float32)
            at, query = np.nonzero(cosine >= min_cosine)
            d_run, s_run, i_run = _run_hits(full, runs)
            window = doc * (1 << 40) + no
            best: dict[tuple[int, int], tuple] = {}
            bounds = np.searchsorted(full.doc, np.arange(len(p.ids) + 1))
            tried = set()
            for d, s, i in zip(np.concatenate((doc[at], d_run)).tolist(), np.concatenate((no[at], s_run)).tolist(), np.concatenate((owner[query], i_run)).tolist()):
                if (d, s, i) in tried:
                    continue
                tried.add((d, s, i))
                n = len(items.words[i])
                lo, hi = s * STEP - n, (s + 2) * STEP + n
                own = slice(bounds[d], bounds[d + 1])
                places = full.place[own]
                region = full.word[own][np.searchsorted(places, lo) : np.searchsorted(places, hi)].tolist()
                share = common(masks[i], region) / n
                if share < min_common:
                    continue
                ending = common(answers[i], region) / min(n, answer_words)
                if ending >= min_answer:
                    w = int(np.searchsorted(window, d * (1 << 40) + s))
                    near = float(cosine[w, first_part[i] : first_part[i + 1]].max()) if w < len(window) and window[w] == d * (1 << 40) + s else 0.0
                    row = (share, ending, near, -s * STEP)
                    best[d, i] = max(best.get((d, i), row), row)
            if best:
                keys = list(best)
                columns = list(zip(*best.values()))
                yield pa.RecordBatch.from_arrays(
                    [p.ids.take(pa.array([d for d, _ in keys])), pa.array([items.ids[i] for _, i in keys]), pa.array([-x for x in columns[3]], pa.int64()), pa.array(columns[2]), pa.array(columns[0]), pa.array(columns[1])],
                    names=["doc_id", "item_id", "first_word", "cosine", "common_share", "answer_share"],
                )

    return packed.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept, whatever their names. Rows are judged by their own text,
    whatever other rows have the same id, or none; null and empty texts hold nothing and stay; equal rows go or stay
    together; without items all rows stay; an empty table gives none."""
    named = docs.select(F.struct(*docs.columns).alias("row"), row_key(docs).alias("key"), F.col(text_col).alias("text"))
    hits = find_contaminated(named, benchmark, id_col="key", text_col="text", **options).select(F.col("doc_id").alias("key")).distinct()
    return named.join(hits, "key", "left_anti").select("row.*")
