"""Document quality by a linear-chain conditional random field over lines.

Each line is a place in a chain with the states bad and good. A line's potential comes from its own features and those
of the lines before and after it; a 2 x 2 table links neighbouring states. Training maximises the likelihood of chains
whose lines all carry their document's label. Scoring runs forward-backward and weighs each line's marginal by the
line's length. Chains of many documents run in step: line i of all of them at once.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.shared import row_struct, span_hashes, word_spans

SLICE = 1 << 20
NAMES = ("length", "words", "word_length", "longest", "letters", "digits", "upper", "stops", "marks", "bars", "bangs", "distinct", "repeated", "ends", "capital", "odd_words", "first", "last")

_CLASS = {name: np.zeros(256, dtype=np.uint8) for name in ("letters", "digits", "upper", "stops", "marks", "bars", "bangs")}
_CLASS["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS["digits"][48:58] = 1
_CLASS["upper"][65:91] = 1
_CLASS["stops"][[ord(c) for c in ".,;:?'\"()-"]] = 1
_CLASS["marks"][[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 1
_CLASS["bars"][ord("|")] = 1
_CLASS["bangs"][ord("!")] = 1


def lines_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every line that has a word."""
    feeds = np.flatnonzero(data == 10) + 1
    begin = np.unique(np.concatenate((offsets[:-1], feeds, [0]))).astype(np.int64)
    begin = begin[begin < len(data)]
    end = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    start_word, _ = word_spans(data)
    full = np.searchsorted(start_word, end) > np.searchsorted(start_word, begin)
    begin, end = begin[full], end[full]
    return np.searchsorted(offsets, begin, side="right") - 1, begin, end


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features (rows of NAMES), the document of each line and its length in bytes."""
    doc, begin, end = lines_of(offsets, data)
    n = len(begin)
    out = np.zeros((n, len(NAMES)), dtype=np.float32)
    if not n:
        return out, doc, begin
    size = end - begin
    cuts = np.column_stack((begin, end)).ravel()

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(values, values[:1] * 0), cuts, dtype=np.int64)[::2]

    col = {name: i for i, name in enumerate(NAMES)}
    letters = None
    for name, table in _CLASS.items():
        held = table[data]
        if name == "upper":  # two-byte capitals of Latin scripts: C3 80 to C3 9E
            held[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        count = total(held)
        letters = count if name == "letters" else letters
        out[:, col[name]] = count / np.maximum(letters if name == "upper" else size, 1)
    start_word, end_word = word_spans(data)
    lo, hi = np.searchsorted(start_word, begin), np.searchsorted(start_word, end)
    words = hi - lo
    line = np.repeat(np.arange(n), words)
    long = (end_word - start_word)[lo[0] : hi[-1]]
    at = np.cumsum(words) - words
    hashes = span_hashes(data, start_word, end_word)
    order = np.lexsort((hashes[lo[0] : hi[-1]], line))
    by, same = line[order], hashes[lo[0] : hi[-1]][order]
    fresh = np.concatenate(([True], (by[1:] != by[:-1]) | (same[1:] != same[:-1])))
    out[:, col["length"]] = np.log1p(size)
    out[:, col["words"]] = np.log1p(words)
    out[:, col["word_length"]] = np.add.reduceat(long, at) / words
    out[:, col["longest"]] = np.log1p(np.maximum.reduceat(long, at))
    out[:, col["distinct"]] = np.bincount(by[fresh], minlength=n) / words
    closing = data[end_word[lo[0] : hi[-1]] - 1]
    odd = (_CLASS["marks"][closing] | _CLASS["bars"][closing] | _CLASS["bangs"][closing]).astype(np.int64)
    out[:, col["odd_words"]] = np.add.reduceat(odd, at) / words
    final = data[end_word[hi - 1] - 1]
    out[:, col["ends"]] = np.isin(final, [ord(c) for c in ".?!:\"'"])
    opening = data[start_word[lo]]
    out[:, col["capital"]] = (_CLASS["upper"][opening] | (opening == 0xC3)) != 0
    line_hash = span_hashes(data, start_word[lo], end_word[hi - 1])
    order = np.lexsort((line_hash, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    out[order[1:][twin], col["repeated"]] = 1
    out[order[:-1][twin], col["repeated"]] = 1
    edge = np.diff(doc, prepend=-1, append=-1) != 0
    out[:, col["first"]], out[:, col["last"]] = edge[:-1], edge[1:]
    return out, doc, size


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after in its document (0 where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.hstack((x, before, after))


LONG = 512  # lines that are gone through one by one; longer documents are cut into chains of so many


def _steps(size: np.ndarray) -> list[int]:
    """How many of some sequences, the longest first, have a line at each place."""
    return (len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")).tolist()


def _forward(emit: np.ndarray, first: np.ndarray, size: np.ndarray, enter: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences, the longest first, with weights ``enter`` before their first line: each line's weights scaled to 1,
    the scales, and each sequence's last weights."""
    alpha, scale, end = np.empty((len(emit), 2)), np.ones(len(emit)), enter.copy()
    for i, m in enumerate(_steps(size)):
        at = first[:m] + i
        v = (enter[:m] if i == 0 else end[:m] @ move) * emit[at]
        scale[at] = c = v.sum(axis=1)
        alpha[at] = end[:m] = v / c[:, None]
    return alpha, scale, end


def _backward(emit: np.ndarray, first: np.ndarray, size: np.ndarray, leave: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the end: the weights of all after each line, and of all from each sequence's first line on."""
    beta, steps = np.empty((len(emit), 2)), _steps(size)
    now = leave.copy()
    last = first + size - 1
    for i in range(len(steps)):
        m = steps[i]
        at = last[:m] - i
        beta[at] = now[:m]
        v = (now[:m] * emit[at]) @ move.T
        now[:m] = v / v.sum(axis=1, keepdims=True)
    return beta, now


def _chained(emit: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward weights and forward scales. Chains of a long document are gone through side by side: once
    from either state to learn what each makes of any weights, then with the weights that they have."""
    chains = -(-size // LONG)
    doc = np.repeat(np.arange(len(size)), chains)
    no = np.arange(len(doc)) - np.repeat(np.cumsum(chains) - chains, chains)
    begin = first[doc] + no * LONG
    length = np.minimum(LONG, first[doc] + size[doc] - begin)
    order = np.argsort(-length, kind="stable")
    enter, leave = np.ones((len(doc), 2)), np.ones((len(doc), 2))
    if len(doc) > len(size):
        # ahead[c, k]: the weights at the end of chain c, and by how much, if only state k stood before its first line.
        ahead, weight = np.empty((len(doc), 2, 2)), np.empty((len(doc), 2))
        for k in range(2):
            unit = np.full((len(doc), 2), 1e-300)
            unit[:, k] = 1
            _, scale, end = _forward(emit, begin[order], length[order], unit, move)
            ahead[order, k], weight[:, k] = end, np.add.reduceat(np.log(scale), begin)
        ahead *= np.exp(weight - weight.max(axis=1, keepdims=True))[:, :, None]
        for j in range(1, int(chains.max())):
            at = np.flatnonzero(no == j)
            end = np.einsum("ij,ijk->ik", enter[at - 1], ahead[at - 1])
            enter[at] = end / end.sum(axis=1, keepdims=True) @ move
        for j in range(int(chains.max()) - 2, -1, -1):
            at = np.flatnonzero((no == j) & (no < chains[doc] - 1))
            # What follows a chain: the next chain's matrix applied to what follows that.
            v = np.einsum("ijk,ik->ij", ahead[at + 1], leave[at + 1]) @ move.T
            leave[at] = v / v.sum(axis=1, keepdims=True)
    alpha, scale, _ = _forward(emit, begin[order], length[order], enter[order], move)
    beta, _ = _backward(emit, begin[order], length[order], leave[order], move)
    return alpha, beta, scale


def marginals(s: np.ndarray, doc: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected number of each pair of neighbouring states, log of all weights.

    ``s``: how far good stands above bad at each line; ``doc``: ascending; ``link[a, b]``: from state a to b.
    """
    n = len(s)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    size = np.diff(np.append(first, n))
    emit = np.stack((np.exp(np.minimum(-s, 0)), np.exp(np.minimum(s, 0))), axis=1)  # (1, e^s) over its largest
    move = np.exp(link - link.max())
    alpha, beta, scale = _chained(emit, first, size, move)
    log_z = float(np.maximum(s, 0).sum()) + float(link.max()) * (n - len(size)) + float(np.log(scale).sum())
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = alpha[inner][:, :, None] * move * (emit * beta)[inner + 1][:, None, :]
    pairs = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs, log_z


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant
    link: np.ndarray
    prior: float

    def lift(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.spread, doc) @ self.weights[:-1] + self.weights[-1]

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Length-weighted marginals by document; a document without a line gets the share of good ones in training."""
        x, doc, size = features(offsets, data)
        good, _, _ = marginals(self.lift(x, doc), doc, self.link)
        n = len(offsets) - 1
        weight = np.bincount(doc, weights=size, minlength=n)
        return np.where(weight > 0, np.bincount(doc, weights=size * good, minlength=n) / np.maximum(weight, 1), self.prior)


def train(x: np.ndarray, doc: np.ndarray, label: np.ndarray, *, rounds: int = 150, penalty: float = 1e-2, rate: float = 0.1) -> Model:
    """Gradient ascent with per-weight steps on the penalised likelihood a document. ``label``: 0/1 of each document."""
    docs = len(label)
    mean, spread = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    z = with_neighbours((x - mean) / spread, doc).astype(np.float64)
    z = np.hstack((z, np.ones((len(z), 1))))
    y = label[doc].astype(np.float64)
    size = np.bincount(doc, minlength=docs)
    steps = np.maximum(size - 1, 0)
    told = np.diag([float(steps[label == 0].sum()), float(steps[label == 1].sum())])
    # A document counts alike whatever its number of lines.
    theta = np.zeros(z.shape[1] + 4)
    theta[-4:] = (0.5, 0, 0, 0.5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, pairs, _ = marginals(z @ theta[:-4], doc, theta[-4:].reshape(2, 2))
        grad = np.concatenate((z.T @ (y - good), (told - pairs).ravel())) / max(docs, 1) - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), float(label.mean()) if docs else 0.5)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, rounds: int = 150) -> Model:
    """Learn from at most ``sample`` labelled rows (a documented bound: those with the least hash of the id).

    Line features are made on the executors; the sample's features come to the driver, which fits some 60 weights.
    Rows without a label or a text are left out; without any row the model says 0.5 everywhere.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("long").alias("label"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")
    )
    least = [r.h for r in rows.select("h").orderBy("h").limit(sample).collect()]
    if not least:
        return train(np.zeros((0, len(NAMES)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), rounds=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            x, doc, _ = features(*flat(b.column(0)))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], type=pa.binary())], names=["label", "h", "x"])

    got = rows.where(F.col("h") <= least[-1]).limit(sample).select("text", "label", "h").mapInArrow(run, "label long, h long, x binary").collect()
    got.sort(key=lambda r: (r.h, r.label, bytes(r.x)))
    parts = [np.frombuffer(r.x, dtype=np.float32).reshape(-1, len(NAMES)) for r in got]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return train(np.concatenate(parts), doc, np.array([int(r.label > 0) for r in got]), rounds=rounds)


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """score and predicted (1 from 0.5 on) of every whole text, beside the id; with ``carry`` beside the text and,
    as struct ``row``, all other columns, which so may have any name.

    Null and empty texts and texts without a word get the model's prior. Equal rows give equal rows; an empty table
    gives none; other columns stay behind.
    """
    own = row_struct(docs, text_col) if carry else F.col(id_col)
    names = ["row", "text"] if carry else [id_col]
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 100 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            score = np.clip(held.value.scores(*flat(b.column(b.num_columns - 1))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    rows = docs.select(own.alias("own"), F.col(text_col).alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in rows.columns]
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in zip(names, kinds)), "score double, predicted int"]))
