"""Language identification with string kernels.

A text is the set of its code point n-grams for n = 1 to 3 (the blended spectrum, by presence), with letters in lower
case and everything that is not a letter as one separator. The kernel of two texts is their sets' cosine. Nystrom's
method turns it into features: with landmarks L, phi(x) = K(x, L) (K(L, L) + e)^-1/2. Kernel ridge regression, one
language against the rest, is then ridge regression on phi, whose normal equations are sums over the training rows.
Scores come from products of presence matrices, landmark matrix and weights, a slice of documents at a time.

The sets are kept as bits of a table of 2**HASH_BITS places (a hashed presence kernel), so no vocabulary is gathered.
"""

from __future__ import annotations

import dataclasses
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.shared import row_struct

HASH_BITS = 14
SLICE = 1 << 20
UNDECIDED = "und"
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Lower-case code point of each letter (0 for anything else), made from the Unicode database on first use."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low[0])
        _fold = table
    return _fold


def _folded(data: np.ndarray) -> np.ndarray:
    return _folding()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)]


def presence(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of n-grams for each text, and whether it has a letter."""
    size, mask = 1 << HASH_BITS, np.uint32((1 << HASH_BITS) - 1)
    out = np.zeros((len(offsets) - 1, size), dtype=np.float32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    char = lead[offsets]
    points = _folded(data)
    if len(points) != char[-1]:  # not UTF-8: decode text by text
        pieces = [_folded(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        points, char = np.concatenate([*pieces, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    one = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = one.copy()
    two[1:] = (one[:-1] ^ one[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA6B) + one[1:]
    three = two.copy()
    three[2:] = (one[:-2] ^ one[:-2] >> np.uint32(13)) * np.uint32(0xC2B2AE35) + two[2:]
    blank = points == 0
    # A gram that is only separators says nothing, and runs of separators count as one.
    double = np.zeros(len(points), dtype=bool)
    double[1:] = blank[1:] & blank[:-1]
    triple = double.copy()
    triple[2:] |= double[1:-1]
    places = [(g ^ g >> np.uint32(16)) * np.uint32(0x45D9F3B + 2 * n) >> np.uint32(32 - HASH_BITS) & mask for n, g in enumerate((one, two, three))]
    ok = [~blank, ~double, ~triple]
    letters = np.zeros(len(out), dtype=bool)
    for i in range(len(out)):
        a, b = char[i], char[i + 1]
        row = out[i]
        for n in range(3):
            if b - a > n:
                row[places[n][a + n : b][ok[n][a + n : b]]] = 1
        letters[i] = not blank[a:b].all()
    return out, letters


@dataclasses.dataclass
class Model:
    """Landmark sets (unit rows), the map from landmark kernels to scores, and the languages in code point order."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]
    sharpness: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        return (x @ self.landmarks.T / norm) @ self.weights


def fit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", landmarks: int = 256, sample: int = 4000, ridge: float = 1e-3, sharpness: float = 8.0
) -> Model | None:
    """Learn from at most ``sample`` labelled rows (a documented bound): those with the least hash of the id.

    The first ``landmarks`` of them are the landmarks; only their texts come to the driver. The normal equations are
    summed on the executors, in eight matrices of landmarks x landmarks. None if no row is labelled.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")
    )
    least = [r.h for r in labelled.select("h").orderBy("h").limit(sample).collect()]
    if not least:
        return None
    base_rows = labelled.where(F.col("h") <= least[:landmarks][-1]).limit(landmarks).collect()
    base = _sets([r.text for r in sorted(base_rows)])
    unit = base / np.sqrt(np.maximum(base.sum(axis=1), 1))[:, None]
    value, vector = np.linalg.eigh((unit @ unit.T).astype(np.float64))
    kept = value > 1e-6 * value[-1]
    root = vector[:, kept] / np.sqrt(value[kept])
    chosen = labelled.where(F.col("h") <= least[-1]).limit(sample)
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    held = docs.sparkSession.sparkContext.broadcast((unit.astype(np.float32), root, languages))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, root, names = held.value
        gram, target, n = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names))), 0
        for b in slices(batches, "text", SLICE):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = presence(*flat(part.column(0)))[0]
                phi = (x @ unit.T / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]).astype(np.float64) @ root
                y = np.where(np.array(part.column(1).to_pylist())[:, None] == np.array(names), 1.0, -1.0)
                gram, target, n = gram + phi.T @ phi, target + phi.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([gram.tobytes()]), pa.array([target.tobytes()])], names=["n", "gram", "target"])

    # Eight sums reach the driver, into however many partitions the rows are dealt.
    parts = chosen.repartition(8, "h").coalesce(8).select("text", "lang").mapInArrow(sums, "n long, gram binary, target binary").collect()
    gram = sum(np.frombuffer(p.gram).reshape(root.shape[1], -1) for p in parts)
    target = sum(np.frombuffer(p.target).reshape(root.shape[1], -1) for p in parts)
    solved = np.linalg.solve(gram + ridge * sum(p.n for p in parts) * np.eye(len(gram)), target)
    return Model(unit.astype(np.float32), (root @ solved).astype(np.float32), languages, sharpness)


def _sets(texts: list[str]) -> np.ndarray:
    return presence(*flat(pa.array(texts, type=pa.large_string())))[0]


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """lang_pred and score of every whole text, beside the id; with ``carry`` beside the text and,
    as struct ``row``, all other columns, which so may have any name.

    The score is the softmax, times ``sharpness``, of the one-versus-rest values. Null texts, texts without a letter
    and, without a model, all texts are "und" with score 0. Ties go to the first language in code point order. Equal
    rows give equal rows; an empty table gives none.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # landmarks x 2**HASH_BITS floats, whatever the table's size
    own = row_struct(docs, text_col) if carry else F.col(id_col)
    names = ["row", "text"] if carry else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, "text", SLICE):
            for at in range(0, b.num_rows, 512):  # a row of the presence matrix has a fixed size
                part = b.slice(at, 512)
                if m is None:
                    best, score, ok = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                    known = [UNDECIDED]
                else:
                    x, ok = presence(*flat(part.column(part.num_columns - 1)))
                    s = m.scores(x).astype(np.float64)
                    del x  # the next is not made beside it
                    e = np.exp(m.sharpness * (s - s.max(axis=1, keepdims=True)))
                    best, known = s.argmax(axis=1), m.languages
                    score = np.where(ok, e.max(axis=1) / e.sum(axis=1), 0.0)
                lang = [known[k] if o else UNDECIDED for k, o in zip(best.tolist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, type=pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    rows = docs.select(own.alias("own"), F.col(text_col).alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in rows.columns]
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in zip(names, kinds)), "lang_pred string, score double"]))
