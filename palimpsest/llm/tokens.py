"""Token counts by section: encode each whole document once, place every token on the text, join tokens to sections.

A byte-level vocabulary gives each token's length in bytes, so the running sum of lengths places the tokens without
decoding. The interval join is a binary search of all token starts and ends of a slice of documents in the sections'
starts.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "longest")
SLICE = 1 << 20


@functools.cache
def encoder(path: str):
    """The tokenizer and the byte length of each of its ids. One for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, rank in ranks.items():
        length[rank] = len(piece)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def _local(path: str) -> str:
    """Where a worker has the vocabulary: the copy that Spark brought along."""
    at = SparkFiles.get(os.path.basename(path))
    return at if os.path.exists(at) else path


def attribute(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether the token leaves it.

    ``first``/``last``: a token's first and last position; ``start``/``end``: half-open sections, disjoint, ascending.
    Rule "first": the section that holds the first position; "last": the last; "longest": that which holds most of
    the token's positions, the earlier on a tie.
    """

    def at(p: np.ndarray) -> np.ndarray:
        s = np.searchsorted(start, p, side="right") - 1
        # Of sections that start together only the last can be other than empty.
        return np.where((s >= 0) & (p < end[np.maximum(s, 0)]), s, -1) if len(start) else np.full(len(p), -1)

    a, b = at(first), at(last)
    crosses = a != b
    if rule == "last":
        return b, crosses
    if rule == "longest":
        a = a.copy()
        for i in np.flatnonzero(crosses).tolist():  # few tokens cross
            held = [int(s) for s in at(np.arange(first[i], last[i] + 1)) if s >= 0]
            a[i] = max(dict.fromkeys(held), key=held.count) if held else -1
    return a, crosses


def count_tokens(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY
) -> DataFrame:
    """Tokens of each section of each document, each document encoded once as a whole.

    ``sections_col`` names an array of structs (start int, end int) of code point offsets, half-open, ascending and
    disjoint; without it a section is a line with its line feed. A token goes to one section by ``rule`` (see
    ``attribute``); what no section holds is counted in a row with section null.

    Null and empty texts have no tokens; by lines they have one empty section. Null or empty section arrays give only
    the row with section null. Equal rows give equal rows; an empty table gives none; other columns stay behind.

    Returns doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing (tokens counted here that reach
    beyond the section).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    given = sections_col is not None
    docs.sparkSession.sparkContext.addFile(vocabulary)  # about a megabyte, once for each executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = encoder(_local(vocabulary))
        for b in slices(batches, "text", SLICE):
            offsets, data = flat(b.column(1))
            rows = len(offsets) - 1
            ids = [encoding.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            per_doc = np.array([len(x) for x in ids], dtype=np.int64)
            token_doc = np.repeat(np.arange(rows), per_doc)
            token_len = length[np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(per_doc.sum()))]
            token_end = np.cumsum(token_len)
            lead = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte, that included
            char0 = np.concatenate(([0], lead))[offsets]  # code points before each document
            first, last = lead[token_end - token_len] - 1, lead[token_end - 1] - 1
            if given:
                spans = b.column(2).to_pylist()
                n_sec = np.array([len(s or ()) for s in spans], dtype=np.int64)
                doc = np.repeat(np.arange(rows), n_sec)
                start = np.array([s["start"] for x in spans for s in x or ()], dtype=np.int64) + char0[doc]
                end = np.array([s["end"] for x in spans for s in x or ()], dtype=np.int64) + char0[doc]
                start, end = np.minimum(start, char0[doc + 1]), np.minimum(end, char0[doc + 1])
            else:
                feeds = np.flatnonzero(data == 10) + 1
                feeds = feeds[~np.isin(feeds, offsets)]  # a line feed at a text's end opens no further line
                begin = np.sort(np.concatenate((offsets[:-1], feeds)), kind="stable")
                doc = np.searchsorted(offsets[:-1], begin, side="right") - 1
                empty = np.flatnonzero(np.diff(offsets) == 0)  # empty texts share their start with the next text
                doc[np.isin(begin, offsets[:-1])] = np.arange(rows)
                n_sec = np.bincount(doc, minlength=rows)
                padded = np.concatenate((lead, [lead[-1] + 1 if len(lead) else 1]))
                start = padded[begin] - 1
                end = np.concatenate((start[1:], char0[-1:]))
                end[np.isin(doc, empty)] = start[np.isin(doc, empty)]
            where, crosses = attribute(first, last, start, end, rule)
            inside = where >= 0
            tokens = np.bincount(where[inside], minlength=len(start))
            crossing = np.bincount(where[inside & crosses], minlength=len(start))
            no = np.arange(len(start)) - np.repeat(np.cumsum(n_sec) - n_sec, n_sec)
            made = [b.column(0).take(pa.array(doc)), pa.array(no), pa.array(start - char0[doc]), pa.array(end - char0[doc]), pa.array(tokens), pa.array(crossing)]
            if given:
                rest = np.bincount(token_doc[~inside], minlength=rows)
                over = np.bincount(token_doc[~inside & crosses], minlength=rows)
                none = pa.nulls(rows, pa.int64())
                made = [pa.concat_arrays([x, y]) for x, y in zip(made, [b.column(0), none, none, none, pa.array(rest), pa.array(over)])]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if given else []))
    return wanted.mapInArrow(run, f"doc_id {kind}, section long, start_char long, end_char long, n_tokens long, n_crossing long")


def count_field_tokens(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", separator: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each of several text columns, encoded once as the one document that they make: the fields in order with
    ``separator`` after each but the last, which belongs to the field before it. Null fields count as empty.

    Returns doc_id, field, start_char, end_char (in the joined document), n_tokens, n_crossing, a row for each field, also
    an empty one; equal rows give equal rows; an empty table gives none.
    """
    texts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    sections, at = [], F.lit(0)
    for t in texts:
        sections.append(F.struct(at.cast("int").alias("start"), (at + F.length(t)).cast("int").alias("end")))
        at = at + F.length(t)
    joined = docs.select(F.col(id_col).alias("doc_id"), F.concat(*texts).alias("text"), F.array(*sections).alias("sections"))
    told = count_tokens(joined, sections_col="sections", rule=rule, vocabulary=vocabulary).where("section IS NOT NULL")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), (F.col("section") + 1).cast("int"))
    return told.select("doc_id", name.alias("field"), "start_char", "end_char", "n_tokens", "n_crossing")
