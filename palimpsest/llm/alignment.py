"""Cross-tokenizer alignment: where two tokenizers both end a token they cut the text, and between cuts tokens that share
bytes are linked.

The alignment is relational: token lists are exploded with their positions, running sums of byte lengths place them, an
equality on key and place finds the cuts, a running count of cuts numbers the groups, and every link begins where one
of its two tokens begins, so the last token begun on either side names it.

Neither tokenizer joins a letter with white space or a stop that follows it, so texts are cut there into segments
beforehand (the model file is asked whether that holds), and a segment that occurs a thousand times is encoded and
aligned once. What a
document has of segments is looked up block by block: documents are dealt into blocks of some bytes, of which each
needs only the values of its own segments. A document that cannot be put together from segments is a segment itself.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import discard, release, written
from palimpsest.llm.tokens import _local

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 32 << 20  # bytes of text whose segments are looked up together
HELD = 300_000  # segments that a task counts, or remembers as exact, before it sends or forgets them
BATCH = 2_000  # segments encoded at once
WAVES = 4  # passes in which blocks are looked up, so that only the segments of a part of them are on disk at a time
SMALL = 1 << 20  # pairs of ids of at most so many rows are broadcast; larger tables are joined by a shuffle

#: A segment ends before a space or line feed that stands behind a letter, digit or ASCII sign, and before a stop that
#: stands behind a Latin letter.
SEGMENT = re.compile(r".(?:[^ \n.,;:!?*]++|(?<![\w!-~])[ \n]|(?<![A-Za-zÀ-ÖØ-öø-ɏ])[.,;:!?*])*+", re.DOTALL)


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow
    from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and how texts are cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_alphabet()
        pieces = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for i, t in pieces.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.feed = next(i for i in range(len(pieces)) if self.b_bytes[i] == b"\n")
        #: Whether texts may be cut into segments: no token of B goes on where one ends.
        crossing = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?*]")
        self.cuts = self.b_bytes[self.space] == b" " and not any(crossing.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        # Characters up to U+024F do not combine with each other, so what holds for each of them holds for texts of them.
        fine = [c for c in map(chr, [9, 10, *range(0x20, 0x7F), *range(0xA1, 0x250)]) if self._exact(f" x{c}x")]
        self.plain = re.compile(f"[{''.join(map(re.escape, fine))}]*+")
        self.known: dict[str, bool] = {}

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B for each segment of a text, the space or none that it begins with kept as it is."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # B puts a space in front: that of the segment, or one behind which a line feed keeps it apart.
        b = self.b.encode([s[1:] if s[0] == " " else f"\n{s}" for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                b[k] = [self.space]
            elif s[0] != " " and b[k][:2] == [self.space, self.feed]:
                b[k] = b[k][2:]
        return list(zip(a, b))

    def exact(self, segment: str, a: list[int], b: list[int]) -> bool:
        raw = segment.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))

    def _exact(self, segment: str) -> bool:
        return self.exact(segment, *self.encode([segment])[0])

    def is_exact(self, segment: str) -> bool:
        if (known := self.known.get(segment)) is None:
            if len(self.known) >= HELD:
                self.known.clear()
            known = self.known[segment] = self._exact(segment)
        return known

    def cut(self, text: str) -> list[str]:
        """The segments of a space and the text."""
        return SEGMENT.findall(f" {text}") if self.cuts else [f" {text}"]

    def segments(self, text: str | None) -> list[str]:
        """The same where all are encoded without a change, else the whole as one; none where that changes too."""
        if not text:
            return []
        found = self.cut(text)
        if self.plain.fullmatch(text) or all(self.is_exact(s) for s in set(found) if not self.plain.fullmatch(s)):
            return found
        return [f" {text}"] if self._exact(f" {text}") else []


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    """One for each Python worker."""
    return Pair(a_path, b_path)


def align(tokens: DataFrame) -> DataFrame:
    """Links between two tokenizations of the same bytes.

    ``tokens``: key (unique), a_ids, a_lens, b_ids, b_lens (arrays of int; lengths in bytes, positive, of equal sums).
    Null or empty arrays have no links, an empty table gives none; other columns stay behind.

    Returns a row for each pair of tokens that share bytes: key, grp (from 0), start (byte where the shared part
    begins), a_pos, a_id, b_pos, b_id, a_new and b_new (whether that token begins here; both: so does the group).
    """
    listed = [
        F.transform(F.arrays_zip(F.col(f"{s}_ids").alias("id"), F.col(f"{s}_lens").alias("len")), lambda x, i: F.struct(F.lit(s == "b").alias("of_b"), i.alias("pos"), x["id"].alias("id"), x["len"].alias("len")))
        for s in ("a", "b")
    ]
    rows = tokens.repartition("key").select("key", F.explode(F.concat(*listed)).alias("t")).select("key", "t.*")
    before = Window.partitionBy("key", "of_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))
    # The equality on key and place: all rows of a key are in one partition already, so it is a grouping without a shuffle.
    own = lambda side, c: F.max(F.when(F.col("of_b") == (side == "b"), F.col(c))).alias(f"{side}_{c}")
    met = placed.groupBy("key", "start").agg(own("a", "id"), own("a", "pos"), own("b", "id"), own("b", "pos"))
    so_far = Window.partitionBy("key").orderBy("start")
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    both = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    group = (F.count(F.when(both, 1)).over(so_far) - 1).alias("grp")
    return met.select("key", group, "start", last("a_pos"), last("a_id"), last("b_pos"), last("b_id"), F.col("a_id").isNotNull().alias("a_new"), F.col("b_id").isNotNull().alias("b_new"))


def by_key(links: DataFrame) -> DataFrame:
    """The links of each key in one row: key, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), pairs (an array of
    a_id and b_id for each link)."""
    cut = F.col("a_new") & F.col("b_new")
    ids = {
        "a": F.concat(F.when(~cut, ",").when(F.col("grp") > 0, ";").otherwise(""), F.col("a_id")),
        "b": F.concat(F.when(cut, "|").otherwise(","), F.col("b_id")),
    }
    both = [F.when(F.col(f"{s}_new"), F.struct(F.col("grp"), F.lit(s).alias("side"), F.col("start"), ids[s].alias("text"))) for s in ("a", "b")]
    pieces = F.sort_array(F.flatten(F.collect_list(F.array(*both))))
    flags = [F.count_if(c).cast("int").alias(n) for c, n in ((F.col("a_new"), "n_a"), (F.col("b_new"), "n_b"), (cut, "n_groups"))]
    pairs = F.collect_list(F.struct("a_id", "b_id")).alias("pairs")
    return links.groupBy("key").agg(*flags, F.count("*").cast("int").alias("n_links"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("groups"), pairs)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, times, best) of rows (a_id, b_id, n): how often a pair of ids is linked, a row counted ``n`` times, and
    whether no other A id is linked with the B id more often."""
    told = pairs.groupBy("a_id", "b_id").agg(F.sum("n").alias("times"))
    most = told.groupBy("b_id").agg(F.max("times").alias("most"))
    return told.join(most, "b_id").select("a_id", "b_id", "times", (F.col("times") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, block: int = BLOCK, as_digest: bool = False) -> DataFrame:
    """Groups and links of the tokens of A and B in every whole text, with a space put in front of it.

    Special tokens' strings are ordinary text. Null and empty texts, and texts that A or B does not give back byte by
    byte, have no tokens: zeros, and groups ''. Equal rows give equal rows; other columns stay behind; an empty table
    gives none.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links of whose B id no other A id has more in all of
    ``docs``), count_sum (over links, how many links in all of ``docs`` hold the same ids), groups (``a1,a2|b1;a3|b2``;
    ``as_digest``: groups_sha256, its SHA-256, '' without tokens).
    """
    spark = docs.sparkSession
    for path in (a_file, b_file):
        spark.sparkContext.addFile(path)  # about two megabytes, once for each executor
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block + 1
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, found = pair(_local(a_file), _local(b_file)), {}

        def sent() -> Iterator[pa.RecordBatch]:
            for k, count in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(count), pa.int32()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["block", "seg", "n"])
            found.clear()

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                found.setdefault(k, Counter()).update(both.segments(text.as_py()))
                if sum(map(len, found.values())) >= HELD:
                    yield from sent()
        yield from sent()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(_local(a_file), _local(b_file))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                segments = b.column(0).to_pylist()
                ids = both.encode(segments)
                if not all(both.exact(s, *x) for s, x in zip(segments, ids)):
                    raise ValueError("a segment that was taken for exact is not")
                ints = lambda lists: pa.array(lists, pa.list_(pa.int32()))
                made = [ints([x for x, _ in ids]), ints([[len(both.a_bytes[i]) for i in x] for x, _ in ids]), ints([y for _, y in ids]), ints([[len(both.b_bytes[i]) for i in y] for _, y in ids])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["seg", "n", "a_ids", "a_lens", "b_ids", "b_lens"])

    held = written(dealt.select("block", "text").repartition(blocks, "block").mapInArrow(counted, "block int, seg string, n long"))
    release(spark)
    lists = held.groupBy("seg").agg(F.sum("n").alias("n")).mapInArrow(encoded, "seg string, n long, a_ids array<int>, a_lens array<int>, b_ids array<int>, b_lens array<int>")
    tokens = written(lists.withColumn("key", F.monotonically_increasing_id()))
    aligned = written(by_key(align(tokens)).join(tokens.select("key", "seg", "n"), "key"))
    discard(tokens)
    release(spark)
    pairs = written(pair_counts(aligned.select("n", F.inline("pairs"))))
    known = F.broadcast(pairs) if pairs.count() <= SMALL else pairs
    each = aligned.select("key", F.inline("pairs")).join(known, ["a_id", "b_id"])
    sums = each.groupBy("key").agg(F.count_if("best").cast("int").alias("n_best"), F.sum("times").alias("count_sum"))
    values = written(aligned.drop("pairs", "n").join(sums, "key").drop("key"))
    discard(aligned)
    release(spark)
    def told(texts: pa.Table, own: pa.Table) -> pa.Table:
        both = pair(_local(a_file), _local(b_file))
        at = {s: k for k, s in enumerate(own.column("seg").to_pylist())}
        groups = own.column("groups").to_pylist()
        numbers = np.stack([own.column(c).to_numpy() for c in NUMBERS], axis=1) if at else np.zeros((0, len(NUMBERS)), np.int64)
        rows, texts_out = np.zeros((texts.num_rows, len(NUMBERS)), np.int64), []
        for k, text in enumerate(texts.column("text")):
            text = text.as_py()
            try:
                where = [at[s] for s in both.cut(text)] if text else []
            except KeyError:  # the table holds no segment of such a text but perhaps the whole
                where = [at[f" {text}"]] if f" {text}" in at else []
            rows[k] = numbers[where].sum(axis=0)
            joined = ";".join([groups[i] for i in where])
            texts_out.append(hashlib.sha256(joined.encode()).hexdigest() if as_digest and where else joined)
        return pa.table([texts.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(NUMBERS))), pa.array(texts_out, pa.string())], names=["doc_id", *NUMBERS, name])

    name = "groups_sha256" if as_digest else "groups"
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, {name} string"
    done = None
    for k in range(min(WAVES, blocks)):
        own = lambda df: df.where(F.col("block") % WAVES == k)  # noqa: B023, E731  used at once
        of_blocks = own(held.select("block", "seg")).join(values, "seg")
        part = written(own(dealt).groupBy("block").cogroup(of_blocks.groupBy("block")).applyInArrow(told, schema))
        done = part if done is None else done.unionByName(part)
        release(spark)
    discard(held)
    discard(values)
    return done


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
