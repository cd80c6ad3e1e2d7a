"""Jaccard join over sets of 5-word shingles: a size-aware heavy-light join (after Deng, Tao and Li, 2018).

Two sets link when 100 |x n y| >= 80 |x u y|. Small (light) sets enumerate fixed-size subsets: if a is the larger
size, a linked pair shares a subset of c(a) = ceil(0.8 a) shingles, so each small set is filed under all its
c(a)-subsets, for every a up to a quarter above its size. Large (heavy) sets are filed in inverted lists of their
first floor(0.2 n) + 1 shingles in one global order, very frequent shingles last; a linked pair meets in a list. Sets
from 0.8 times the boundary up are in the lists too, so pairs across it meet there. The boundary is the largest size up
to which subsets cost no more than scanning lists of the length measured in the data.

Equal sets are one class from the start. What is asked for is which classes hang together, so a long list is not
multiplied out: its members are compared with one of them; classes that this joins need no further comparison, and
only pairs of a list that still lie in different components go on. Every link that could join two components is thus
compared exactly; nothing is capped. A list is no task's work: lists of frequent shingles are dealt into parts for the
first comparison, and for the last one any list of over CELL classes is cut into blocks, of which every two meet in a
task of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.components import components
from palimpsest.llm.shared import chain, cut, mix64, release, span_hashes, word_spans

SHINGLE = 5
NEED, OF = 80, 100  # 100 * intersection >= 80 * union
SHORT = 8  # a list of up to so many classes is compared pair by pair at once
SLICE = 1 << 20
FREQUENT = 100_000  # so many of the most frequent shingles go last in the order (which only serves speed)
COUNTED = 2_000_000  # shingles counted at once to find them
CELL = 500  # classes of a list that are compared in one task, with as many others
BITS = 1 << 24  # of the fixed-size filter of classes to compare

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def sets_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, ascending: document of each, hash; set size and class of each document."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 32, dtype=np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _FOLD[data]
    start, end = word_spans(spaced)
    doc = np.searchsorted(offsets[:-1] + np.arange(n), start, side="right") - 1
    words = span_hashes(spaced, start, end)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    # One place for each shingle, in the documents' order; documents of fewer words: the whole sequence.
    places = np.where(count >= SHINGLE, count - SHINGLE + 1, count > 0)
    to = np.cumsum(places)
    owner = np.repeat(np.arange(n), places)
    grams = chain(words, SHINGLE)
    grams = np.concatenate((grams, np.zeros(SHINGLE, dtype=np.uint64)))[np.minimum(first[owner] + np.arange(len(owner)) - (to - places)[owner], len(grams))]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(count == k)
        if len(few):
            h = np.full(len(few), np.uint64(k))
            for i in range(k):
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[first[few] + i])
            grams[to[few] - 1] = h
    for a, b in zip((to - places).tolist(), to.tolist()):  # far faster than one sort by two keys
        grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[new], grams[new]
    size = np.bincount(owner, minlength=n)
    name = np.zeros(n, dtype=np.uint64)
    there = np.flatnonzero(size)
    if len(there):
        name[there] = np.add.reduceat(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(size) - size)[there])
    return owner, grams, size, mix64(name + size.astype(np.uint64)).view(np.int64)


def subset_sizes(n: int) -> list[int]:
    """c(a) for each size a from n to the largest that can link with n."""
    return sorted({-(-NEED * a // OF) for a in range(n, n * OF // NEED + 1)})


def light_cost(n: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n))


def prefix(n):
    return n - -(-NEED * n // OF) + 1


def boundary(list_length: float, most: int = 12) -> int:
    """The largest size up to which filing subsets costs no more than scanning lists of the given mean length."""
    best = 0
    for n in range(1, most + 1):
        if light_cost(n) > prefix(n) * max(1.0, list_length):
            break
        best = n
    return best


def sketch(grams: np.ndarray) -> bytes:
    """Parities of a set's members by their low bits, two to four bits for each member. Each member that only one of two
    sets has flips one bit, so two sketches never differ in more bits than the sets differ in members."""
    bits = max(256, 2 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound, from their sketches, of how many members only one of two sets has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _summaries(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in slices(batches, "text", SLICE):
            _, grams, size, cls = sets_of(*flat(b.column(1)))
            to = np.cumsum(size)
            made: list[bytes | None] = []
            for i, c in enumerate(cls.tolist()):  # a task makes a class's sketch once
                made.append(sketch(grams[to[i] - size[i] : to[i]]) if size[i] and c not in done else None)
                done.add(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(cls), pa.array(made, pa.binary())], names=["doc_id", "n_shingles", "cls", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, sketch binary")


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for a link: no link is lost, and few others come through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.asarray(b.column(2))
            differ = [least_difference(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            # 100 |x n y| >= 80 |x u y| is the same as 9 * (members that only one has) <= |x| + |y|.
            keep = pa.array((OF + NEED) * np.array(differ, dtype=np.int64) <= (OF - NEED) * total)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    ends = [sketches.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b").mapInArrow(run, "a long, b long")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The most frequent shingles, most frequent last, how often each occurs, and the mean length of a shingle's list, by
    its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            every = np.concatenate(held)
            every.sort()
            at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            n = np.diff(np.append(at, len(every)))
            often = n >= 4
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(every[at][often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(every))), pa.array(np.append(np.zeros(often.sum(), np.int64), (n * n).sum()))],
                names=["token", "n", "members", "squares"],
            )

        for b in slices(batches, "text", SLICE):
            held.append(sets_of(*flat(b.column(1)))[1])
            if sum(map(len, held)) >= COUNTED:
                yield out()
                held.clear()
        if held and sum(map(len, held)):
            yield out()

    summed = docs.mapInArrow(run, "token long, n long, members long, squares long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("members").alias("members"), F.sum("squares").alias("squares"))
    rows = summed.where("n > 0 OR members > 0").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    lengths = summed.agg(F.sum("members"), F.sum("squares")).first()
    rows = [r for r in rows if r.n > 0][::-1]
    tokens = np.array([r.token for r in rows], dtype=np.int64).view(np.uint64)
    return tokens, np.array([r.n for r in rows], dtype=np.int64), (lengths[1] / lengths[0]) if lengths[0] else 1.0


def _filed(docs: DataFrame, frequent: np.ndarray, times: np.ndarray, limit: int, cell: int) -> DataFrame:
    """Each class under its keys: subsets of light sets, prefix shingles of heavy ones. ``pos`` is a shingle's place
    in the order, -1 for a subset; ``part`` the part of a frequent shingle's list, -1 for a list in one. A task files a
    class once; several tasks may file it alike."""
    order = np.argsort(frequent)
    held = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.uint64), times[order]))  # at most FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank, times = held.value
        done: set[int] = set()
        for b in slices(batches, "text", SLICE):
            owner, grams, size, cls = sets_of(*flat(b.column(1)))
            fresh = np.zeros(len(size), dtype=bool)
            for i, c in enumerate(cls.tolist()):
                if size[i] and c not in done:
                    done.add(c)
                    fresh[i] = True
            key, parts = grams >> np.uint64(1), np.ones(len(grams), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                known = often[at] == grams
                key = np.where(known, np.uint64(1 << 63) | rank[at], key)
                parts = np.where(known, -(-times[at] // cell), 1)
            part = np.where(parts > 1, (cls[owner] & 0x7FFFFFFF) % parts, -1)
            to = np.cumsum(size)
            by = np.concatenate([np.zeros(0, np.int64), *(a + np.argsort(key[a:b]) for a, b in zip((to - size).tolist(), to.tolist()))])
            grams, doc, part = grams[by], owner[by], part[by]
            first = np.cumsum(size) - size
            pos = np.arange(len(doc)) - first[doc]
            heavy = fresh[doc] & (size[doc] * OF >= NEED * (limit + 1)) & (pos < prefix(size)[doc])
            keys, who, places, dealt = [grams[heavy]], [doc[heavy]], [pos[heavy]], [part[heavy]]
            for i in np.flatnonzero(fresh & (size <= limit)).tolist():
                own = np.sort(grams[first[i] : first[i] + size[i]]).tolist()
                found = []
                for c in subset_sizes(len(own)):
                    for some in itertools.combinations(own, c):
                        h = c
                        for g in some:
                            h = (h * 0xD6E8FEB86659FD93 + g) & 0xFFFFFFFFFFFFFFFF
                            h ^= h >> 29
                        found.append(h)
                keys.append(mix64(np.array(found, dtype=np.uint64)))
                who.append(np.full(len(found), i))
                places.append(np.full(len(found), -1))
                dealt.append(np.full(len(found), -1))
            who, dealt = np.concatenate(who), np.concatenate(dealt)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_salted(np.concatenate(keys), dealt).view(np.int64)), pa.array(cls[who]), pa.array(size[who].astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(dealt.astype(np.int32))], names=["token", "cls", "n", "pos", "part"]
            )

    return docs.mapInArrow(run, "token long, cls long, n int, pos int, part int")


def _salted(token: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The token of a part of a list, and from that the whole list's again; a list in one keeps its token."""
    return np.where(part >= 0, token.view(np.uint64) ^ mix64((part + 1).astype(np.uint64)), token.view(np.uint64))


def may_link(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can link, given that the first shingle they share is at places i and j."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    need = -(-NEED * (n + m) // (OF + NEED))  # of the intersection
    left = np.where(i >= 0, 1 + np.minimum(n - i - 1, m - j - 1), low)
    return (OF * low >= NEED * high) & (left >= need)


def _paired(filed: DataFrame, how: str) -> DataFrame:
    """Pairs to compare from lists of (token, cls, n, pos, root, part), read list by list; parts of a list are lists.

    ``how``: "first" - short lists pair by pair, long ones and parts each member with the least class; rows of long
    lists come out again (b null). "some" - long lists, each member with one chosen by the token. "all" - every pair
    left whose sketches leave room for a link; where members have a ``part`` of 0 or more, only pairs of different
    parts. In the last two only pairs of different roots count.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            now = [np.asarray(b.column(i)) for i in range(6)] + [np.array(b.column(i).to_pylist() or [], dtype=object) for i in range(6, b.num_columns)]
            rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            if not len(rest[0]):
                continue
            last = np.searchsorted(rest[0], rest[0][-1])  # the last list may go on
            if last:
                yield tuple(x[:last] for x in rest)
                rest = [x[last:] for x in rest]
        if rest and len(rest[0]):
            yield tuple(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, cls, n, pos, root, part, *more in lists(batches):
            keep = np.ones(len(token), dtype=bool)
            keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, cls, n, pos, root, part = (x[keep] for x in (token, cls, n, pos, root, part))
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.append(begin, len(token)))
            of = np.repeat(np.arange(len(begin)), length)
            size = length[of]

            def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
                ok = (i != j) & may_link(n[i].astype(np.int64), n[j].astype(np.int64), pos[i].astype(np.int64), pos[j].astype(np.int64))
                if how != "first":
                    ok &= root[i] != root[j]
                if not ok.any():
                    return None
                a, b = np.minimum(cls[i[ok]], cls[j[ok]]), np.maximum(cls[i[ok]], cls[j[ok]])
                both = np.unique(np.rec.fromarrays([a, b], names="a,b"))
                m = len(both)
                return pa.RecordBatch.from_arrays([pa.array(both["a"].copy()), pa.array(both["b"].copy()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=["a", "b", "token", "n", "pos"])

            made = []
            if how == "first":
                short = (size <= SHORT) & (part < 0)
                for d in range(1, SHORT):
                    i = np.flatnonzero(short & (np.arange(len(token)) - begin[of] + d < size))
                    made.append(pairs(i, i + d))
                i = np.flatnonzero(~short)
                made.append(pairs(begin[of[i]], i))
                if len(i):
                    # A part's rows carry the token of the whole list.
                    made.append(pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.nulls(len(i), pa.int64()), pa.array(_salted(token[i], part[i]).view(np.int64)), pa.array(n[i]), pa.array(pos[i])], names=["a", "b", "token", "n", "pos"]))
            elif how == "some":
                i = np.arange(len(token))
                made.append(pairs(begin[of] + (token % size), i))
            else:
                # Screened here by the sketches, so that only pairs with room for a link leave the task.
                sketches = np.asarray(more[0][keep], dtype=object)
                for k in range(len(begin)):
                    own = np.arange(begin[k], begin[k] + length[k])
                    for i, j in _alike(own, n, root, part, sketches):
                        made.append(pairs(i, j))
                    if len(made) > 64:
                        yield from (m for m in made if m is not None)
                        made = []
            yield from (m for m in made if m is not None)

    parts = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filed.select("token", "cls", "n", "pos", "root", "part", *(["sketch"] if how == "all" else [])).repartition(parts, "token").sortWithinPartitions("token", "cls")
    return dealt.mapInArrow(run, "a long, b long, token long, n int, pos int")


def _alike(own: np.ndarray, n: np.ndarray, root: np.ndarray, part: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one list, of different roots, whose sketches leave room for a link. Linked sets differ in
    size by a quarter at most, so a sketch meets those of its own length and of twice that, folded."""
    width = np.array([len(s) for s in sketches[own]])
    for w in np.unique(width).tolist():
        small = own[width == w]
        rows = np.frombuffer(b"".join(sketches[small]), np.uint64).reshape(len(small), -1)
        large = own[width == 2 * w]
        folded = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[large]), np.uint64).reshape(len(large), 2, rows.shape[1]), axis=1)
        others, theirs = np.concatenate((small, large)), np.concatenate((rows, folded))
        for k in range(len(small)):
            differ = np.bitwise_count(theirs[k + 1 :] ^ rows[k]).sum(axis=1, dtype=np.int64)
            j = others[k + 1 :]
            j = j[((OF + NEED) * differ <= (OF - NEED) * (n[small[k]].astype(np.int64) + n[j])) & (root[j] != root[small[k]])]
            if part[small[k]] >= 0:
                j = j[part[j] != part[small[k]]]
            if len(j):
                yield np.full(len(j), small[k]), j


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets do link. Only sets of classes in the pairs are sent, screened by a bitmap of fixed size."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    place = ends.select((F.pmod(F.col("cls"), F.lit(BITS)) + 1).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(BITS, dtype=bool)
    for r in rows:
        own = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        bits[(r.k - 1) * len(own) : r.k * len(own)] = own
    held = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(held.value)
        done: set[int] = set()
        for b in slices(batches, "text", SLICE):
            _, grams, size, cls = sets_of(*flat(b.column(1)))
            to = np.cumsum(size)
            names, sets = [], []
            for i in np.flatnonzero((size > 0) & (wanted[cls % BITS] > 0)).tolist():
                c = int(cls[i])
                if c not in done:
                    done.add(c)
                    names.append(c)
                    sets.append(grams[to[i] - size[i] : to[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            x_raw, y_raw = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = np.frombuffer(x_raw[i].as_py(), np.uint64), np.frombuffer(y_raw[i].as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(OF * common >= NEED * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    sets = docs.mapInArrow(run, "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))
    left = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    both = left.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    """Every two of a list's blocks as a list of their own under a new token, in which members tell their blocks apart by
    ``part``; a block with itself has -1, as a list of one block has."""
    each = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    token = F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    part = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own").cast("int"))
    return each.withColumn("token", token).withColumn("part", part).drop("blocks", "own", "other")


def link_classes(docs: DataFrame, sketches: DataFrame, cell: int = CELL) -> DataFrame:
    """Links between classes that join all classes that hang together: (a, b), not every link within a component.

    ``sketches``: (cls, n, sketch) of every class with members.
    """
    frequent, times, length = _frequent(docs)
    filed = _filed(docs, frequent, times, boundary(length), cell).withColumn("root", F.col("cls"))
    first = cut(_paired(filed, "first"))
    release(docs.sparkSession)  # the lists are done with
    links = cut(_linked(docs, cut(_screened(first.where("b IS NOT NULL").select("a", "b").distinct(), sketches))))
    long = first.where("b IS NULL").select("token", F.col("a").alias("cls"), "n", "pos")
    if long.isEmpty():
        return links
    for how in ("some", "all"):
        release(docs.sparkSession)
        roots = components(links)
        rooted = long.join(roots, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "pos", F.coalesce("root", "cls").alias("root"))
        # Only lists of different roots go on. Written, so that adaptive execution can split the join at a long list.
        size = F.ceil(F.count("*") / cell).alias("blocks")
        mixed = cut(rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), size).where("lo < hi").select("token", "blocks"))
        rooted = rooted.distinct().join(mixed, "token")
        if how == "all":  # their members' sketches go with them
            rooted = _cells(rooted).join(sketches.select("cls", "sketch"), "cls")
        else:
            dealt = F.xxhash64("token", F.pmod(F.xxhash64("cls"), F.col("blocks")))
            rooted = rooted.withColumn("token", F.when(F.col("blocks") == 1, F.col("token")).otherwise(dealt)).withColumn("part", F.lit(-1))
        pairs = _paired(rooted, how).select("a", "b").distinct()
        more = cut(_screened(pairs, sketches) if how == "some" else pairs)
        # What hung together before goes on as a link of each class to its root.
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
        if not more.isEmpty():
            links = links.unionByName(cut(_linked(docs, more)))
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """Each document's set size and component: the smallest id that links lead to, its own included.

    Words are runs of bytes other than white space, with A-Z in lower case. Null, empty and blank texts have an empty
    set and are components of their own. Equal sets link (also across equal ids); null ids count only where no other
    id is in the component. Other columns stay behind; an empty table gives no rows.

    Returns doc_id, n_shingles, cls (a name for the set), component_id.
    """
    release(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    summary = cut(_summaries(slim, kind))
    full = summary.where("n_shingles > 0")
    sketches = cut(full.where("sketch IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    roots = components(link_classes(slim, sketches, cell))
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(lowest, "root").select("cls", "component_id")
    return full.join(of, "cls").select("doc_id", "n_shingles", "cls", "component_id").unionByName(
        summary.where("n_shingles = 0").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"))
    )
