"""Removal of repeated byte strings across all documents, by suffix arrays over shards.

Where two documents hold the same 400 bytes, both choose the same anchor inside them, at the same place of the string:
of the 64-byte grams of a window of 400 bytes, the one with the least hash. So windows need comparing only around equal
anchors, and only if the anchor lies equally deep in both.

1. Anchors of every document: place, hash, and a hash of the bytes around (the context). Equal contexts are counted
   together before they move. Anchors with one occurrence in the corpus are done; a context with two is repeated whole.
2. One document for each other context sends the bytes left and right of the anchor to the anchor's shard.
3. There the windows of a context fall into blocks by how deep the anchor lies. All windows of a block share a core of
   nearly 400 bytes, known by its hash: a context that is alone with its core is done with the block, and so are those
   that agree in the few bytes beside it. For the rest only these few bytes, left and right of a mark that names the
   core, go into a string whose suffixes are sorted with their common prefixes (see ``suffixes``). A run of common
   prefix over a window and the mark is a window that several contexts hold.
4. A context's repeated windows all hold its anchor, so they make one interval; intervals go back to the documents.

An anchor with over HOT contexts is no task's work: its contexts stay spread, and their blocks are halved, counted and
thinned out by Spark until a core has few enough, or until a block is one window and the count alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import flat, slices
from palimpsest.llm.shared import _R_INV, cut, mix64, power_at, powers, prefix_sums, release, row_struct
from palimpsest.llm.suffixes import suffix_array

GRAM = 64  # bytes of an anchor
SLICE = 1 << 19
STARTS = 1 << 18  # window starts handled at once
SHARD = 2 << 20  # bytes of contexts handled together, as far as groups allow
BLOCKS = 8  # of a context's windows
HOT = 2000  # contexts of one group that a shard takes at most
MARK = 8  # symbols that name a core inside a sorted string: three bits each, as bytes that no UTF-8 text holds


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each span of ``bounds``: span number, place, hash and context hash of every anchor of a window inside it."""
    n = len(data)
    width = length - gram + 1
    docs, places = [], []
    ends = bounds[1:]
    long = np.flatnonzero(np.diff(bounds) >= length)
    if not len(long):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    sums = prefix_sums(data)
    hashes = mix64((sums[gram:] - sums[:-gram]) * powers(_R_INV, n - gram + 1))
    for lo in range(0, n - length + 1, STARTS):
        hi = min(n - length + 1, lo + STARTS)
        part = hashes[lo : hi - 1 + width]
        # The least hash, the leftmost place on a tie: high bits of the hash over the place in this stretch.
        value = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        pad = -len(value) % width
        block = np.concatenate((value, np.full(pad, np.uint64(2**64 - 1)))).reshape(-1, width)
        forward = np.minimum.accumulate(block, axis=1).ravel()
        backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        m = hi - lo
        least = np.minimum(backward[:m], forward[width - 1 : width - 1 + m])
        start = np.arange(lo, hi)
        doc = np.searchsorted(ends, start, side="right")
        ok = start + length <= ends[np.minimum(doc, len(ends) - 1)]
        ok[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        places.append((least[ok] & np.uint64(0xFFFFFF)).astype(np.int64) + lo)
        docs.append(doc[ok])
    doc, place = np.concatenate(docs), np.concatenate(places)
    place, first = np.unique(place, return_index=True)
    doc = doc[first]
    lo, hi = np.maximum(bounds[doc], place - (length - gram)), np.minimum(bounds[doc + 1], place + length)
    context = mix64((sums[hi] - sums[lo]) * power_at(_R_INV, lo) + mix64((place - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)))
    return doc, place - bounds[doc], hashes[place], context


def _bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The spans [lo, hi) of ``data`` as a binary column."""
    size = hi - lo
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


def _classes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value's class, and the sizes of the classes."""
    _, number, size = np.unique(values, return_inverse=True, return_counts=True)
    return number, size


def repeated_depths(group: np.ndarray, width: np.ndarray, many: np.ndarray, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest depth, as far as ``width``, of a window that a row shares with another row of its group
    (-1: none). A window of depth x takes the last x bytes of ``left`` and the first ``width - x`` of ``right``.

    ``many``: the row stands for several places; it is only what others are compared with.
    """
    rows = len(group)
    lefts, text_left = flat(left)
    rights, text_right = flat(right)
    n_left, n_right = np.diff(lefts), np.diff(rights)
    start = lefts[:-1] + rights[:-1]
    mid = start + n_left
    n = len(text_left) + len(text_right)
    data = np.empty(n, np.uint8)
    is_left = np.repeat(np.tile([True, False], rows), np.column_stack((n_left, n_right)).ravel())
    data[is_left], data[~is_left] = text_left, text_right
    sums = prefix_sums(data)
    low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
    row, block, core, whole, inner = [], [], [], [], []
    for i in range(BLOCKS):
        a, b = width * i // BLOCKS, width * (i + 1) // BLOCKS
        ok = np.flatnonzero((n_left >= a) & (n_right >= width - b))
        lo, hi = mid[ok] - a[ok], mid[ok] + (width - b)[ok]
        name = mix64((group[ok] * BLOCKS + i).astype(np.uint64))
        core.append(mix64((sums[hi] - sums[lo]) * power_at(_R_INV, lo) + name))
        far, near = np.minimum(b, n_left)[ok], np.minimum(width - a, n_right)[ok]
        lo, hi = mid[ok] - far, mid[ok] + near
        whole.append(mix64((sums[hi] - sums[lo]) * power_at(_R_INV, lo) + mix64(name + (far << 20 | near).astype(np.uint64))))
        row.append(ok), block.append(np.full(len(ok), i)), inner.append((b - a)[ok])
    row, block, inner = np.concatenate(row), np.concatenate(block), np.concatenate(inner)
    core, n_core = _classes(np.concatenate(core))
    whole, n_whole = _classes(np.concatenate(whole))
    a = width[row] * block // BLOCKS
    b = a + inner
    far, near = np.minimum(b, n_left[row]), np.minimum(width[row] - a, n_right[row])  # depths up to far, from width - near
    multiple = np.zeros(len(n_whole), bool)
    multiple[whole[many[row]]] = True
    sure = (n_whole[whole] > 1) | multiple[whole]
    own = np.flatnonzero(sure & ~many[row])
    np.minimum.at(low, row[own], np.maximum(a, width[row] - near)[own])
    np.maximum.at(high, row[own], far[own])
    # What is between two repeated windows of a context is inside its interval anyway.
    open_ = ~sure & (n_core[core] > 1) & ((a < low[row]) | (b > high[row]))
    wanted = np.zeros(len(n_core), bool)
    wanted[core[open_]] = True
    sent = np.flatnonzero(wanted[core])
    sent = sent[np.unique(whole[sent], return_index=True)[1]]
    if len(sent) > 1:
        row, core, inner, a, b, far, near, open_ = (x[sent] for x in (row, core, inner, a, b, far, near, open_))
        core = _classes(core)[0]
        size_left, size_right = far - a, near - (width[row] - b)
        size = size_left + size_right + MARK + 1
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        text = np.zeros(int(size.sum()), np.uint8)

        def put(to: np.ndarray, lo: np.ndarray, count: np.ndarray) -> None:
            ends = np.cumsum(count)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
            text[np.repeat(to, count) + step] = data[np.repeat(lo, count) + step]

        put(begin, mid[row] - far, size_left)
        for k in range(MARK):
            text[begin + size_left + k] = 0xF5 + (core >> 3 * k & 7)
        put(begin + size_left + MARK, mid[row] + width[row] - b, size_right)
        order, common = suffix_array(text, int(inner.max()) + MARK)
        piece = np.searchsorted(begin, order, side="right") - 1
        offset = order - begin[piece]
        run = np.cumsum(common < inner[piece] + MARK)
        # Depths of a window: its string holds the mark whole and a window's bytes around it.
        valid = (offset <= size_left[piece]) & (offset + inner[piece] + MARK < size[piece])
        piece, offset, run = piece[valid], offset[valid], run[valid]
        number, times = _classes(run)
        hit = (times[number] > 1) & open_[piece]
        piece, depth = piece[hit], (far[piece] - offset)[hit]
        np.minimum.at(low, row[piece], depth)
        np.maximum.at(high, row[piece], depth)
    low[high < 0] = -1
    return low, high


GROUP = "anchor long, core long, depth int, width int, context long, many boolean, left binary, right binary"
FOUND = "anchor long, context long, low int, high int"


def _solved(rows: pa.Table) -> pa.RecordBatch:
    """Contexts of whole groups with the depths of their repeated windows."""
    anchor, core, context = (rows.column(x).to_numpy() for x in ("anchor", "core", "context"))
    step = (anchor[1:] != anchor[:-1]) | (core[1:] != core[:-1])
    one = np.flatnonzero(np.concatenate(([True], step | (context[1:] != context[:-1]))))
    group = np.concatenate(([0], np.cumsum(step)))[one]
    rows = rows.take(pa.array(one)).combine_chunks()
    low, high = repeated_depths(group, rows.column("width").to_numpy().astype(np.int64), rows.column("many").to_numpy(zero_copy_only=False), rows.column("left"), rows.column("right"))
    hit = np.flatnonzero(high >= 0)
    depth = rows.column("depth").to_numpy()[hit]
    return pa.RecordBatch.from_arrays([pa.array(anchor[one[hit]]), pa.array(context[one[hit]]), pa.array((depth + low[hit]).astype(np.int32)), pa.array((depth + high[hit]).astype(np.int32))], names=["anchor", "context", "low", "high"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about SHARD bytes: Spark's hold as many rows as it is told, whatever their bytes."""
    for b in batches:
        step = max(1, b.num_rows * SHARD // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (anchor, core), in runs of whole groups of about SHARD bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in _parts(batches):
        held.append(b)
        size += b.nbytes
        if size >= SHARD:
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor, core = rows.column("anchor").to_numpy(), rows.column("core").to_numpy()
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (core[1:] != core[:-1]))
            if len(change):  # the last group may go on
                to = int(change[-1]) + 1
                yield rows.slice(0, to)
                held = rows.slice(to).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
            else:
                held = rows.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _halved(rows: DataFrame) -> DataFrame:
    """Each block of windows as two: those up to half its width deeper than ``depth``, and those beyond."""
    h = F.expr("width div 2")
    far = F.col("width") - h - 1  # width of the second one
    tail = lambda n: F.substring("left", F.length("left") - n + 1, n)
    near_rows = rows.where(F.length("right") >= F.col("width") - h).select(
        "anchor", F.xxhash64("core", F.lit(0), F.substring("right", F.lit(1), F.col("width") - h)).alias("core"), "depth", h.cast("int").alias("width"), "context", "many",
        tail(F.least(h, F.length("left"))).alias("left"), F.substring("right", F.col("width") - h + 1, h).alias("right"),
    )
    far_rows = rows.where((F.length("left") > h) & (F.col("width") > 0)).select(
        "anchor", F.xxhash64("core", F.lit(1), tail(h + 1)).alias("core"), (F.col("depth") + h + 1).cast("int").alias("depth"), far.cast("int").alias("width"), "context", "many",
        F.substring("left", F.lit(1), F.length("left") - h - 1).alias("left"), F.substring("right", F.lit(1), far).alias("right"),
    )
    return near_rows.unionByName(far_rows)


def _thinned(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Of groups over ``hot`` contexts: repeated depths as far as counting tells (FOUND), and groups for shards (GROUP)."""
    found = left = None
    while True:
        rows = _halved(rows).withColumn("beside", F.xxhash64("left", "right", F.length("left")))
        kinds = rows.groupBy("anchor", "core", "beside").agg(F.count("*").alias("n"), F.min("context").alias("one"), F.max("many").alias("of_many"))
        kinds = kinds.withColumn("alone", (F.col("n") == 1) & ~F.col("of_many"))
        sizes = kinds.groupBy("anchor", "core").agg(F.count("*").alias("kinds"), F.max("alone").alias("some_alone"))
        told = cut(rows.join(kinds.join(sizes, ["anchor", "core"]), ["anchor", "core", "beside"]).where("NOT alone OR kinds > 1"))
        fits = F.greatest(F.lit(0), F.col("width") - F.length("right"))
        sure = told.where("NOT alone AND NOT many").select("anchor", "context", (F.col("depth") + fits).cast("int").alias("low"), (F.col("depth") + F.length("left")).cast("int").alias("high"))
        found = sure if found is None else found.unionByName(sure)
        # Rows that agree in a whole block are one row from now on.
        rest = told.where("some_alone AND kinds > 1 AND context = one").withColumn("many", ~F.col("alone"))
        small = rest.where(F.col("kinds") <= hot).select(*_names(GROUP))
        left = small if left is None else left.unionByName(small)
        rows = rest.where(F.col("kinds") > hot).select(*_names(GROUP))
        if rows.isEmpty():
            return found, left
        release(rows.sparkSession)  # the round's shuffle files


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM, carry: bool = False, hot: int = HOT) -> DataFrame:
    """Each document without the bytes that a string of ``length`` bytes covers which starts anywhere else too.

    Texts are taken as UTF-8; matches stay inside a document; all occurrences go, judged on the input. Null counts as
    empty; texts shorter than ``length`` stay whole; equal rows repeat each other, so they lose the same bytes; an
    empty table gives no rows. With ``carry`` the input row but for its text comes along as struct ``row``, with
    ``no_text`` beside it; else other columns stay behind. Documents are told apart by a 64-bit hash of id and text.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary) (and ``row``, ``no_text``).
    """
    spark = docs.sparkSession
    release(spark)
    gram = min(gram, length)
    reach = length - gram
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    brought = ["row", "no_text"] if carry else []
    named = docs.select(
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"),
        *([row_struct(docs, text_col).alias("row"), F.col(text_col).isNull().alias("no_text")] if carry else []),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            bounds, data = flat(b.column(1))
            doc, place, h, context = anchors(data, bounds, length, gram)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(place), pa.array(h.view(np.int64)), pa.array(context.view(np.int64))], names=["key", "place", "anchor", "context"])

    found = cut(named.select("key", "text").mapInArrow(find, "key long, place long, anchor long, context long"))
    # Equal contexts are summed first, so an anchor has a row for each different context, not for each occurrence.
    spot = F.xxhash64("key", "place")
    distinct = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(spot).alias("one"))
    # Written, so that the join with it is between two exchanges, which adaptive execution splits at a hot anchor.
    often = cut(distinct.groupBy("anchor").agg(F.sum("n").alias("times"), F.count("*").alias("contexts")).where("times > 1").drop("times"))
    wanted = distinct.join(often, "anchor")
    several, hot_one = F.col("contexts") > 1, F.col("contexts") > hot
    spots = cut(found.join(wanted, ["anchor", "context"]).select("key", "place", "anchor", "context", (F.col("n") > 1).alias("many"), several.alias("several"), ((spot == F.col("one")) & several).alias("sends"), hot_one.alias("hot")))
    # All windows of a context with two places are repeated.
    whole = spots.where("many").select("key", (F.col("place") - reach).alias("lo"), (F.col("place") + length).alias("hi"))
    sends = F.struct("place", "anchor", "context", "many", "hot")
    by_doc = spots.where("sends").groupBy("key").agg(F.collect_set(sends).alias("spots"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            bounds, data = flat(b.column(0))
            own = b.column(1)
            doc = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            spot = own.flatten()
            place = bounds[doc] + spot.field("place").to_numpy()
            left, right = _bytes(data, np.maximum(bounds[doc], place - reach), place), _bytes(data, place + gram, np.minimum(bounds[doc + 1], place + length))
            zero = pa.array(np.zeros(len(place), np.int64))
            full = pa.array(np.full(len(place), reach, np.int32))
            many, hot_ = spot.field("many"), spot.field("hot")
            yield pa.RecordBatch.from_arrays([hot_, spot.field("anchor"), zero, zero.cast(pa.int32()), full, spot.field("context"), many, left, right], names=["hot", *_names(GROUP)])

    pieces = named.select("key", "text").join(by_doc, "key").select("text", "spots").mapInArrow(emit, f"hot boolean, {GROUP}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards solved; contexts of hot anchors as they came."""

        def cold() -> Iterator[pa.RecordBatch]:
            for b in batches:
                hot_ = b.column(0)
                if hot_.true_count:
                    waiting.append(b.filter(hot_))
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=_names(GROUP)).filter(pc.invert(hot_))

        def passed() -> Iterator[pa.RecordBatch]:
            for b in waiting:
                none = pa.nulls(b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(5), none, none, *b.columns[6:]], names=[*_names(FOUND), "many", "left", "right"])
            waiting.clear()

        waiting: list[pa.RecordBatch] = []
        for rows in _by_group(cold()):
            yield from passed()
            b = _solved(rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.bool_()), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=[*_names(FOUND), "many", "left", "right"])
        yield from passed()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            yield _solved(rows)

    shard = F.when(F.col("hot"), F.xxhash64("context")).otherwise(F.col("anchor"))
    solved = cut(pieces.withColumn("shard", shard).repartition(parts, "shard").drop("shard").sortWithinPartitions("anchor", "core", "context").mapInArrow(first, f"{FOUND}, many boolean, left binary, right binary"))
    release(spark)  # the texts and contexts that were dealt out are done with
    told = solved.where("low IS NOT NULL").select(*_names(FOUND))
    waiting = solved.where("low IS NULL")
    if not waiting.isEmpty():
        start = waiting.dropDuplicates(["anchor", "context"]).select("anchor", F.lit(0).cast("long").alias("core"), F.lit(0).alias("depth"), F.lit(reach).alias("width"), "context", "many", "left", "right")
        counted, groups = _thinned(start, hot)
        told = told.unionByName(counted).unionByName(groups.repartition(parts, "anchor", "core").sortWithinPartitions("anchor", "core", "context").mapInArrow(later, FOUND))
        told = told.groupBy("anchor", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    part = spots.where("several AND NOT many").join(told, ["anchor", "context"]).select("key", (F.col("place") - F.col("high")).alias("lo"), (F.col("place") - F.col("low") + length).alias("hi"))
    cuts = part.unionByName(whole).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    joined = named.join(cuts, "key", "left").select("doc_id", "text", "cuts", *brought)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            bounds, data = flat(b.column(1))
            raw = data.tobytes()
            out = []
            for i, own in enumerate(b.column(2).to_pylist()):
                at, spans, gone, kept = bounds[i], 0, 0, []
                reached = -1
                size = int(bounds[i + 1] - bounds[i])
                for lo, hi in sorted((max(0, c["lo"]), min(size, c["hi"])) for c in own or ()):
                    if lo > reached:
                        spans += 1
                        kept.append(raw[at : bounds[i] + lo])
                        gone += hi - lo
                    else:
                        gone += max(0, hi - reached)
                    reached = max(reached, hi)
                    at = bounds[i] + reached
                kept.append(raw[at : bounds[i + 1]])
                out.append((size, gone, spans, b"".join(kept)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), *b.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *brought])

    more = f", row {joined.schema['row'].dataType.simpleString()}, no_text boolean" if carry else ""
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary{more}")


def digest(removed: DataFrame) -> DataFrame:
    """``remove_repeats`` with the kept bytes' SHA-256 in place of the bytes."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["anchors", "digest", "remove_repeats", "repeated_depths"]
