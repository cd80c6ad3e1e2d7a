"""Node tables of long texts, parsed in pieces by many tasks: equal, row by row, to one pass over the whole text.

A text is cut into ranges, and each range is read once for what it does to a reader that comes to it in code, in a
comment or in a string: how it leaves, how many open blocks it closes and how many it opens. These effects compose, so
going through a text's few ranges in order tells how each begins. Then every range names the places where a top-level
block closes; the text is cut there, the pieces are parsed apart, and sums over the pieces before a piece give its
nodes their ids, lines, offsets, positions and the numbers of repeated keys.

Texts whose strings cannot be told from a range alone (escapes, inline expressions, a string that never closes) are
parsed in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.script import NODE, nodes, nodes_of

RANGE = 1 << 20  # characters read, and about as many parsed, by one task
SENT = 256  # ranges sent at once
STATES = CODE, COMMENT, STRING = 0, 1, 2
MARK = re.compile(r'[{}"#\n]')
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def walk(text: str, state: int) -> Iterator[tuple[int, str]]:
    """Braces outside comments and strings, with their places; at last (-1, the state at the end)."""
    for m in MARK.finditer(text):
        c = m.group()
        if state == CODE:
            if c == "#":
                state = COMMENT
            elif c == '"':
                state = STRING
            elif c != "\n":
                yield m.start(), c
        elif state == COMMENT and c == "\n" or state == STRING and c == '"':
            state = CODE
    yield -1, str(state)


def effect(text: str, state: int) -> tuple[int, int, int]:
    """What a range does to a reader: the state it leaves, blocks from before that it closes, blocks that it leaves open."""
    closes = opens = 0
    for at, c in walk(text, state):
        if at < 0:
            return int(c), closes, opens
        if c == "{":
            opens += 1
        elif opens:
            opens -= 1
        else:
            closes += 1
    raise AssertionError


def ends(text: str, state: int, depth: int) -> list[int]:
    """Places behind a brace that closes a top-level block, for a reader that comes in ``state`` at ``depth``."""
    out = []
    for at, c in walk(text, state):
        if at >= 0 and c == "{":
            depth += 1
        elif at >= 0 and depth:  # a stray brace closes nothing
            depth -= 1
            if not depth:
                out.append(at + 1)
    return out


def _arrow(rows: list[tuple], like: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(like)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, like)], names=[n for n, _ in like])


def long_nodes(contents: DataFrame, key: str = "digest", text: str = "text", size: int = RANGE) -> DataFrame:
    """The node table of ``script.nodes`` for contents of any length. ``key`` is a unique text and not null; texts of up to
    ``size`` characters, null ones too, are parsed in one pass. Contents are read several times, so give a stored table.
    """
    slim = contents.select(F.col(key).alias("digest"), F.col(text).alias("text"))
    # In a string without escapes a quote ends it, and @[ can hold anything.
    simple = (F.length("text") > size) & ~F.col("text").contains("\\") & ~F.col("text").contains("@[")
    long = slim.where(simple)
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = [("digest", pa.string()), ("no", pa.int32()), ("part", pa.string())]
        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):  # one text at a time, gone through once
                d, t = d.as_py(), t.as_py()
                for at in range(0, len(t), size * SENT):
                    yield _arrow([(d, k // size, t[k : k + size]) for k in range(at, min(at + size * SENT, len(t)), size)], like)

    spread = long.mapInArrow(ranged, "digest string, no int, part string").repartition(parts, "digest", "no")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = [("digest", pa.string()), ("no", pa.int32()), ("to", pa.list_(pa.int32())), ("closes", pa.list_(pa.int32())), ("opens", pa.list_(pa.int32())), ("feeds", pa.int64()), ("length", pa.int64())]
        for b in batches:
            rows = []
            for d, no, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                all_of = [effect(t, s) for s in STATES]
                rows.append((d, no, *map(list, zip(*all_of)), t.count("\n"), len(t)))
            yield _arrow(rows, like)

    told = spread.mapInArrow(effects, "digest string, no int, to array<int>, closes array<int>, opens array<int>, feeds long, length long")

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = [("digest", pa.string()), ("no", pa.int32()), ("state", pa.int32()), ("depth", pa.int32()), ("feeds", pa.int64()), ("length", pa.int64()), ("to", pa.int32())]
        now = None
        for b in batches:
            rows = []
            for d, no, to, closes, opens, feeds, length in zip(*(b.column(i).to_pylist() for i in range(7))):
                if d != now:
                    now, s, depth, lines, chars = d, CODE, 0, 0, 0
                rows.append((d, no, s, depth, lines, chars + length, to[s]))
                depth, lines, chars, s = max(depth - closes[s], 0) + opens[s], lines + feeds, chars + length, to[s]
            yield _arrow(rows, like)

    # What ranges do, without their texts, is gone through in order, a row at a time.
    in_order = told.repartition(parts, "digest").sortWithinPartitions("digest", "no")
    begun = in_order.mapInArrow(gone_through, "digest string, no int, state int, depth int, feeds long, length long, to int")
    ended = begun.groupBy("digest").agg(F.max(F.struct("no", "to", "length")).alias("e")).where(F.col("e.to") != STRING).select("digest", F.col("e.length").alias("whole"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = [("digest", pa.string()), ("no", pa.int32()), ("cut", pa.int64()), ("line", pa.int64())]
        for b in batches:
            rows = []
            for d, no, t, state, depth, feeds in zip(*(b.column(i).to_pylist() for i in range(6))):
                found = ends(t, state, depth)
                if found:  # the last one of a range: pieces are about as long as ranges
                    rows.append((d, no, no * size + found[-1], feeds + t.count("\n", 0, found[-1])))
            yield _arrow(rows, like)

    at_range = spread.join(begun.hint("shuffle_merge"), ["digest", "no"]).select("digest", "no", "part", "state", "depth", "feeds")
    cut = at_range.mapInArrow(cuts, "digest string, no int, cut long, line long").hint("shuffle_merge").join(ended, "digest")
    first = ended.select("digest", F.lit(-1).alias("no"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("line"), "whole")
    piece = F.row_number().over(Window.partitionBy("digest").orderBy("no")) - 1
    places = first.unionByName(cut).withColumn("piece", piece)
    # A range's text up to its cut ends the piece before, and the rest of it begins the next or goes on with the last.
    so_far = Window.partitionBy("digest").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = begun.select("digest", "no").join(ended.hint("shuffle_merge"), "digest").join(cut.select("digest", "no", "cut").hint("shuffle_merge"), ["digest", "no"], "left")
    marks = marks.select("digest", "no", "cut", F.count("cut").over(so_far).cast("int").alias("piece"))
    whole_parts = spread.join(marks.hint("shuffle_merge"), ["digest", "no"])
    here = (F.col("cut") - F.col("no").cast("long") * size).cast("int")
    fragment = lambda piece, text: F.struct(piece.alias("piece"), text.alias("text"))
    both = F.array(fragment(F.col("piece") - 1, F.substring("part", F.lit(1), here)), fragment(F.col("piece"), F.substring("part", here + 1, F.lit(size))))
    fragments = whole_parts.select("digest", "no", F.explode(F.when(F.col("cut").isNull(), F.array(fragment(F.col("piece"), F.col("part")))).otherwise(both)).alias("f")).select("digest", "no", "f.*")
    joined = fragments.groupBy("digest", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text"))
    texts = joined.join(places.hint("shuffle_merge"), ["digest", "piece"]).select("digest", "piece", "cut", "line", "whole", "text")

    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    like = [(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = [("digest", pa.string()), ("piece", pa.int32()), *like, ("top_name", pa.string()), ("nth", pa.int32())]
        for b in batches:
            for d, k, at, line, length, t in zip(*(b.column(i).to_pylist() for i in range(6))):
                rows, tops = [], {}
                for r in nodes_of(t):
                    if r[4] == "root":
                        if k:
                            continue
                        r[11] = length
                    else:
                        r[9] += line
                        r[10] += at
                        r[11] = None if r[11] is None else r[11] + at
                    rows.append(r)
                    if r[2] == 0 and r[4] != "error":
                        name = r[5] if r[5] is not None else "[]"
                        tops[r[0]] = (name, int(r[12][len(name) + 1 : -1] or 0) if r[12] != name else 0)
                yield _arrow([(d, k, *r, *tops.get(r[14], (None, None))) for r in rows], named)

    made = texts.repartition("digest", "piece").select("digest", "piece", "cut", "line", "whole", "text").mapInArrow(parsed, f"digest string, piece int, {NODE}, top_name string, nth int")
    before = Window.partitionBy("digest").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = made.where("node_type <> 'root'").groupBy("digest", "piece").agg(F.count("*").cast("int").alias("ids"), F.count_if((F.col("depth") == 0) & (F.col("node_type") != "error")).cast("int").alias("tops"))
    sums = places.select("digest", "piece").join(sums, ["digest", "piece"], "left").select("digest", "piece", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0)).cast("int").alias(f"__{c}") for c in ("ids", "tops")])
    again = Window.partitionBy("digest", "top_name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    named = made.where("depth = 0 AND top_name IS NOT NULL").groupBy("digest", "top_name", "piece").agg(F.count("*").alias("n"))
    named = named.select("digest", "top_name", "piece", F.coalesce(F.sum("n").over(again), F.lit(0)).cast("int").alias("__nth"))
    told = made.hint("shuffle_merge").join(sums, ["digest", "piece"]).join(named, ["digest", "top_name", "piece"], "left")
    moved = lambda c: F.when(F.col(c) > 0, F.col(c) + F.col("__ids")).otherwise(F.col(c))
    index = lambda c: F.when(c > 0, F.concat(F.lit("["), c.cast("string"), F.lit("]"))).otherwise(F.lit(""))
    prefix = F.length(F.concat("top_name", index(F.col("nth"))))
    path = F.when(F.col("top_name").isNull(), F.col("path")).otherwise(F.concat("top_name", index(F.col("nth") + F.col("__nth")), F.substring("path", prefix + 1, F.length("path"))))
    pos = F.when((F.col("depth") == 0) & (F.col("pos") >= 0), F.col("pos") + F.col("__tops")).otherwise(F.col("pos"))
    new = {"node_id": moved("node_id"), "parent_id": moved("parent_id"), "top_id": moved("top_id"), "pos": pos, "path": path}
    pieces = told.select("digest", *[new.get(c, F.col(c)).alias(c) for c in COLUMNS])

    rest = slim.join(ended.select("digest"), "digest", "left_anti")
    out = nodes(rest).unionByName(pieces)
    return out if key == "digest" else out.withColumnRenamed("digest", key)
