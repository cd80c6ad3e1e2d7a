"""Changes between two versions of script that survive insertions: the leaves of each block are aligned by a longest common
subsequence, so that an item put in front of a list is one change and not a change of every position behind it.

Blocks are met by path in one join, and only those whose leaves differ go to a task's Python, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending. What both begin and end with is taken as it is; of the rest
    a row of bits is kept for each item of ``a``, a bit for each of ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    at: dict = {}
    for j, item in enumerate(y):
        at[item] = at.get(item, 0) | 1 << j
    every = (1 << len(y)) - 1
    same, rows = every, []  # a bit is 0 where one more item of y makes the common subsequence longer
    for item in x:
        hit = same & at.get(item, 0)
        same = ((same + hit) | (same - hit)) & every
        rows.append(same)
    met, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                met.append((start + i, start + j))
    return [(k, k) for k in range(start)] + met[::-1] + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def edits(old: Sequence[tuple], new: Sequence[tuple]) -> list[tuple]:
    """(change_type, old place, new place) that make ``new`` of ``old``; items are tuples whose first part is a name. Between
    two aligned items a removed and an added one of the same name are one that was modified."""
    out, i, j = [], 0, 0
    for p, q in [*common(old, new), (len(old), len(new))]:
        gone, come = list(range(i, p)), list(range(j, q))
        for a in gone:
            twin = next((b for b in come if new[b][0] == old[a][0]), None)
            if twin is None:
                out.append(("removed", a, None))
            else:
                come.remove(twin)
                out.append(("modified", a, twin))
        out += [("added", None, b) for b in come]
        i, j = p + 1, q + 1
    return out


def list_changes(base: DataFrame, other: DataFrame, keep: Sequence[str] = ("digest",)) -> DataFrame:
    """Changes of leaves between two node tables: keep, path (of the block around), name ("[]" for an item of a list),
    change_type, old_value, new_value, old_pos, new_pos (places among the leaves of all blocks of that path).

    Blocks of one path, such as repeated keys without a place of their own, are one list in the order of the text. A block
    that only one side has gives its leaves as removed or added. Equal versions give no rows.
    """
    name = F.coalesce("key", F.lit("[]"))
    bare = F.when(F.col("path").endswith(name), F.col("path")).otherwise(F.regexp_replace("path", r"\[\d+\]$", ""))
    around = F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - F.length(name)), F.lit("."))
    leaf = F.struct("node_id", name.alias("name"), F.coalesce("op", F.lit("")).alias("op"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("value_type", F.lit("")).alias("kind"))

    def side(tree: DataFrame, s: str) -> DataFrame:
        own = tree.where(F.col("node_type").isin("assignment", "value")).groupBy(*keep, around.alias("path")).agg(F.sort_array(F.collect_list(leaf)).alias("all"))
        return own.select(*keep, "path", F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["op"].alias("op"), x["value"].alias("value"), x["kind"].alias("kind"))).alias(s))

    both = side(base, "old").join(side(other, "new"), [*keep, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(*keep, "path", "old", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, told = [], []
            for k, (old, new) in enumerate(zip(b.column(len(keep) + 1).to_pylist(), b.column(len(keep) + 2).to_pylist())):
                x, y = ([tuple(i.values()) for i in side or ()] for side in (old, new))
                for change, i, j in edits(x, y):
                    row.append(k)
                    told.append(((x[i] if j is None else y[j])[0], change, None if i is None else x[i][2], None if j is None else y[j][2], i, j))
            columns = list(zip(*told)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(row, pa.int64())) for c in range(len(keep) + 1)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=[*keep, "path", "name", "change_type", "old_value", "new_value", "old_pos", "new_pos"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[: len(keep)])
    return both.mapInArrow(run, f"{kept}, path string, name string, change_type string, old_value string, new_value string, old_pos long, new_pos long")
