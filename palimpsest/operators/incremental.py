"""A resolved state kept up to date: after a change of files only the keys that it touches are resolved again.

A change set is the definitions of files that are new or changed, and the files that are gone. Keys of which no file
changed keep their row; their definitions are neither grouped nor shuffled, unless a change set touches more than
``SMALL`` keys: then all keys are reduced again, which costs less than telling the touched ones apart by a shuffle of all
definitions. Where a winner's file goes, the next definition of its key is promoted. What a large change set leaves, in the
columns that decide, is stored in the shared folder, so that the next one starts from there and not from all before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import winners
from palimpsest.session import shared_folder

#: Rows up to which a change set's keys are broadcast; larger ones are joined by a shuffle.
SMALL = 1_000_000


@dataclass
class Resolved:
    """Definitions and, for each key, the one that wins. ``changes`` tells what the last change set did: a row for each touched
    key whose winner is new, gone or another, or whose number of hidden definitions is another."""

    defs: DataFrame
    state: DataFrame
    changes: DataFrame | None = None
    slim: DataFrame | None = None  # the definitions again, in the columns that a change set needs


def resolved(defs: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), first: bool = False) -> Resolved:
    """All keys resolved: a winner is the last (``first``: first) definition by ``order``, which should end in tie-breaks."""
    return Resolved(defs, winners(defs, key, order, carry, first))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` for a join: broadcast if their count allows it."""
    return F.broadcast(rows) if _is_small(rows) else rows


def _is_small(rows: DataFrame) -> bool:
    return rows.count() <= SMALL


def _stored(rows: DataFrame) -> DataFrame:
    path = shared_folder(rows.sparkSession, "changes")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _like(rows: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join that takes null keys for equal."""
    keys = keys.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = F.lit(True)
    for c in key:
        same = same & rows[c].eqNullSafe(keys[f"__{c}"])
    return rows.join(_small(keys), same, how)


def change(old: Resolved, new_defs: DataFrame, gone_files: DataFrame, key: Sequence[str], order: Sequence[str], file: Sequence[str], carry: Sequence[str] = (), first: bool = False) -> Resolved:
    """The state after a change set.

    ``new_defs``: all definitions of the files that are new or changed, columns as of the old ones. ``gone_files``: the
    ``file`` columns of those that are gone; a file in both is changed. Files that nobody knew may go. ``key``, ``order``,
    ``carry`` and ``first`` are those of ``resolved``.

    ``changes`` has the key columns, change (added, removed, replaced, recounted), and old and new as structs of a winner's
    columns. The result equals ``resolved`` of the new definitions.
    """
    files = new_defs.select(*file).unionByName(gone_files.select(*file)).distinct()
    needed = list(dict.fromkeys([*key, *order, *carry, *file]))
    known = old.slim if old.slim is not None and set(needed) <= set(old.slim.columns) else old.defs
    known = known.select(*needed)
    if _is_small(files):
        leaving, staying = (_like(known, files, file, how) for how in ("left_semi", "left_anti"))
    else:  # one shuffle of the definitions tells both
        left = files.select(*[F.col(c).alias(f"__{c}") for c in file], F.lit(True).alias("__leaves"))
        at = F.lit(True)
        for c in file:
            at = at & known[c].eqNullSafe(left[f"__{c}"])
        marked = _stored(known.join(left, at, "left").select(*needed, F.coalesce("__leaves", F.lit(False)).alias("__leaves")))
        leaving, staying = (marked.where(F.col("__leaves") == is_gone).drop("__leaves") for is_gone in (True, False))
    new = new_defs.select(*needed)
    touched = leaving.select(*key).unionByName(new.select(*key)).distinct()
    if _is_small(touched):
        again = winners(_like(staying, touched, key, "left_semi").unionByName(new), key, order, carry, first)
        state = _like(old.state, touched, key, "left_anti").unionByName(again)
        old_state = _like(old.state, touched, key, "left_semi")
    else:  # a key that nothing touches resolves to the row it had
        state = again = _stored(winners(staying.unionByName(new), key, order, carry, first))
        old_state = old.state

    columns = [c for c in old.state.columns if c not in key]
    before = old_state.select(*key, F.struct(*columns).alias("old"))
    after = again.select(*[F.col(c).alias(f"__{c}") for c in key], F.struct(*columns).alias("new"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = before.join(after, same, "full")
    winner = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in columns if c != "overridden_count"])
    kind = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~winner("old").eqNullSafe(winner("new")), "replaced")
        .when(F.col("old.overridden_count") != F.col("new.overridden_count"), "recounted")
    )
    own = [F.when(F.col("old").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in key]
    changes = both.select(*own, kind.alias("change"), "old", "new").where("change IS NOT NULL")
    return Resolved(_like(old.defs, files, file, "left_anti").unionByName(new_defs), state, changes, staying.unionByName(new))
