"""Which definition of a key wins under a load order, who loses, and how containers merge.

A winner is a grouped maximum of a struct that begins with the load order, so every key is reduced map-side before it
moves: a key with a third of all rows costs no more than any other. Losers are found by joining the small table of
winners back; adaptive execution splits a hot key there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_WINS = "fios"


def winners(defs: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), first: bool = False) -> DataFrame:
    """One row a key: the definition that comes last (``first``: first) by ``order``, and how many others it hides.

    ``order`` should end in tie-breaks. Null keys are one key; nulls in ``order`` sort first. Duplicate rows count as
    hidden. No rows give no rows. Returns key, order and carry columns, and overridden_count.
    """
    columns = [*order, *[c for c in carry if c not in order]]
    best = (F.min if first else F.max)(F.struct(*columns)).alias("__w")
    return defs.groupBy(*key).agg(best, (F.count("*") - 1).alias("overridden_count")).select(*key, *[F.col("__w")[c].alias(c) for c in columns], "overridden_count")


def losers(defs: DataFrame, key: Sequence[str], order: str, ties: Sequence[str], winner_id: str) -> DataFrame:
    """The rows of a lower load order than their key's winner, with the winner's id and order."""
    best = winners(defs, key, [order, *ties]).select(*key, F.col(order).alias("winner_order"), F.col(winner_id).alias(f"winner_{winner_id}"))
    return defs.join(best, list(key)).where(F.col(order) < F.col("winner_order"))


def survivors(files: DataFrame, path: Sequence[str], order: str) -> DataFrame:
    """The rows of the highest load order of each path, ties included: a later source's file replaces an earlier one's."""
    top = files.groupBy(*path).agg(F.max(order).alias("__top"))
    return files.join(top, list(path)).where(F.col(order) == F.col("__top")).drop("__top")


def dispatch(defs: DataFrame, key: Sequence[str], order: Sequence[str], policy: str, carry: Sequence[str] = ()) -> DataFrame:
    """Winners under each key's own policy: the first definition under "fios", the last under any other."""
    columns = [*order, *[c for c in carry if c not in order]]
    both = defs.groupBy(*key, policy).agg(F.max(F.struct(*columns)).alias("__l"), F.min(F.struct(*columns)).alias("__f"), (F.count("*") - 1).alias("overridden_count"))
    pick = F.when(F.col(policy) == FIRST_WINS, F.col("__f")).otherwise(F.col("__l"))
    return both.withColumn("__w", pick).select(*key, policy, *[F.col("__w")[c].alias(c) for c in columns], "overridden_count")


def merge_containers(slots: DataFrame, key: str, order: Sequence[str], item: str, slot: str, appended: Sequence[str], sep: str = ",") -> DataFrame:
    """Containers merged over all sources: slots in ``appended`` become lists in load order, of a single slot the last
    source's items stay.

    ``slots`` has a row for each item: key, slot name, order columns (the first is the source's load order) and the
    item. More than one source in a single slot is a conflict. A list is as long as a container's items, which the
    script format bounds; it is built by key and slot, never for a whole table.

    Returns key, slot, merged (text), n_items, n_sources, winner (load order of the last source), conflict.
    """
    many = F.col(slot).isin(*appended)
    grouped = slots.groupBy(key, slot).agg(F.sort_array(F.collect_list(F.struct(*order, item))).alias("__all"), F.count("*").alias("n_items"), F.max(order[0]).alias("__last"))
    kept = F.filter("__all", lambda x: many | (x[order[0]] == F.col("__last")))
    n_sources = F.size(F.array_distinct(F.transform("__all", lambda x: x[order[0]]))).cast("long")
    merged = F.array_join(F.transform(kept, lambda x: x[item].cast("string")), sep)
    return grouped.select(key, slot, merged.alias("merged"), "n_items", n_sources.alias("n_sources"), F.col("__last").alias("winner"), (~many & (n_sources > 1)).alias("conflict"))


def trace(defs: DataFrame, name_col: str, name: object, order: Sequence[str]) -> DataFrame:
    """All definitions of one name in load order, the last marked as the winner."""
    own = defs.where(F.col(name_col) == F.lit(name))
    best = own.agg(F.max(F.struct(*order)).alias("__w"))
    return own.crossJoin(F.broadcast(best)).select(*own.columns, (F.struct(*order) == F.col("__w")).alias("is_winner")).orderBy(*order)  # one row on the right


def merge_two(ours: DataFrame, theirs: DataFrame, key: Sequence[str], value: str, strategy: str) -> DataFrame:
    """A two-way merge by key: "ours", "theirs" (the other side where it has none), "union" and "latest" keep both sides'
    keys and differ in who wins where both have one. Returns key, value, side, conflict."""
    if strategy not in ("ours", "theirs", "union", "latest"):
        raise ValueError(f"unknown strategy {strategy}")
    a, b = ours.select(*key, F.col(value).alias("__a"), F.lit(1).alias("__in_a")), theirs.select(*key, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    both = a.join(b, list(key), "full_outer")
    in_a, in_b = F.col("__in_a").isNotNull(), F.col("__in_b").isNotNull()
    ours_first = strategy in ("ours", "union")
    take_a = (in_a if ours_first else in_a & ~in_b)
    conflict = in_a & in_b & ~F.col("__a").eqNullSafe(F.col("__b"))
    return both.select(*key, F.when(take_a, F.col("__a")).otherwise(F.col("__b")).alias(value), F.when(take_a, "ours").otherwise("theirs").alias("side"), conflict.alias("conflict"))


def first_wins(defs: DataFrame, key: Sequence[str], path: Sequence[str], order: str, ties: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """First definitions of each key among the files that survive: between files of one path the last still wins."""
    return winners(survivors(defs, path, order), key, [order, *ties], carry, first=True)


def resolved(defs: DataFrame, key: str, folder: str, order: Sequence[str], policies: Sequence[tuple[str, str]] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All folders in one plan: each name of each folder under the folder's own merge policy.

    Returns folder, key, policy, order and carry columns, overridden_count.
    """
    from palimpsest.functions.rules import POLICIES, first_of

    rule = first_of([(F.col(folder).startswith(p), F.lit(n)) for p, n in (policies or POLICIES)], F.lit("override"))
    return dispatch(defs.withColumn("policy", rule), [folder, key], order, "policy", carry)


def state_totals(won: DataFrame, folder: str, source: str) -> DataFrame:
    """Of each folder of a resolved state: names, names that hide others, hidden definitions, sources that win any."""
    return won.groupBy(folder).agg(F.count("*").alias("n_names"), F.count_if(F.col("overridden_count") > 0).alias("n_conflicts"), F.sum("overridden_count").alias("n_hidden"), F.count_distinct(source).alias("n_sources"))


def unresolvable(files: DataFrame, tree: DataFrame, key: str = "digest") -> DataFrame:
    """Files that a resolution cannot use: not parsed at all, or parsed with errors (their number and the first)."""
    bad = tree.where("error IS NOT NULL").groupBy(key).agg(F.count("*").alias("n_errors"), F.min(F.struct("line", "error"))["error"].alias("first_error"))
    seen = tree.select(key).distinct().withColumn("__seen", F.lit(True))
    told = files.join(seen, key, "left").join(bad, key, "left")
    return told.where("__seen IS NULL OR n_errors > 0").select(*files.columns, F.coalesce("n_errors", F.lit(0).cast("long")).alias("n_errors"), F.coalesce("first_error", F.lit("not parsed")).alias("first_error"))
