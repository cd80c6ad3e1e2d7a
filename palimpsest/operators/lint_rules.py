"""A registry of lint rules evaluated together: one scan of the node table and one shuffle, however many rules there are.

A node rule is a condition on a node's own columns, of which ``scope`` tells what kind of thing the script is about there.
A block rule looks at a block with all its assignments and blocks. Rules of one's own are made the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeRule:
    """Finds the nodes that meet a condition on node_type, key, op, value, depth, ancestors, scope."""

    name: str
    severity: str
    when: Column


@dataclass(frozen=True)
class BlockRule:
    """Finds places in a block: from columns key, path, line, depth and ``children`` (an array of node_id, key, path, line,
    in the order of the text) an array of structs (path, line, n)."""

    name: str
    severity: str
    found: Callable[[Column], Column]


def scope(ancestors: Column, transitions: Mapping[str, str], start: Column | str = "root") -> Column:
    """What a node is about: going down its ancestors, each key of ``transitions`` changes it, other keys leave it as it is.
    A fold inside the row: types are pushed down without a join for each level."""
    table = F.create_map(*[F.lit(x) for pair in transitions.items() for x in pair]) if transitions else F.create_map().cast("map<string,string>")
    first = F.lit(start) if isinstance(start, str) else start
    return F.aggregate(F.coalesce(ancestors, F.array().cast("array<string>")), first, lambda s, k: F.coalesce(F.try_element_at(table, k), s))


def wrong_scope(allowed: Mapping[str, Sequence[str]], name: str = "wrong_scope", severity: str = "error") -> NodeRule:
    """Keys used where the script is about something that they do not apply to."""
    bad = F.lit(False)
    for key, scopes in allowed.items():
        bad = bad | ((F.col("key") == key) & ~F.col("scope").isin(*scopes))
    return NodeRule(name, severity, bad)


def deprecated(names: Sequence[str]) -> NodeRule:
    return NodeRule("deprecated", "warning", F.col("key").isin(*names))


def truth_values() -> NodeRule:
    """Truth values are yes and no."""
    return NodeRule("truth_value", "warning", (F.col("node_type") == "assignment") & F.lower("value").isin("true", "false"))


def too_deep(most: int) -> NodeRule:
    return NodeRule("too_deep", "info", (F.col("node_type") == "block") & (F.col("depth") > most))


def _of(children: Column) -> Column:
    return F.struct(children["path"].alias("path"), children["line"].alias("line"), F.lit(1).cast("long").alias("n"))


def _itself(n: Column) -> Column:
    """The block as the one place, ``n`` times; none where that is 0."""
    return F.filter(F.array(F.struct(F.col("path").alias("path"), F.col("line").alias("line"), n.cast("long").alias("n"))), lambda x: x["n"] > 0)


def duplicate_keys() -> BlockRule:
    """Keys that a block assigns more than once: at the first, how often."""

    def found(children: Column) -> Column:
        own = F.filter(children, lambda c: c["is_value"])
        keys = F.array_distinct(F.transform(own, lambda c: c["key"]))

        def one(k: Column) -> Column:
            same = F.filter(own, lambda c: c["key"] == k)
            return F.struct(F.get(same, F.lit(0))["path"].alias("path"), F.get(same, F.lit(0))["line"].alias("line"), F.size(same).cast("long").alias("n"))

        # Looked into only where a key repeats at all.
        return F.when(F.size(keys) == F.size(own), F.array().cast("array<struct<path:string,line:int,n:bigint>>")).otherwise(F.filter(F.transform(keys, one), lambda x: x["n"] > 1))

    return BlockRule("duplicate_key", "warning", found)


def empty_block() -> BlockRule:
    return BlockRule("empty_block", "info", lambda children: _itself((F.col("n_inside") == 0).cast("int")))


def missing_keys(names: Sequence[str]) -> BlockRule:
    """Top-level blocks without one of the required keys, n: how many they lack."""
    return BlockRule("missing", "error", lambda children: _itself(F.when(F.col("depth") == 0, len(set(names)) - F.size(F.array_intersect(F.array_distinct(F.transform(children, lambda c: c["key"])), F.array(*[F.lit(n) for n in names])))).otherwise(0)))


def lint(tree: DataFrame, rules: Sequence[NodeRule | BlockRule], transitions: Mapping[str, str] | None = None, start: Column | str = "root", key: str = "digest") -> DataFrame:
    """All findings of all rules: key, rule, severity, path, line, n.

    Each node goes to its own block and, if it has a key, to its parent as a child, in one shuffle by block; what a node
    rule finds goes along. A row holds one block's keyed children, as a row of the node table's texts holds a text.
    """
    node_rules = [r for r in rules if isinstance(r, NodeRule)]
    block_rules = [r for r in rules if isinstance(r, BlockRule)]
    place = lambda r, path, line, n: F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), path.alias("path"), line.cast("int").alias("line"), n.cast("long").alias("n"))
    told = tree.withColumn("scope", scope(F.col("ancestors"), transitions or {}, start))
    hits = [F.when(F.coalesce(r.when, F.lit(False)), place(r, F.col("path"), F.col("line"), F.lit(1))) for r in node_rules]
    kind = "array<struct<rule:string,severity:string,path:string,line:int,n:bigint>>"
    own = F.filter(F.array(*hits), lambda x: x.isNotNull()).cast(kind) if hits else F.array().cast(kind)
    child = F.when(F.col("key").isNotNull(), F.struct("node_id", "key", "path", F.col("line").cast("int").alias("line"), (F.col("node_type") == "assignment").alias("is_value")))
    block = F.when(F.col("node_type") == "block", F.struct("key", "path", F.col("line").cast("int").alias("line"), "depth"))
    nothing = lambda c: F.lit(None).cast(told.select(c.alias("c")).schema["c"].dataType)
    to_itself = F.struct(F.col("node_id").alias("at"), block.alias("block"), nothing(child).alias("child"), F.lit(0).alias("inside"), own.alias("own"))
    to_parent = F.struct(F.col("parent_id").alias("at"), nothing(block).alias("block"), child.alias("child"), F.lit(1).alias("inside"), F.array().cast(kind).alias("own"))
    sent = told.select(key, F.explode(F.array(to_itself, to_parent)).alias("s")).where("s.at IS NOT NULL AND (s.block IS NOT NULL OR s.inside = 1 OR size(s.own) > 0)")
    blocks = sent.groupBy(key, F.col("s.at").alias("at")).agg(
        F.max("s.block").alias("block"), F.sort_array(F.collect_list("s.child")).alias("children"), F.sum("s.inside").alias("n_inside"), F.flatten(F.collect_list("s.own")).alias("own")
    )
    opened = blocks.select(key, "own", "children", "n_inside", F.col("block.key").alias("key"), F.col("block.path").alias("path"), F.col("block.line").alias("line"), F.col("block.depth").alias("depth"), F.col("block").isNotNull().alias("is_block"))
    found = [F.when(F.col("is_block"), F.transform(r.found(F.col("children")), _placed(r, place))).otherwise(F.array().cast(kind)) for r in block_rules]
    return opened.select(key, F.explode(F.concat(F.col("own"), *found)).alias("f")).select(key, "f.*")


def _placed(rule: BlockRule, place: Callable) -> Callable[[Column], Column]:
    return lambda x: place(rule, x["path"], x["line"], x["n"])
