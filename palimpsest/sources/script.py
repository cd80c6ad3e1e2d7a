"""Brace-delimited script as a table of nodes: one row a node, made once for each distinct content.

The tokenizer is one regular expression and nesting is a stack of open blocks, so a text costs one pass and a row
leaves as soon as its node closes. All that follows (symbols, references, paths, diffs) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.rules import is_symbol_name, kind, mapped

NODE = "node_id int, parent_id int, depth int, pos int, node_type string, key string, op string, value string, value_type string, line int, start_off int, end_off int, path string, error string, top_id int, ancestors array<string>"

# What stands before a token belongs to its match, and the last alternative takes any character, so no text fails.
TOKEN = re.compile(
    r"""(?:[\s;,`\ufeff]+ | \#[^\n]*)* (?:(?P<atom>(?!@\[[^\]]*\])[^\s{}=<>!?"\#;,`]+ | [!?](?!=)) | (?P<op>\?=|<=|>=|!=|==|=|<|>) | (?P<open>\{) | (?P<close>\})
      | (?P<string>"(?:[^"\\]|\\[^\n])*") | (?P<inline>@\[[^\]]*\]) | (?P<bad>[\s\S]) | \Z)""",
    re.X,
)
NUMBER = re.compile(r"-?\d+(\.\d+)?%?$")
# Atoms with nothing but separators around and one more atom behind them, so that whatever stands before, all are bare values.
WORDS = re.compile(r"""(?:[\s;,`\ufeff]++[^\s{}=<>!?"\#;,`@\ufeff]++(?=[\s;,`])){1,1000}(?=[\s;,`\ufeff]++[^\s{}=<>!?"\#;,`@])""")
WORD = re.compile(r"[^\s;,`\ufeff]+")


def value_type(text: str, group: str) -> str:
    if group in ("string", "inline"):
        return {"string": "string", "inline": "inline_expression"}[group]
    if text in ("yes", "no"):
        return "bool"
    if text[:1].isalpha():  # most are
        return "identifier"
    if text.startswith("@"):
        return "scripted_value"
    if len(text) > 1 and text[0] == text[-1] == "$":
        return "param"
    return "number" if NUMBER.match(text) else "identifier"


def tokens(parts: Iterable[str]) -> Iterator[tuple[str, str, int, int, int]]:
    """Tokens of a text that comes in parts: group, token, start, end, line. A token that the next part may prolong, or make
    another one (a quote, @[), waits for it, so the tokens are those of the whole text; no more of it is held. What
    ``WORDS`` finds behind an atom comes as one token, with the line that it begins on."""
    held, base, line, need = "", 0, 1, 0
    source = iter(parts)
    part = next(source, None)
    while part is not None:
        held, part = held + part, next(source, None)
        if part is not None and len(held) < need:
            continue
        line_at, rest, end = 0, len(held), 0
        while True:
            m = TOKEN.match(held, end)
            group = m.lastgroup
            if part is not None and (m.end() == len(held) or group == "bad" or group == "atom" and held.startswith("@[", m.start(group))):
                rest = m.start()
                break
            if group is None:
                break
            at, end = m.span(m.lastindex)
            line += held.count("\n", line_at, at)
            line_at = at
            yield group, held[at:end], base + at, base + end, line
            if group == "atom" and (m := WORDS.match(held, end)):
                at, end = m.span()
                line += held.count("\n", line_at, at)
                line_at = at
                yield "words", m[0], base + at, base + end, line
        if rest > line_at:
            line += held.count("\n", line_at, rest)
        held, base = held[rest:], base + rest
        need = 2 * len(held)  # what waits long is not looked at again for each part


def nodes_of(text: str | Iterable[str], size: int | None = None) -> Iterator[list]:
    """Rows in the order of ``NODE``; ``top_id`` is the top-level node that a node is in, ``ancestors`` the keys of the
    blocks around it, outermost first. A stray or missing brace, or an unclosed string, gives an error row; parsing goes on.
    A text may come in parts, with its ``size`` in characters."""
    parts = [text] if isinstance(text, str) else text
    size = len(text) if isinstance(text, str) else size
    line = 1
    stack: list[list] = [[0, "", -1, {}, 0, None, []]]  # node id, path, depth, times each key was seen, children, row, keys
    rows, op, waiting, at = 1, None, None, 0
    yield [0, None, -1, 0, "root", None, None, None, None, 1, 0, size, "", None, None, []]

    def place(key: str | None) -> tuple[int, int, int, str]:
        top = stack[-1]
        pos = top[4]
        top[4] += 1
        name = key if key is not None else "[]"
        n = top[3][name] = top[3].get(name, -1) + 1
        return top[0], top[2] + 1, pos, (f"{top[1]}." if top[1] else "") + name + (f"[{n}]" if n else "")

    def within() -> list:
        return [stack[1][0] if len(stack) > 1 else rows, stack[-1][6]]

    def bare(w: tuple) -> list:
        # The most frequent node by far, so what ``place`` and ``within`` do is written out.
        token, group, at, line = w
        top = stack[-1]
        parent, prefix, depth, seen, pos, _, keys = top
        top[4] = pos + 1
        n = seen["[]"] = seen.get("[]", -1) + 1
        path = f"{prefix}.[]" if prefix else "[]"
        return [rows, parent, depth + 1, pos, "value", None, None, token[1:-1] if group == "string" else token, value_type(token, group), line, at, at + len(token), f"{path}[{n}]" if n else path, None, stack[1][0] if len(stack) > 1 else rows, keys]

    def error(what: str) -> list:
        return [rows, stack[-1][0], stack[-1][2] + 1, -1, "error", None, None, None, None, line, at, at, stack[-1][1], what, *within()]

    def words(text: str, at: int, line: int) -> list[list]:
        """Rows of bare values, as ``bare`` makes them one by one."""
        top = stack[-1]
        parent, prefix, depth, seen, pos, _, keys = top
        path = f"{prefix}.[]" if prefix else "[]"
        n, upper, feeds, done = seen.get("[]", -1) + 1, stack[1][0] if len(stack) > 1 else None, "\n" in text, 0
        made = []
        for i, m in enumerate(WORD.finditer(text)):
            w, start = m[0], m.start()
            if feeds:
                line += text.count("\n", done, start)
                done = start
            kind = "identifier" if w[0].isalpha() and w != "yes" and w != "no" else value_type(w, "atom")
            made.append([rows + i, parent, depth + 1, pos + i, "value", None, None, w, kind, line, at + start, at + start + len(w), f"{path}[{n + i}]" if n + i else path, None, rows + i if upper is None else upper, keys])
        top[4], seen["[]"] = pos + len(made), n + len(made) - 1
        return made

    for group, token, at, end, line in tokens(parts):
        if group == "words":
            if waiting is not None:
                yield bare(waiting)
                rows, waiting = rows + 1, None
            made = words(token, at, line)
            yield from made
            rows += len(made)
        elif group == "bad":
            yield error("unclosed string")
            rows += 1
        elif group == "op":
            if waiting is None:
                yield error(f"operator {token} without key")
                rows += 1
            else:
                op = token
        elif group == "open":
            if waiting is not None and op is None:  # a value before an unnamed list
                yield bare(waiting)
                rows, waiting = rows + 1, None
            key = waiting[0].strip('"') if waiting is not None else None
            parent, depth, pos, path = place(key)
            opened = [rows, parent, depth, pos, "block" if key is not None else "list", key, op, None, None, waiting[3] if waiting else line, waiting[2] if waiting else at, None, path, None, *within()]
            stack.append([rows, path, depth, {}, 0, opened, [*stack[-1][6], key]])
            rows, waiting, op = rows + 1, None, None
        elif group == "close":
            if waiting is not None:
                yield bare(waiting)
                rows, waiting, op = rows + 1, None, None
            if len(stack) == 1:
                yield error("stray }")
                rows += 1
            else:
                done = stack.pop()[5]
                done[11] = end
                yield done
        else:
            now = (token, group, at, line)
            if waiting is not None and op is not None:
                key = waiting[0].strip('"')
                parent, depth, pos, path = place(key)
                value = token[1:-1] if group == "string" else token
                yield [rows, parent, depth, pos, "assignment", key, op, value, value_type(token, group), waiting[3], waiting[2], end, path, None, *within()]
                rows, waiting, op = rows + 1, None, None
            else:
                if waiting is not None:
                    yield bare(waiting)
                    rows += 1
                waiting = now
    if waiting is not None:
        yield bare(waiting)
        rows += 1
    while len(stack) > 1:
        done = stack.pop()[5]
        done[11], done[13] = size, "unclosed block"
        yield done


BATCH = 20_000  # rows sent at once
PART = 1 << 20  # characters of a text sent to a parser at once


def nodes(contents: DataFrame, key: str = "digest", text: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """The node table of distinct contents. Null text has no nodes; an empty one has its root. ``columns``: the only ones of
    ``NODE`` that are sent on; what a node costs is mostly its columns' way from Python to Spark.

    Contents are dealt to tasks by key first: texts are made from, or stored in, few and well compressed files, and parsing
    costs far more than reading them. A text is sent to its parser in parts, so that a long one is never held there; what
    grows with it is the set of its top-level keys. For the same reason Spark's guess at the table's size is far too low, so that a join
    with it is told not to broadcast it.
    """
    every = NODE.split(", ")
    wanted = [c for c in every if columns is None or c.split()[0] in columns]
    places, names = [every.index(c) for c in wanted], [c.split()[0] for c in wanted]
    kinds = [pa.int32() if c.endswith(" int") else pa.list_(pa.string()) if c.endswith(">") else pa.string() for c in wanted]

    def column(rows: list[list], i: int, kind: pa.DataType) -> pa.Array:
        values = [r[i] for r in rows]
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        # Nodes of a block hold the same list, which is converted once.
        same = {id(v): v for v in values}
        at = {k: n for n, k in enumerate(same)}
        return pa.array(same.values(), kind).take(pa.array([at[id(v)] for v in values], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        owner: list = []
        key_kind = None

        def out(rows: list[list], keys: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, key_kind), *(column(rows, i, t) for i, t in zip(places, kinds))], names=[key, *names])

        def parts_of() -> Iterator[tuple]:
            nonlocal key_kind
            count = 0
            for b in batches:
                key_kind = b.column(0).type
                for k, no, size, part in zip(*(b.column(i) for i in range(4))):  # one part at a time
                    count += no.as_py() == 0
                    yield count, k, size, part

        for _, rows in groupby(parts_of(), key=lambda r: r[0]):  # a text's parts follow each other
            first = next(rows)
            k, size = first[1].as_py(), first[2].as_py()
            found = nodes_of((r[3].as_py() for r in chain((first,), rows)), size)
            while some := list(islice(found, BATCH - len(held))):  # a long text leaves in pieces
                held += some
                owner += [k] * len(some)
                if len(held) >= BATCH:
                    yield out(held, owner)
                    held, owner = [], []
        if held:
            yield out(held, owner)

    key_type = contents.schema[key].dataType.simpleString()
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / PART).cast("int"))
    sent = contents.select(key, text).repartition(parts, key).withColumn("__no", F.explode(F.when(F.col(text).isNotNull(), F.sequence(F.lit(0), last))))
    sent = sent.select(key, "__no", F.length(text).alias("__size"), F.substring(text, F.col("__no") * PART + 1, F.lit(PART)).alias("__part"))
    return sent.mapInArrow(run, f"{key} {key_type}, {', '.join(wanted)}").hint("shuffle_merge")


def symbols(tree: DataFrame, files: DataFrame, key: str = "digest") -> DataFrame:
    """Definitions in each file, with the kind that its path tells: named top-level blocks, top-level assignments except
    of @ constants, the faiths of religions, and titles inside titles. Equal contents fan out to every file with them.

    Returns key, name, line, start_off, end_off, node_id, signature (an assignment's value), source, relpath, symbol_type.
    """
    kinds = files.select(key, "source", "relpath", kind(F.col("relpath")).alias("symbol_type"))
    named = tree.where(F.col("node_type").isin("block", "assignment") & is_symbol_name(F.col("key")))
    columns = [key, F.col("key").alias("name"), "line", "start_off", "end_off", "node_id", F.when(F.col("node_type") == "assignment", F.col("value")).alias("signature")]
    top = named.where((F.col("depth") == 0) & ~F.col("key").startswith("@")).select(*columns)
    faiths = named.where((F.col("node_type") == "block") & (F.col("depth") == 2) & (F.get("ancestors", F.lit(1)) == "faiths")).select(*columns)
    # A title's blocks are titles; below one that has no valid name, none are.
    inside = F.forall(F.slice("ancestors", 2, 8), is_symbol_name) & F.col("depth").between(1, 6)
    titles = named.where((F.col("node_type") == "block") & inside).select(*columns)
    found = top.join(kinds, key)
    found = found.unionByName(faiths.join(kinds.where("symbol_type = 'religion'").withColumn("symbol_type", F.lit("faith")), key))
    return found.unionByName(titles.join(kinds.where("symbol_type = 'title'"), key))


# Keys whose value names something defined elsewhere, with its kind; keys whose value names a script; keys
# that open an effect or a trigger.
REFERENCES = {
    "has_trait": "trait", "add_trait": "trait", "remove_trait": "trait", "trait": "trait", "has_perk": "perk", "add_perk": "perk",
    "perk": "perk", "has_focus": "focus", "set_focus": "focus", "focus": "focus", "has_culture": "culture", "culture": "culture",
    "has_religion": "religion", "religion": "religion", "faith": "faith", "government_type": "government",
    "has_government": "government", "add_artifact": "artifact", "has_artifact": "artifact", "create_artifact": "artifact",
    "trigger_event": "event", "random_events_list": "event", "add_building": "building", "has_building": "building",
    "building": "building", "has_building_or_higher": "building", "create_title_and_vassal_change": "title", "title": "title",
    "has_title": "title", "has_cb": "cb_type", "casus_belli": "cb_type", "cb_type": "cb_type", "has_law": "law", "add_law": "law",
    "run_interaction": "interaction", "has_tradition": "tradition", "can_have_tradition": "tradition", "start_scheme": "scheme",
    "scheme_type": "scheme", "has_activity_type": "activity", "activity_type": "activity", "has_lifestyle": "lifestyle",
    "lifestyle": "lifestyle",
}
SCRIPTS = {"run_scripted_effect": "scripted_effect", "scripted_effect": "scripted_effect", "run_scripted_trigger": "scripted_trigger", "scripted_trigger": "scripted_trigger"}
CONTEXTS = (
    "effect", "limit", "trigger", "modifier", "show_as_tooltip", "on_action", "on_activate", "on_complete", "on_start", "on_death",
    "ai_will_do", "is_shown", "is_valid", "cost", "potential", "success", "failure", "effect_on_target", "effect_on_actor",
    "on_accept", "on_decline", "can_send", "can_be_picked",
)
# End of fixed values.


def references(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Names used by assignments whose key says what kind of thing the value is, with the nearest effect or trigger block
    around as context, else the key itself. A parameter ($NAME$) is a reference to a script only, and empty is none."""
    used = tree.where((F.col("node_type") == "assignment") & F.col("key").isin(*REFERENCES, *SCRIPTS) & (F.col("value") != ""))
    used = used.where(F.col("key").isin(*SCRIPTS) | ~F.col("value").startswith("$"))
    around = F.filter("ancestors", lambda x: x.isin(*CONTEXTS))
    nearest = F.coalesce(F.get(around, F.size(around) - 1), F.col("key"))
    return used.select(key, F.col("value").alias("name"), mapped(REFERENCES | SCRIPTS, F.col("key"), None).alias("ref_type"), nearest.alias("context"), "line", "path", "top_id")


SLOTS = ("depth", "pos", "node_type", "key", "op", "value", "ancestors")  # columns that ``slots`` reads


def slots(tree: DataFrame, names: tuple[str, ...], key: str = "digest") -> DataFrame:
    """Items of the named slots of each top-level container: container, slot, pos, item. An item with an operator, such as
    a weight, keeps it (100=name); a slot that is no block is its own item. A node names its container itself, so nothing
    is joined; what is inside an unnamed list has none."""
    text = F.when(F.col("node_type") == "assignment", F.concat("key", "op", "value")).otherwise(F.coalesce("value", "key"))
    slot = F.get("ancestors", F.lit(1))
    inside = (F.col("depth") == 2) & slot.isin(*names)
    alone = (F.col("depth") == 1) & (F.col("node_type") == "assignment") & F.col("key").isin(*names)
    own = tree.where(inside | alone).select(key, F.get("ancestors", F.lit(0)).alias("container"), F.when(inside, slot).otherwise(F.col("key")).alias("slot"), "pos", F.when(inside, text).otherwise(F.col("value")).alias("item"))
    return own.where("container IS NOT NULL")


def diff(base: DataFrame, other: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Changes between two node tables by path: added, removed or modified leaf values and operators."""
    leaf = lambda t, s: t.where(F.col("node_type").isin("assignment", "value")).select(*keep, "path", F.col("value").alias(f"{s}_value"), F.col("value_type").alias(f"{s}_type"), F.col("op").alias(f"{s}_op"))
    both = leaf(base, "old").join(leaf(other, "new"), [*keep, "path"], "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(~(F.col("old_value").eqNullSafe(F.col("new_value")) & F.col("old_op").eqNullSafe(F.col("new_op"))), "modified")
    return both.withColumn("change_type", change).where("change_type IS NOT NULL").select(*keep, "path", "old_value", "new_value", "old_type", "new_type", "change_type")


def top_changes(base: DataFrame, other: DataFrame, within: str | None = None) -> DataFrame:
    """Changes between two texts by top-level key: added, removed, changed or same; of a repeated key the last counts.
    ``within``: compare the keys inside this top-level block instead, where a repeated key counts as a whole. Entries
    are equal when all that they hold is, in the same order, whatever their place in the text.

    Returns name, change_type, old_line, new_line.
    """
    level = 0 if within is None else 1

    def side(tree: DataFrame, s: str) -> DataFrame:
        own = tree.where((F.col("depth") >= level) & (F.col("node_type") != "error"))
        if within is not None:
            own = own.where(F.get("ancestors", F.lit(0)) == within)
        is_head = F.col("depth") == level
        place = F.when(is_head, 0).otherwise(F.col("pos"))
        rows = own.select(
            F.when(is_head, F.col("key")).otherwise(F.get("ancestors", F.lit(level))).alias("name"), F.when(is_head, F.col("node_id")).alias("head"),
            (F.col("top_id") if within is None else F.lit(0)).alias("entry"), F.when(is_head, F.col("line")).alias("line"),
            F.xxhash64("node_type", "depth", "key", "op", "value", "ancestors", place).cast("decimal(38,0)").alias("h"),
        )
        entries = rows.where("name IS NOT NULL").groupBy("name", "entry").agg(F.max("head").alias("head"), F.min("line").alias("line"), F.sum("h").alias("h"), F.count("*").alias("n"))
        last = entries.groupBy("name").agg(F.max(F.struct("head", "h", "n", "line")).alias("w"))
        return last.select("name", F.struct("w.h", "w.n").alias(f"{s}_text"), F.col("w.line").alias(f"{s}_line"))

    both = side(base, "old").join(side(other, "new"), "name", "full_outer")
    change = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").when(F.col("old_text") == F.col("new_text"), "same").otherwise("changed")
    return both.select("name", change.alias("change_type"), "old_line", "new_line")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each row of (key, nodes with their lines): a block's values, assignments by key, blocks in their order."""
    for b in batches:
        texts = []
        for row in b.column(1):
            inside: dict[int, list] = {}
            for n in row.as_py():
                inside.setdefault(n["parent_id"], []).append((n["kind"], n["by"], n["node_id"], n["line"], n["last"]))
            todo: list = sorted(inside.get(0, ()), reverse=True)
            lines = []
            while todo:
                n = todo.pop()
                if isinstance(n, str):
                    lines.append(n)
                    continue
                if n[3] is not None:
                    lines.append(n[3])
                if n[4] is not None:
                    todo.append(n[4])
                    todo += sorted(inside.get(n[2], ()), reverse=True)
            texts.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[b.schema.names[0], "text"])


def printed(tree: DataFrame, key: str = "digest", indent: str = "\t", sort_keys: bool = False, blank_lines: bool = False) -> DataFrame:
    """Script text of each content, one line a node, indented by depth. A content is one file, so its lines fit a row.

    ``sort_keys``: inside a block its values come first, then its assignments by key, then its blocks in their order.
    ``blank_lines``: one between top-level entries.
    """
    quoted = F.when(F.col("value_type") == "string", F.concat(F.lit('"'), F.col("value"), F.lit('"'))).otherwise(F.col("value"))
    head: Column = F.when(F.col("node_type") == "assignment", F.concat_ws(" ", "key", "op", quoted)).when(F.col("node_type") == "value", quoted)
    opener = F.concat(F.when(F.col("key").isNotNull(), F.concat_ws(" ", "key", F.coalesce("op", F.lit("=")), F.lit(""))).otherwise(F.lit("")), F.lit("{"))
    tabs = F.repeat(F.lit(indent), F.col("depth"))
    rows = tree.where("depth >= 0 AND node_type <> 'error'")
    is_block = F.col("node_type").isin("block", "list")
    gap = F.lit("\n") if blank_lines else F.lit("")
    lead = F.when((F.col("depth") == 0) & (F.col("pos") > 0), gap).otherwise(F.lit(""))
    if sort_keys:
        # Every node's own line goes to its content's row once, and the row is laid out from there: no join for each level.
        # Top-level entries stay in their order.
        is_value, is_set = (F.col("depth") > 0) & (F.col("node_type") == "value"), (F.col("depth") > 0) & (F.col("node_type") == "assignment")
        rank = F.when(is_value, 0).when(is_set, 1).otherwise(2).alias("kind"), F.when(is_set, F.col("key")).otherwise("").alias("by")
        own = F.concat(lead, tabs, F.when(is_block, opener).otherwise(head)).alias("line")
        held = rows.select(key, F.struct("node_id", "parent_id", *rank, own, F.when(is_block, F.concat(tabs, F.lit("}"))).alias("last")).alias("n"))
        kind_of_key = tree.schema[key].dataType.simpleString()
        return held.groupBy(key).agg(F.collect_list("n").alias("n")).mapInArrow(_laid_out, f"{key} {kind_of_key}, text string")
    at, closing = F.struct(F.col("start_off").alias("at"), F.col("node_id").alias("i")), F.struct(F.col("end_off").alias("at"), (-F.col("node_id")).alias("i"))
    line = lambda place, text: F.struct(place.alias("at"), text.alias("s"))
    both = F.array(line(at, F.concat(lead, tabs, opener)), line(closing, F.concat(tabs, F.lit("}"))))
    lines = rows.select(key, F.explode(F.when(is_block, both).otherwise(F.array(line(at, F.concat(lead, tabs, head))))).alias("l"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["s"]), "\n").alias("text"))


def diagnostics(tree: DataFrame, key: str = "digest", most: int = 100) -> DataFrame:
    """Faults of each text in order, at most ``most`` of a text as the report's length: key, line, start_off, error."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy("line", "start_off", "node_id"))
    return tree.where("error IS NOT NULL").withColumn("__i", place).where(F.col("__i") <= most).select(key, "line", "start_off", "error")


def as_json(tree: DataFrame, key: str = "digest") -> DataFrame:
    """The node table of each content as one JSON text, nodes in order; ``from_json`` reads it back."""
    columns = ["node_id", "parent_id", "depth", "pos", "node_type", "key", "op", "value", "value_type", "line", "start_off", "end_off", "path", "error", "top_id", "ancestors"]
    return tree.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("json"))


def from_json(rows: DataFrame, key: str = "digest") -> DataFrame:
    """Node tables from the JSON texts of ``as_json``."""
    return rows.select(key, F.inline(F.from_json("json", f"array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in NODE.split(', '))}>>")))


__all__ = ["CONTEXTS", "NODE", "REFERENCES", "SCRIPTS", "SLOTS", "as_json", "diagnostics", "diff", "from_json", "nodes", "nodes_of", "printed", "references", "slots", "symbols", "top_changes"]
