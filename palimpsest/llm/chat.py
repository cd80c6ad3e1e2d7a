"""Chat formatting by prefix-target expansion: one training example for every assistant turn.

The template writes a turn as ``### Role: text</turn>`` and a line feed. ``\\``, ``###`` and ``</turn>`` inside a text
get a backslash before them, so a reader that skips escaped characters finds the turns again, and unescaping gives
the text back byte for byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed names of the usual roles in the template; another role is written as ``Role(name)``.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
CONTROL = re.compile(r"\\|###|</turn>")
END = "</turn>\n"
_HEAD = re.compile(r"### (?:(System|User|Assistant)|Role\(((?:[^\\)]|\\.)*)\)): ", re.S)
_BODY = re.compile(r"(?:[^\\<]|\\.|<(?!/turn>))*", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def header(role: str) -> str:
    name = NAMES.get(role)
    return f"### {name}: " if name else f"### Role({escape(role).replace(')', chr(92) + ')')}): "


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted example: role, text, and the span of its escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = _BODY.match(formatted, head.end()) if head else None
        if not body or not formatted.startswith(END, body.end()):
            raise ValueError(f"no turn at {at}")
        turns.append((ROLES[head[1]] if head[1] else unescape(head[2]), unescape(body[0]), *body.span()))
        at = body.end() + len(END)
    return turns


def _escaped(column):
    return F.regexp_replace(column, r"\\|###|</turn>", r"\\$0")


def format_chat(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for every assistant turn, with all turns before it as context and only its own text trainable.

    Returns conv_id, target (number of the turn, from 0, in the conversation), context (formatted turns before it),
    reply (formatted target turn), loss_start and loss_end (span of the trainable text within context + reply, by code
    points). A conversation whose last turns are not an assistant's has one more row with those turns as context, an
    empty reply and an empty span, so that no turn is lost. The formatted example is context followed by reply.

    Turns are ordered by turn (null first), then role and text; equal rows stay separate turns. Null text or role
    counts as empty; null conv_id is a conversation of its own; an empty table gives no rows; other columns are left
    behind. Contexts grow with the square of a conversation's length, as the format asks; they are cut from the
    conversation's one formatted text, so no turns are joined to turns.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    name = F.col("role")
    known = F.when(name == "system", "System").when(name == "user", "User").when(name == "assistant", "Assistant")
    head = F.concat(F.lit("### "), F.coalesce(known, F.concat(F.lit("Role("), F.replace(_escaped(name), F.lit(")"), F.lit("\\)")), F.lit(")"))), F.lit(": "))
    piece = rows.select("conv_id", "turn", "role", "text", head.alias("head"), _escaped(F.col("text")).alias("body"))
    turn = F.struct("turn", "role", "text", F.length("head").alias("h"), F.length("body").alias("b"), F.concat("head", "body", F.lit(END)).alias("line"))
    # Sorted by turn, role and text; the struct's further fields depend on those.
    talk = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        "conv_id", F.array_join(F.col("t.line"), "").alias("whole"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["h"].alias("h"), x["b"].alias("b"))).alias("t")
    )
    ends = F.aggregate("t", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["h"] + x["b"] + F.lit(len(END)))))
    talk = talk.withColumn("ends", ends)
    numbers = F.sequence(F.lit(0), F.size("t") - 1)
    wanted = F.filter(numbers, lambda i: (F.get("t", i)["role"] == "assistant") | (i == F.size("t") - 1))
    each = talk.select("conv_id", "t", "whole", "ends", F.explode(wanted).alias("target"))
    lo, hi, at = F.get("ends", F.col("target")), F.get("ends", F.col("target") + 1), F.get("t", F.col("target"))
    trains = at["role"] == "assistant"
    start = F.when(trains, lo + at["h"]).otherwise(hi)
    return each.select(
        "conv_id",
        "target",
        F.substring("whole", F.lit(1), F.when(trains, lo).otherwise(hi)).alias("context"),
        F.when(trains, F.substring("whole", lo + 1, hi - lo)).otherwise("").alias("reply"),
        start.alias("loss_start"),
        F.when(trains, start + at["b"]).otherwise(hi).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation from its formatted examples alone.

    An example with the most turns holds the whole conversation; the replies, in order of target, hold the trainable
    texts. Null ids are one conversation; a conversation without a trainable turn has loss_chars 0 and the digest of
    nothing; equal examples must not repeat; an empty table gives none; other columns stay behind.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    last = F.max("target").over(Window.partitionBy("conv_id"))
    slim = examples.select(
        "conv_id",
        "target",
        F.when(F.col("target") == last, F.concat("context", "reply")).alias("whole"),
        F.concat("context", "reply").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")).alias("loss"),
        (F.length("context") + F.length("reply")).cast("long").alias("chars"),
    )
    talks = slim.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("target", "loss")))["loss"].alias("losses"), F.sum("chars").alias("formatted_chars")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for whole, losses in zip(b["whole"], b["losses"]):
                turns = parse(whole)
                text, loss = "".join(f"{r}\n{t}\n" for r, t, *_ in turns), "".join(map(unescape, losses))
                out.append((len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])
            made.insert(0, "conv_id", b["conv_id"].values)
            yield made.assign(formatted_chars=b["formatted_chars"].values)

    kind = examples.schema["conv_id"].dataType.simpleString()
    return talks.mapInPandas(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
