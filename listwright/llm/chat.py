"""Chat formatting: a finite-state machine over roles and a declarative template. Built-in functions only.

A template gives each role an opening and a closing control string and says whether its text is under the loss mask.
Control strings inside texts get a backslash after their first character, and those that already look so get one
more, so the text can be read back exactly and never closes or opens a turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """``turns`` by role; any other role is written out between ``other_open`` and ``other_name_end``.

    ``follows``: for each state, which roles may come next; a role is the state after it. ``finals``: states in which
    a conversation may end.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS]", "[/SYS]"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("[OUT]", "</s>", loss=True),
        }
    )
    other_open: str = "[ROLE]"
    other_name_end: str = "[TEXT]"
    other_close: str = "[/ROLE]"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    finals: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        named = [x for t in self.turns.values() for x in (t.open, t.close)]
        return [*dict.fromkeys([*named, self.other_open, self.other_name_end, self.other_close])]


def escape(text: Column, template: ChatTemplate) -> Column:
    for first, rest in _by_first(template):
        text = F.regexp_replace(text, f"({first})(\\\\*)({rest})", r"$1\\$2$3")
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    for first, rest in _by_first(template):
        text = F.regexp_replace(text, f"({first})\\\\(\\\\*)({rest})", "$1$2$3")
    return text


def _by_first(template: ChatTemplate) -> list[tuple[str, str]]:
    firsts: dict[str, list[str]] = {}
    for c in template.controls():
        firsts.setdefault(c[0], []).append(re.sub(r"([\[\]|()<>/\\.*+?^${}])", r"\\\1", c[1:]))
    return [(re.sub(r"([\[\]|()\\.*+?^${}])", r"\\\1", first), "|".join(rest)) for first, rest in firsts.items()]


def segments(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each row with ``lw_segments``: array of (text, loss), in order: opening, body, closing.

    Works row by row, so a conversation of any length is never gathered. A null text is empty, a null role the empty
    role; text under the loss mask is the body alone.
    """
    name = F.coalesce(role, F.lit(""))
    body = escape(F.coalesce(text, F.lit("")), template)
    segment = lambda value, loss: F.struct(value.alias("text"), F.lit(loss).alias("loss"))
    other_name = F.concat(F.lit(template.other_open), escape(name, template), F.lit(template.other_name_end))
    chosen = F.array(segment(other_name, False), segment(body, False), segment(F.lit(template.other_close), False))
    for r, t in template.turns.items():
        own = F.array(segment(F.lit(t.open), False), segment(body, t.loss), segment(F.lit(t.close), False))
        chosen = F.when(name == r, own).otherwise(chosen)
    return turns.withColumn("lw_segments", chosen)


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``lw_formatted``, ``lw_segments``, ``lw_valid`` (the state machine accepts
    its roles) and ``lw_bad_turn`` (how many turns it accepted before it failed, else null).

    Rows go by turn, then role, then text (null first); repeated rows are repeated turns. A null conversation id is a
    conversation. A conversation is one training example, so its text comes together in one row.
    """
    rows = segments(turns.select(F.col(conv).alias("lw_conv"), F.col(turn).alias("lw_turn"), F.col(role).alias("lw_role"), F.col(text).alias("lw_text")), template, "lw_conv", "lw_turn", "lw_role", "lw_text")
    gathered = rows.groupBy("lw_conv").agg(F.array_sort(F.collect_list(F.struct("lw_turn", "lw_role", "lw_text", "lw_segments"))).alias("lw_rows"))
    names = F.transform("lw_rows", lambda r: F.coalesce(r["lw_role"], F.lit("")))
    allowed = F.array(*[F.lit(f"{state}\n{nxt}") for state, to in template.follows.items() for nxt in to])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("done"), F.lit(True).alias("ok"))

    def step(acc, nxt):
        ok = acc["ok"] & F.array_contains(allowed, F.concat(acc["state"], F.lit("\n"), nxt))
        return F.struct(nxt.alias("state"), (acc["done"] + ok.cast("int")).alias("done"), ok.alias("ok"))

    run = F.aggregate(names, start, step)
    pieces = F.flatten(F.transform("lw_rows", lambda r: r["lw_segments"]))
    out = gathered.select(F.col("lw_conv").alias(conv), pieces.alias("lw_segments"), run.alias("lw_run"))
    ended = F.col("lw_run.ok") & F.col("lw_run.state").isin(*template.finals)
    return out.select(
        conv,
        F.array_join(F.transform("lw_segments", lambda s: s["text"]), "").alias("lw_formatted"),
        "lw_segments",
        ended.alias("lw_valid"),
        F.when(~F.col("lw_run.ok"), F.col("lw_run.done")).alias("lw_bad_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns of a formatted conversation as an array of (role, text, loss), unescaped."""
    quote = lambda s: re.sub(r"([\[\]|()\\.*+?^${}])", r"\\\1", s)
    opens = [quote(t.open) for t in template.turns.values()]
    closes = [quote(t.close) for t in template.turns.values()] + [quote(template.other_close)]
    named = f"{quote(template.other_open)}.*?{quote(template.other_name_end)}"
    pattern = f"(?s)(?:{'|'.join([*opens, named])}).*?(?:{'|'.join(closes)})"
    found = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def parse(piece):
        turn = lambda role, text, loss: F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))
        split = F.locate(template.other_name_end, piece)
        name = F.substring(piece, F.lit(len(template.other_open) + 1), split - 1 - len(template.other_open))
        at = split + len(template.other_name_end)
        body = F.substring(piece, at, F.length(piece) - at + 1 - len(template.other_close))
        out = turn(unescape(name, template), unescape(body, template), False)
        for r, t in template.turns.items():
            inner = F.substring(piece, F.lit(len(t.open) + 1), F.length(piece) - len(t.open) - len(t.close))
            out = F.when(F.startswith(piece, F.lit(t.open)), turn(F.lit(r), unescape(inner, template), t.loss)).otherwise(out)
        return out

    return F.transform(found, parse)
