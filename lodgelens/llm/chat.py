"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns, in order, run through the machine, which says whether the order of roles is allowed, and come
out as text segments with a loss flag each.  Only DataFrame functions are used.  A conversation is one row of the
result, so its turns meet in one task, as its text does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """What surrounds a turn of each role, which role may follow which, and where a conversation may end.

    Roles without marks of their own are written with their name between ``named`` marks.  ``control`` are the strings
    that no text may contain as they stand: an occurrence gets a backslash behind its first character (one more, if
    it has some), which reading back removes.
    """

    roles: dict[str, Marks]
    named: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    control: tuple[str, ...] = field(default=())

    def escape_pattern(self, backslashes: str) -> str:
        first = "".join(sorted({"\\" + c[0] for c in self.control}))
        rest = "|".join(re.escape(c[1:]) for c in sorted(self.control))
        return f"([{first}]){backslashes}({rest})"


INSTRUCT = Template(
    roles={
        "system": Marks("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks(" ", "</s>", loss=True),
    },
    named=("[ROLE]", "[TEXT]", "[/ROLE]"),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"),
)


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.escape_pattern(r"(\\*)"), "$1\\\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.escape_pattern(r"\\(\\*)"), "$1$2$3")


def _by_role(role: Column, template: Template, value, other: Column) -> Column:
    out = other
    for name, marks in template.roles.items():
        out = F.when(role == name, value(marks)).otherwise(out)
    return out


def format_conversations(
    turns: DataFrame, template: Template = INSTRUCT, key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """One row per conversation: ``key``, ``n_turns``, ``valid``, ``error_turn``, ``segments``, ``formatted``.

    ``segments`` is an array of (text, loss); ``formatted`` joins their texts.  ``error_turn`` is the position (from 0)
    of the first role that may not follow what stands before it, null if there is none; ``valid`` also asks that the
    last role is a final one.  Conversations out of order are formatted all the same.  Null texts and roles are empty;
    rows with a null key are one conversation; turns with equal order numbers go by role, then text; null order
    numbers come first.  Further columns are ignored, and an empty table gives no rows.  A conversation,
    with its marks, has to fit into one row (2 GB).
    """
    turn = F.struct(
        F.col(order).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    allowed = F.array(*[F.lit(f"{a} {b}") for a, after in template.follows.items() for b in after])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def step(was: Column, now: Column) -> Column:
        stays = F.array_contains(allowed, F.concat(was.state, F.lit(" "), now.role)) & was.error.isNull()
        return F.struct(
            now.role.alias("state"),
            (was.at + 1).alias("at"),
            F.when(stays, was.error).otherwise(F.coalesce(was.error, was.at)).alias("error"),
        )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head, middle, tail = template.named

    def segments(t: Column) -> Column:
        named = F.concat(F.lit(head), escape(t.role, template), F.lit(middle))
        never = F.lit(False)
        return F.array(
            segment(_by_role(t.role, template, lambda m: F.lit(m.open), named), never),
            segment(escape(t.text, template), _by_role(t.role, template, lambda m: F.lit(m.loss), never)),
            segment(_by_role(t.role, template, lambda m: F.lit(m.close), F.lit(tail)), never),
        )

    machine = grouped.select(
        key,
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", start, step).alias("end"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return machine.select(
        key,
        F.col("n_turns").cast("long").alias("n_turns"),
        (F.col("end.error").isNull() & F.col("end.state").isin(*template.final)).alias("valid"),
        F.col("end.error").alias("error_turn"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    q = re.escape
    head, middle, tail = template.named
    shapes = [f"{q(m.open)}.*?{q(m.close)}" for m in sorted(template.roles.values(), key=lambda m: -len(m.open))]
    shapes.append(f"{q(head)}.*?{q(middle)}.*?{q(tail)}")
    pieces = F.regexp_extract_all(formatted, F.lit(rf"(?s)\G(?:{'|'.join(shapes)})"), F.lit(0))

    def turn(piece: Column) -> Column:
        named = F.struct(
            unescape(F.regexp_extract(piece, rf"(?s)^{q(head)}(.*?){q(middle)}", 1), template).alias("role"),
            unescape(F.regexp_extract(piece, rf"(?s){q(middle)}(.*){q(tail)}$", 1), template).alias("text"),
        )
        out = named
        for name, m in template.roles.items():
            inside = F.substring(piece, F.lit(len(m.open) + 1), F.length(piece) - len(m.open) - len(m.close))
            mine = F.struct(F.lit(name).alias("role"), unescape(inside, template).alias("text"))
            out = F.when(F.startswith(piece, F.lit(m.open)), mine).otherwise(out)
        return out

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template)), "")
