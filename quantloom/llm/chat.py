"""Chat formatting (operator 7), DataFrame functions only.

A declarative template says what opens and closes a turn of each role and which roles' texts bear loss. A finite-state machine
over roles checks the order of turns. Every conversation becomes a list of segments, ``(text, loss)``, whose texts side
by side are the formatted conversation.

Control strings inside texts are escaped: a backslash is put after their first character, and another one if
backslashes stand there already. So no text holds a control string, and taking one backslash away again gives the text
back exactly. Only the first character of a control string is a bracket, so none can arise where text and marks meet.

Cases: a null text is the empty text, a null role the empty role. Roles that the template doesn't know are written with their
name and bear no loss. Turns go by ``turn`` (nulls first), then role, then text; repeated rows are turns of their
own. Rows with a null ``conv_id`` are one conversation. Order faults are told in ``valid`` and ``fault_turn``; nothing is
dropped. An empty table gives an empty result. Other columns are ignored. A conversation is one row of the result, so it is
gathered in one task, and conversations are as many as there are ``conv_id``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Opening and closing marks by role, the roles with loss and the machine's arcs by state and role.

    Marks begin with ``<`` or ``[``, and hold neither further on.
    """

    marks: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    named: tuple[str, str, str, str] = ("[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]")
    loss: tuple[str, ...] = ("assistant",)
    arcs: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "instructed"), ("start", "user", "asked"), ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [*(x for m in self.marks for x in m[1:]), *self.named]


TEMPLATE = Template()


def _rest(t: Template) -> str:
    """Pattern of what follows the first character of a control string."""
    return "|".join(re.escape(x[1:]) for x in sorted(t.controls, key=len, reverse=True))


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_rest(t)})", r"$1\\$2$3")


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_rest(t)})", "$1$2$3")


def _by_role(role: Column, t: Template, which: int, other: Column) -> Column:
    found = other
    for m in t.marks:
        found = F.when(role == m[0], F.lit(m[which])).otherwise(found)
    return found


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<turn, role, text>>`` in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, valid, fault_turn``; ``fault_turn`` is the first turn out of order, from 0."""

    def segments(x: Column) -> Column:
        opened = _by_role(x["role"], t, 1, F.concat(F.lit(t.named[0]), escape(x["role"], t), F.lit(t.named[1] + t.named[2])))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(opened, F.lit(False)),
            segment(escape(x["text"], t), x["role"].isin(*t.loss)),
            segment(_by_role(x["role"], t, 2, F.lit(t.named[3])), F.lit(False)),
        )

    arcs = F.create_map(*(F.lit(x) for a, role, b in t.arcs for x in (f"{a} {role}", b)))
    step = lambda s, x: F.struct(
        F.coalesce(F.try_element_at(arcs, F.concat_ws(" ", s["state"], x["role"])), F.lit("fault")).alias("state"),
        F.when(s["state"] == "fault", s["right"]).when(F.try_element_at(arcs, F.concat_ws(" ", s["state"], x["role"])).isNull(), s["right"]).otherwise(s["right"] + 1).alias("right"),
    )
    ran = F.aggregate("turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("right")), step)
    found = conversations(rows).select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), ran.alias("ran"))
    return found.select("conv_id", "segments", F.col("ran.state").isin(*t.final).alias("valid"), F.when(F.col("ran.state") == "fault", F.col("ran.right")).alias("fault_turn"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def loss_text(segments: Column, t: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"], t)), "")


def read_turns(formatted: Column, t: Template = TEMPLATE) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation, from its text alone."""
    closing = "|".join(re.escape(x) for x in [*(m[2] for m in t.marks), t.named[3]])
    opened = lambda x: F.regexp_extract(x, rf"^(?s:{re.escape(t.named[0])}(.*?){re.escape(t.named[1] + t.named[2])})", 1)

    def turn(x: Column) -> Column:
        role = unescape(opened(x), t)
        at = F.char_length(opened(x)) + len(t.named[0] + t.named[1] + t.named[2])
        for m in t.marks:
            role = F.when(F.startswith(x, F.lit(m[1])), F.lit(m[0])).otherwise(role)
            at = F.when(F.startswith(x, F.lit(m[1])), F.lit(len(m[1]))).otherwise(at)
        return F.struct(role.alias("role"), unescape(F.substring(x, at + 1, F.char_length(x)), t).alias("text"))

    pieces = F.split(formatted, closing, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
