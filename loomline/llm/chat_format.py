"""Chat formatting, in DataFrame expressions only.

A declarative template names the control strings, the roles whose text carries loss, and a finite-state machine
over roles. Each conversation becomes an array of segments ``(text, loss, turn)``; joined they are the formatted
conversation. Control strings inside texts and roles are escaped reversibly: a backslash is doubled and ``<|``
becomes ``<\\|`` (in roles a line feed also becomes ``\\n``), so after escaping no control string can occur.

Defined results: a null text or role is empty; turns sort by turn, then role, then text (nulls first), and
repeated rows stay; a conversation whose roles break the machine is still formatted, with ``valid`` false and
the index of its first bad turn in ``first_bad``; rows with a null conv_id form one conversation, so a table should
have few of them; very long texts and conversations are formatted whole, each conversation in one row; other columns
are ignored, whatever their names; an empty table gives no conversations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state. A conversation begins in "begin" and may end in one of final.
    machine: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "told",
            ("begin", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("asked", "tool"): "asked",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    halves = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(halves, "\\")


def _machine(turns: Column, template: Template) -> Column:
    """struct(state, bad): the last state and the index of the first turn that has no transition (null: none)."""
    moves = F.create_map(*(F.lit(x) for (s, r), to in template.machine.items() for x in (f"{s}\n{r}", to)))
    start = F.struct(F.lit("begin").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.when(turn["role"].isin(*template.loss_roles), "answered").otherwise("asked")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"),
        )

    return F.aggregate(turns, start, step)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments array<struct<text, loss, turn>>, formatted, valid, first_bad."""
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segment(text: Column, loss: Column, i: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"), i.alias("turn"))

    def segments(x: Column, i: Column) -> Column:
        none = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(t.start), escape_role(x["role"]), F.lit(t.after_role)), none, i),
            segment(escape(x["text"]), x["role"].isin(*t.loss_roles), i),
            segment(F.lit(t.end + t.after_end), none, i),
        )

    out = grouped.withColumn("segments", F.flatten(F.transform("turns", segments))).withColumn("end", _machine(F.col("turns"), t))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments")["text"], "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*t.final)).alias("valid"),
        F.coalesce("end.bad", F.when(~F.col("end.state").isin(*t.final), F.size("turns") - 1)).alias("first_bad"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns array<struct<role, text>> parsed from ``formatted``, loss_text from the segments' flags."""
    t = template or Template()
    tail = len(t.end + t.after_end)

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, t.after_role, 1)
        text = F.substring(x, F.length(role) + len(t.after_role) + 1, F.length(x) - F.length(role) - len(t.after_role) - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    parts = F.split("formatted", "\\Q" + t.start + "\\E", -1)
    return formatted.withColumn("turns", F.transform(F.slice(parts, 2, F.size(parts)), parsed)).withColumn(
        "loss_text", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    )


def digests(rows: DataFrame, template: Template | None = None) -> DataFrame:
    back = read_back(format_conversations(rows, template), template)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad",
    )
