"""Chat formatting by a finite-state machine over roles. DataFrame functions only.

A template (plain data) names the marks around a turn, the roles whose text
counts for the loss, and the role transitions that are in order. A conversation
becomes segments of (text, loss): head, body and tail of every turn. Control
strings inside roles and texts are escaped reversibly: a backslash is doubled,
``<|`` becomes ``<\\|``, and a newline in a role is preceded by a backslash; so
no text can close or open a turn.

Nulls and odd rows: null text is empty, null role is the empty role (never
trained on). Rows go by turn, null turns first; rows of equal turn go by role,
then text; repeated rows are turns of their own. Rows of null conversation id
are one conversation. Conversations out of order are formatted and marked
(``in_order`` false). An empty table gives an empty result. A conversation is
one row of the result and must fit into one; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "<|im_start|>"
    after_role: str = "\n"
    tail: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> roles that may follow; a state is the last role.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def in_order(roles: Column, template: Template = CHATML) -> Column:
    """Whether the machine accepts the roles."""
    edges = [f"{a}\n{b}" for a, after in template.moves.items() for b in after]
    state = F.aggregate(roles, F.lit(template.start), lambda s, r: F.when(F.concat(s, F.lit("\n"), r).isin(edges), r).otherwise(F.lit("\n")))
    return state.isin(*template.final)


def format_chats(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv id, in_order, segments (text, loss) and formatted, their texts joined."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "__rows",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.head), escape_role(t["role"]), F.lit(template.after_role)).alias("text"), no.alias("loss")),
                F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
                F.struct(F.lit(template.tail).alias("text"), no.alias("loss")),
            ),
        )
    )
    d = d.select("conv_id", in_order(F.transform("__rows", lambda t: t["role"]), template).alias("in_order"), segments.alias("segments"))
    return d.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns, as structs of role and text, out of a formatted conversation."""
    turns = F.split(formatted, "\\Q" + template.tail + "\\E", -1)
    role = r"(?s)^((?:[^\\\n]|\\.)*)\n"

    def turn(x: Column) -> Column:
        x = F.substring(x, len(template.head) + 1, 2**31 - 1)
        raw = F.regexp_extract(x, role, 1)
        return F.struct(unescape(raw).alias("role"), unescape(F.substr(x, F.length(raw) + F.lit(len(template.after_role) + 1))).alias("text"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), turn)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
