"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

Defined cases: null role, text and turn: an empty role, an empty text, before all other turns. Turns with the same number
are ordered by role, then text; equal rows all stay. A null conversation id is a conversation of its own. The template's marks
inside roles and texts are escaped and read back unchanged, whatever the marks are. A conversation that the machine doesn't accept is formatted
all the same, with ``valid`` false. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles under loss, and the roles that may follow a role ('' is the start)."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


CHATML = Template()


@dataclass(frozen=True)
class Escapes:
    """How a field is written so that no mark of the template begins in it, or runs into it.

    A backslash is doubled; one comes between the first two characters of a mark; a mark of a single character is a backslash
    and that mark's letter. Where a mark could begin in what stands before the field, or with the field's last character,
    a backslash and the letter ``nothing`` stand between.
    """

    heads: tuple[str, ...]
    letters: dict[str, str]
    nothing: str
    first: tuple[str, ...]
    last: tuple[str, ...]


def escapes_of(template: Template, role: bool = False) -> Escapes:
    """The escapes of the template's roles or texts."""
    if not (template.start and template.after_role and template.end) or "\\" in template.start + template.after_role + template.end:
        raise ValueError("a template's marks are not empty and have no backslash")
    if template.start in template.after_role or (template.end + template.start).find(template.start) < len(template.end):
        raise ValueError("a turn's start is not part of the other marks")
    marks = dict.fromkeys((template.start, template.end, template.after_role) if role else (template.start, template.end))
    before, behind = (template.start, template.after_role) if role else (template.after_role, template.end)
    heads = tuple(dict.fromkeys(m[:2] for m in marks if len(m) > 1))
    taken = {c for m in marks for c in m[:2]}
    free = (c for c in "nz0123456789" if c not in taken)
    letters = {m: next(free) for m in marks if len(m) == 1}
    goes_on = dict.fromkeys(m[k] for m in marks for k in range(1, len(m)) if before.endswith(m[:k]))
    return Escapes(
        heads, letters, next(free),
        (*goes_on, "") if behind[0] in goes_on else tuple(goes_on),
        tuple(dict.fromkeys(m[0] for m in marks if len(m) > 1 and (m[0] + behind).startswith(m[:2]))),
    )


def escape(text: Column, escapes: Escapes = escapes_of(CHATML)) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, letter in escapes.letters.items():
        text = F.replace(text, F.lit(mark), F.lit("\\" + letter))
    if escapes.heads:
        text = F.regexp_replace(text, "|".join(f"(?<={re.escape(h[0])})(?={re.escape(h[1])})" for h in escapes.heads), "\\\\")
    if escapes.last:
        text = F.when(F.right(text, F.lit(1)).isin(*escapes.last), F.concat(text, F.lit("\\" + escapes.nothing))).otherwise(text)
    if escapes.first:
        text = F.when(F.left(text, F.lit(1)).isin(*escapes.first), F.concat(F.lit("\\" + escapes.nothing), text)).otherwise(text)
    return text


def unescape(text: Column, escapes: Escapes = escapes_of(CHATML)) -> Column:
    def plain(piece: Column) -> Column:
        for mark, letter in {**escapes.letters, "": escapes.nothing}.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(mark))
        return F.replace(piece, F.lit("\\"), F.lit(""))

    # a run of backslashes is doubled ones and then, perhaps, one that escapes
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, valid, segments array<struct<text, loss>>, formatted: one row for each conversation of ``turns``."""
    empty = F.lit("")
    rows = turns.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("t")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, after in template.follows.items() for b in after])
    machine = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("state"), F.lit(True).alias("ok")),
        lambda s, t: F.struct(t["role"].alias("state"), (s["ok"] & F.array_contains(moves, F.concat_ws("\n", s["state"], t["role"]))).alias("ok")),
        lambda s: s["ok"],
    )

    of_role, of_text = escapes_of(template, role=True), escapes_of(template)

    def segments(t: Column) -> Column:
        mark = F.concat(F.lit(template.start), escape(t["role"], of_role), F.lit(template.after_role))
        off = F.lit(False).alias("loss")
        return F.array(
            F.struct(mark.alias("text"), off),
            F.struct(escape(t["text"], of_text).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), off),
        )

    formatted = ordered.select("conv_id", machine.alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    after = re.escape(template.after_role)
    of_role, of_text = escapes_of(template, role=True), escapes_of(template)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(template.end))
        role = F.split(body, after, 2)
        return F.struct(unescape(role[0], of_role).alias("role"), unescape(F.coalesce(F.get(role, F.lit(1)), F.lit("")), of_text).alias("text"))

    pieces = F.split(formatted, re.escape(template.start))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    of_text = escapes_of(template)
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], of_text)), "")
