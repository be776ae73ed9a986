"""Chat formatting by a finite-state machine over roles (DataFrame operations only).

A declarative template names, for each role, what opens and closes its turn and whether its text is learned. Every turn
becomes segments, one row each: (conv_id, turn, part, segment, loss). A conversation is therefore never gathered to be formatted; its
formatted text is the segments in order. Texts are escaped so that none can hold a control string, and can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """roles: role -> (opening, closing, learned). order: role -> roles that may come before it; START for the first turn.

    No control string may hold the escape character, and each starts with a character and goes on with another."""

    roles: dict[str, tuple[str, str, bool]]
    order: dict[str, frozenset[str]]
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        strings = {s for opening, closing, _ in self.roles.values() for s in (opening, closing)}
        if any(len(s) < 2 or self.escape in s for s in strings):
            raise ValueError("control strings need two characters and must not hold the escape character")
        object.__setattr__(self, "controls", tuple(sorted(strings)))


START = ""

INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)},
    order={
        "system": frozenset({START}),
        "user": frozenset({START, "system", "assistant"}),
        "assistant": frozenset({"user"}),
    },
)


def escaped(text: Column, template: Template) -> Column:
    """The escape character doubled, then put behind the first character of every control string."""
    e = template.escape
    out = F.replace(text, F.lit(e), F.lit(e + e))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + e + c[1:]))
    return out


def unescaped(text: Column, template: Template) -> Column:
    """The inverse of escaped: a single escape character follows no other and stands inside a control string."""
    e, out = template.escape, text
    for c in reversed(template.controls):
        out = F.replace(out, F.lit(c[0] + e + c[1:]), F.lit(c))
    return F.replace(out, F.lit(e + e), F.lit(e))


def _pick(role: Column, template: Template, i: int, other) -> Column:
    out = F.lit(other)
    for name, spec in template.roles.items():
        out = F.when(role == name, F.lit(spec[i])).otherwise(out)
    return out


def validate(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conversations with `fault`: null where the machine accepts the turn, else why not: "role" (unknown or null), "order" (not
    allowed after the turn before it), "turn" (a null or repeated turn number).

    One pass over each conversation in order of turn, with a lookback of one row. Columns named fault are replaced."""
    base = conversations.drop("fault")
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role", 1, START).over(by)
    last = F.lag("turn", 1).over(by)
    allowed = F.lit(False)
    for role, previous in template.order.items():
        allowed = allowed | ((F.col("role") == role) & before.isin(*sorted(previous)))
    fault = (
        F.when(F.col("role").isNull() | ~F.col("role").isin(*template.roles), "role")
        .when(F.col("turn").isNull() | (last == F.col("turn")), "turn")
        .when(~F.coalesce(allowed, F.lit(False)), "order")
    )
    return base.withColumn("fault", fault)


#: Roles without a place in the template are written between these; the role, in base 64 ("-" for null), ends the opening.
OTHER = ("<|role|>", "<|end|>")


def _strings(template: Template) -> Template:
    return Template(template.roles | {OTHER[0]: (*OTHER, False)}, template.order, template.escape)


def segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, seq, segment, loss, fault): three segments a turn, its opening, the escaped text and the closing.

    Turns stand in order of turn, those of one number by role and text; seq counts the segments of a conversation from 0.
    loss is true for the text of learned roles only. fault is validate()'s, of the turn. A null text is an empty segment. Roles that the
    template does not know, and null, are marked by OTHER. A null turn sorts first, a null conv_id is a conversation of its own.
    Repeated rows are formatted each. Other columns are not read. An empty table gives no rows.
    """
    every = _strings(template)
    known = F.coalesce(F.col("role").isin(*template.roles), F.lit(False))
    name = F.coalesce(F.base64(F.col("role").cast("binary")), F.lit("-"))
    opening = F.when(known, _pick(F.col("role"), template, 0, "")).otherwise(F.concat(F.lit(OTHER[0]), name))
    closing = F.when(known, _pick(F.col("role"), template, 1, "")).otherwise(F.lit(OTHER[1]))
    loss = F.coalesce(_pick(F.col("role"), template, 2, False), F.lit(False))
    text = escaped(F.coalesce("text", F.lit("")), every)
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = validate(conversations.select("conv_id", "turn", "role", "text"), template).withColumn("at", 3 * (F.row_number().over(by) - 1))
    parts = F.array(
        F.struct(F.col("at").alias("seq"), opening.alias("segment"), F.lit(False).alias("loss")),
        F.struct((F.col("at") + 1).alias("seq"), text.alias("segment"), loss.alias("loss")),
        F.struct((F.col("at") + 2).alias("seq"), closing.alias("segment"), F.lit(False).alias("loss")),
    )
    return turns.select("conv_id", F.explode(parts).alias("p"), "fault").select("conv_id", "p.*", "fault")


def read_segment(segment: Column, template: Template = INSTRUCT) -> tuple[Column, Column]:
    """What a segment says by its content alone: the role, if it opens a turn; the text, if it is no control string."""
    every = _strings(template)
    role = F.lit(None).cast("string")
    for name, (opening, _, _) in template.roles.items():
        role = F.when(segment == opening, F.lit(name)).otherwise(role)
    other = F.substring(segment, len(OTHER[0]) + 1, 1 << 30)
    named = F.when(other == "-", F.lit("")).otherwise(F.unbase64(other).cast("string"))
    role = F.when(segment.startswith(F.lit(OTHER[0])), named).otherwise(role)
    ends = segment.isin(*[closing for _, closing, _ in every.roles.values()])
    return role, F.when(role.isNull() & ~ends, unescaped(segment, every))


def read_back(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turns, learned, n_turns, loss_chars, formatted_chars, valid), from segments: turns is role, line end, text, line
    end of each turn, learned the texts under the loss mask, both in order. Null roles read as empty ones.

    A conversation's turns have to fit a row; they are gathered once, in the partitions that the segments already have."""
    role, text = read_segment(F.col("segment"), template)
    line = F.concat(F.coalesce(role, text), F.lit("\n"))
    piece = F.struct("seq", line.alias("line"), F.when(F.col("loss"), text).alias("learned"))
    one = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(piece)).alias("x"),
        F.sum(F.when(role.isNotNull(), 1).otherwise(0)).alias("n_turns"),
        F.sum(F.when(F.col("loss"), F.length(text)).otherwise(0)).cast("bigint").alias("loss_chars"),
        F.sum(F.length("segment")).cast("bigint").alias("formatted_chars"),
        F.count("fault").alias("faults"),
    )
    join = lambda name: F.array_join(F.transform("x", lambda y: y[name]), "")  # noqa: E731  nulls are left out
    return one.select(
        "conv_id", join("line").alias("turns"), join("learned").alias("learned"), "n_turns", "loss_chars", "formatted_chars", (F.col("faults") == 0).alias("valid")
    )
