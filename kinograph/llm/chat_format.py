"""Chat formatting with DataFrame functions only: a finite-state machine over roles, a declarative
template, segments with loss flags, and the way back from formatted text to turns.

A control string never stands in an escaped text: the escape character goes first (``\\`` becomes
``\\0``), then each control string becomes ``\\`` and its own letter. No control string holds the
escape character or begins with what follows it, so none can form across a replacement, and undoing the letters before ``\\0``
gives back every text. A template whose control strings break this, or are more than there are letters, is an error.

Defined results: a null text or role counts as empty; a role without markers of its own is
written with the open template's markers and its (escaped) name; rows with a null turn come first;
repeated rows and ties in ``turn`` are all kept, ordered by turn, role, text; a null ``conv_id`` is
a conversation of its own; an empty table gives no rows; other columns are ignored. A conversation
is one training example and is built in one task, because its text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ESCAPE = "\\"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Markers by role, the roles whose text carries loss, and the machine of allowed role orders.

    ``moves`` maps a state to the roles it accepts and the state that each leads to; ``final``
    lists the states in which a conversation may end.
    """

    markers: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("<|role|>", "<|text|>", "<|end|>")
    loss: tuple = ("assistant",)
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple = ("answered",)

    def __post_init__(self):
        if len(self.controls) > len(LETTERS):
            raise ValueError(f"a template has {len(LETTERS)} control strings at most")
        if any(not c or ESCAPE in c or c[0] in LETTERS + "0" for c in self.controls):
            raise ValueError("a control string is not empty, holds no escape character and does not begin with a lower-case letter or 0")

    @property
    def controls(self) -> list[str]:
        return [*dict.fromkeys([s for pair in self.markers.values() for s in pair] + list(self.other))]


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` without any control string in it."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for letter, control in zip(LETTERS, template.controls, strict=False):
        text = F.replace(text, F.lit(control), F.lit(ESCAPE + letter))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    """The text that ``escape`` was given."""
    for letter, control in zip(LETTERS, template.controls, strict=False):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _by_role(role: Column, values: dict, other) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other) if out is not None else other


def validate(roles: Column, template: Template = DEFAULT) -> Column:
    """Whether the machine accepts the array of roles and ends in a final state."""
    def move(state: Column, role: Column) -> Column:
        out = F.lit("refused")
        for source, accepted in template.moves.items():
            for name, target in accepted.items():
                out = F.when((state == source) & (role == name), target).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), move).isin(*template.final)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted, loss_spans.

    ``segments`` is an array of (text, loss); their texts in order are ``formatted``. ``loss_spans`` says where in
    ``formatted`` those with loss stand, as an array of (begin, length) in characters.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ordered = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("turn"))
    grouped = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def segments(turn: Column) -> Column:
        role, said = turn["role"], escape(turn["text"], template)
        named = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
        opening = _by_role(role, {k: F.lit(v[0]) for k, v in template.markers.items()}, named)
        closing = _by_role(role, {k: F.lit(v[1]) for k, v in template.markers.items()}, F.lit(template.other[2]))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(said, role.isin(*template.loss)), part(closing, F.lit(False)))

    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        validate(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumns({"formatted": F.array_join(F.transform("segments", lambda s: s["text"]), ""), "loss_spans": _spans(F.col("segments"))})


def _spans(segments: Column) -> Column:
    """(begin, length) of the segments with loss."""
    none = F.array().cast("array<struct<begin:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, segment: Column) -> Column:
        size = F.length(segment["text"])
        own = F.array(F.struct(state["at"].alias("begin"), size.alias("length")))
        return F.struct((state["at"] + size).alias("at"), F.when(segment["loss"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, start, add, lambda state: state["spans"])


def masked(formatted: Column, spans: Column) -> Column:
    """The pieces of a formatted text that ``spans`` cover, still escaped."""
    return F.transform(spans, lambda s: F.substr(formatted, s["begin"] + 1, s["length"]))


def parse_formatted(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns, as an array of (role, text), that a formatted text was made of."""
    quoted = lambda s: "\\Q" + s + "\\E"
    openings = [v[0] for v in template.markers.values()] + [template.other[0]]
    pieces = F.filter(F.split(formatted, "(?=" + "|".join(map(quoted, openings)) + ")", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        opening, middle, closing = template.other
        role = unescape(F.substring_index(F.substr(piece, F.lit(len(opening) + 1)), middle, 1), template)
        text = F.substr(piece, F.position(F.lit(middle), piece) + len(middle))
        text = F.left(text, F.length(text) - len(closing))
        for name, (before, after) in template.markers.items():
            here = F.startswith(piece, F.lit(before))
            role = F.when(here, name).otherwise(role)
            text = F.when(here, F.substr(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)
