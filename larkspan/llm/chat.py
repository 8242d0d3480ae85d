"""Operator 10, chat formatting: a role automaton validates turn order, a declarative template yields text segments with loss flags.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """roles: role -> (opening, closing, loss on the text). Any other role gets `other`, with its name inside the opening.

    moves: state -> roles that may follow; a state is the last role, "" the start; ends: states in which a conversation may end.
    Fixed values: the control strings below.
    """

    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>", True),
    })
    other: tuple = ("[ROLE] ", " [/ROLE] ", " [END]", False)
    control: tuple = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]")
    moves: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)

    @property
    def pattern(self) -> str:
        import re

        return "|".join(re.escape(c[1:]) for c in self.control)

    @property
    def turn(self) -> str:
        """A whole turn in formatted text: control strings inside texts are escaped, so the first closing ends it."""
        import re

        one = [rf"{re.escape(a)}.*?{re.escape(b)}" for a, b, _ in self.roles.values()]
        return "(?s)" + "|".join([*one, rf"{re.escape(self.other[0])}.*?{re.escape(self.other[2])}"])


def escaped(text: Column, t: Template) -> Column:
    """Backslashes are doubled, then one is put after the first code point of each control string. Reversible."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={t.pattern})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, t: Template, k: int, other: Column) -> Column:
    out = other
    for name, spec in t.roles.items():
        out = F.when(role == name, F.lit(spec[k])).otherwise(out)
    return out


def format_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (kind, text, loss), spans of loss (start from 1, length), n_turns, valid, bad_turn.

    Needs conv_id, turn, role, text; more columns are ignored. Rows are ordered by turn (null first), then role, then text, so ties and
    repeated rows have one order; repeated rows stay. Null texts and roles count as empty; a null conv_id is a conversation of its own.
    Wrong turn orders are formatted all the same: valid is false and bad_turn the first wrong position (n_turns + 1: it ends too early).
    An empty table gives an empty table. A conversation is one row, so its text is held by one task; no other group is.
    """
    t = template or Template()
    x = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(t.other[0]), escaped(F.col("role"), t), F.lit(t.other[1]))
    x = x.select(
        "conv_id", "turn", "role", "text",
        _by_role(F.col("role"), t, 0, head).alias("opening"),
        escaped(F.col("text"), t).alias("body"),
        _by_role(F.col("role"), t, 1, F.lit(t.other[2])).alias("closing"),
        _by_role(F.col("role"), t, 2, F.lit(t.other[3])).alias("loss"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.char_length("opening") + F.char_length("body") + F.char_length("closing")
    x = x.select(
        "*", F.row_number().over(here).alias("at"),
        (F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.char_length("opening") + 1).alias("start"),
    )
    turns = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "opening", "body", "closing", "loss", "start"))).alias("t"))
    moves = F.create_map(*[F.lit(y) for state, after in t.moves.items() for y in (state, F.array(*map(F.lit, after)))])
    bad = F.aggregate(
        "t",
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(0).alias("bad")),
        lambda s, y: F.struct(
            y["role"].alias("state"), (s["at"] + 1).alias("at"),
            F.when(s["bad"] > 0, s["bad"]).when(F.coalesce(F.array_contains(F.try_element_at(moves, s["state"]), y["role"]), F.lit(False)), 0).otherwise(s["at"] + 1).alias("bad"),
        ),
        lambda s: F.when(s["bad"] > 0, s["bad"]).when(s["state"].isin(*t.ends), 0).otherwise(s["at"] + 1),
    )
    segment = lambda kind, text, loss: F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda y: F.array(segment("mark", y["opening"], F.lit(False)), segment("text", y["body"], y["loss"]), segment("mark", y["closing"], F.lit(False)))))
    return turns.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), segments.alias("segments"),
        F.transform(F.filter("t", lambda y: y["loss"]), lambda y: F.struct(y["start"].alias("start"), F.char_length(y["body"]).alias("length"))).alias("spans"),
        bad.alias("bad_turn"),
    ).select("*", (F.col("bad_turn") == 0).alias("valid"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(df: DataFrame, template: Template | None = None) -> DataFrame:
    """From formatted and spans alone: conv_id, turns (role, text), learned (the unescaped texts under the loss mask)."""
    t = template or Template()
    between = lambda y, a, b: F.substring(y, F.lit(len(a) + 1), F.char_length(y) - len(a) - len(b))

    def turn(y: Column) -> Column:
        inner = between(y, t.other[0], t.other[2])
        cut = F.instr(inner, t.other[1])
        out = F.struct(unescaped(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(inner, cut + len(t.other[1]), F.char_length(inner))).alias("text"))
        for name, (a, b, _) in t.roles.items():
            out = F.when(y.startswith(a), F.struct(F.lit(name).alias("role"), unescaped(between(y, a, b)).alias("text"))).otherwise(out)
        return out

    found = F.regexp_extract_all("formatted", F.lit(t.turn), F.lit(0))
    return df.select(
        "conv_id", F.transform(found, turn).alias("turns"),
        F.array_join(F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "").alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )
