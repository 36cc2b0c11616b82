"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template gives the marks and the role whose texts are under the loss mask. Inside a role or a text every
backslash is doubled and a backslash goes between the first two characters of every mark, so no mark can occur there (with
the default marks ``<|`` becomes ``<\\|``) and one regular expression takes the escapes back. Marks that could arise across the border of a mark and a text are refused: a mark has two characters
at least and no backslash, begins no other, and holds the first character of any mark only at its start.

Defined cases: a null text or role counts as empty; null turns come first; rows with the same turn are ordered
by role, then text; repeated rows stay; a role that the machine has no move for sets ``valid`` to false and the
conversation is formatted all the same; an empty table gives an empty result; further columns are ignored.
A conversation's formatted text must fit one string (2 GB), and so must the turns of one BLOCK of turn numbers (rows
that repeat a turn are of its block, null turns are one block); long conversations are put together from these blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64

#: (state, role) -> next state; the start state is the empty string.
TURN_ORDER = {
    ("", "system"): "system",
    ("", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}


@dataclass(frozen=True)
class ChatTemplate:
    before_role: str = "<|im_start|>"
    before_text: str = "<|im_sep|>"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: dict(TURN_ORDER))

    def __post_init__(self) -> None:
        marks = self.marks()
        firsts = {m[:1] for m in marks}
        for mark in marks:
            if "\\" in mark or len(mark) < 2 or firsts & set(mark[1:]):
                raise ValueError(f"a mark needs two characters, no backslash, and the first of any mark only at its start: {mark!r}")
            if any(m != mark and m.startswith(mark) for m in marks):
                raise ValueError(f"a mark may not begin another: {mark!r}")

    def marks(self) -> tuple[str, str, str]:
        return self.before_role, self.before_text, self.after_text


def escaped(text: Column, template: ChatTemplate) -> Column:
    """``text`` without any mark of the template."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for lead in sorted({mark[:2] for mark in template.marks()}):
        out = F.regexp_replace(out, f"{_quoted(lead[0])}(?={_quoted(lead[1])})", "$0\\\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: DataFrame, template: ChatTemplate) -> DataFrame:
    """One row per turn: conv_id, turn, role, text (nulls as empty) and its segments array<struct<text, loss>>."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "segments",
        F.array(
            F.struct(F.concat(F.lit(template.before_role), escaped(F.col("role"), template), F.lit(template.before_text)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(F.col("text"), template).alias("text"), F.col("role").isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.after_text).alias("text"), F.lit(False).alias("loss")),
        ),
    )


def _moves(template: ChatTemplate) -> Column:
    pairs = [F.lit(x) for (state, role), after in template.moves.items() for x in (f"{state}>{role}", after)]
    return F.create_map(*pairs)


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss), valid, end_state.

    ``turns`` has conv_id, turn, role, text. ``valid`` says that the roles are a path of the machine.
    """
    template = template or ChatTemplate()
    rows = segments(turns, template).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("rows"))
        .select(
            "conv_id",
            "block",
            F.transform("rows", lambda r: r["role"]).alias("roles"),
            F.flatten(F.transform("rows", lambda r: r["segments"])).alias("segments"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "roles", "segments"))).alias("blocks"))
    start = F.struct(F.lit("").alias("state"), F.lit(True).alias("valid"))
    moves = _moves(template)

    def step(at: Column, role: Column) -> Column:
        after = F.try_element_at(moves, F.concat(at["state"], F.lit(">"), role))
        return F.struct(F.coalesce(after, role).alias("state"), (at["valid"] & after.isNotNull()).alias("valid"))

    return whole.select(
        "conv_id",
        F.flatten(F.transform("blocks", lambda b: b["segments"])).alias("segments"),
        F.aggregate(F.flatten(F.transform("blocks", lambda b: b["roles"])), start, step).alias("machine"),
    ).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("machine.valid").alias("valid"),
        F.col("machine.state").alias("end_state"),
    )


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Turns and loss texts as they stand in the output: conv_id, roles, texts, loss_text, formatted, valid."""
    template = template or ChatTemplate()
    parts = F.filter(F.split("formatted", _quoted(template.after_text), -1), lambda p: p != "")
    heads = F.transform(parts, lambda p: F.substring_index(p, template.before_text, 1))
    return formatted.select(
        "*",
        F.transform(heads, lambda h: unescaped(F.substring(h, len(template.before_role) + 1, 1 << 30))).alias("roles"),
        F.transform(parts, lambda p: unescaped(F.element_at(F.split(p, _quoted(template.before_text), 2), 2))).alias("texts"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("loss_text"),
    )


def _quoted(mark: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in mark)


def digests(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The digest columns of op7, all read back from the formatted output."""
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read_back(formatted, template).select(
        "conv_id",
        F.size("roles").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )
