"""Chat formatting with relational expressions only.

The turns of a conversation are collected as structs, sorted, and written as

    <|im_start|>role NEWLINE text <|im_turn|> text ... <|im_end|> NEWLINE

where adjacent turns of one role share a block and ``<|im_turn|>`` parts their texts. A
control string inside a text or role is escaped: ``<`` and ``|`` with n backslashes
between get one backslash more, so no escaped text holds ``<|`` and reading back takes
one away again.

Defined results: a null text or role is empty. Turns sort by turn (nulls first), then
role, then text, so ties and repeated rows have one order, and repeated rows stay turns of their own. A null
conversation id is a conversation. Further columns don't matter. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", "<$1|")


def escape_role(x: Column) -> Column:
    """A role is one line, so its line ends are written as %0A."""
    return escape(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(x: Column) -> Column:
    return F.replace(F.replace(unescape(x), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv``, formatted, and segments (text, loss), which joined give formatted."""
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    held = turns.select(F.col(f"`{conv}`").alias("conv"), row.alias("row")).groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    kind = held.schema["rows"].dataType.elementType.simpleString()
    nothing = F.array(F.lit(None).cast(kind))
    rows = F.col("rows")
    before = F.concat(nothing, F.slice(rows, 1, F.size(rows) - 1))
    after = F.concat(F.slice(rows, 2, F.size(rows)), nothing)

    def piece(x: Column, loss: Column) -> Column:
        return F.struct(x.alias("text"), loss.alias("loss"))

    def segments(x: Column, near: Column) -> Column:
        new, last = ~x.role.eqNullSafe(near.b.role), ~x.role.eqNullSafe(near.a.role)
        head = F.when(new, F.concat(F.lit(START), escape_role(x.role), F.lit("\n"))).otherwise(F.lit(TURN))
        return F.array(piece(head, F.lit(False)), piece(escape(x.text), x.role == loss_role), piece(F.when(last, F.lit(END)).otherwise(F.lit("")), F.lit(False)))

    near = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    made = held.select("conv", F.flatten(F.zip_with(rows, near, segments)).alias("segments"))
    return made.select(F.col("conv").alias(conv), F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        at = F.instr(body, F.lit("\n"))
        role = unescape_role(F.substring(body, F.lit(1), at - 1))
        texts = F.split(F.substring(body, at + 1, F.length(body)), r"<\|im_turn\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
