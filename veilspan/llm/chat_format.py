"""Chat texts with a grammar round trip; DataFrame functions only.

Grammar: conversation = turn*; turn = ``<s>[INST] `` role `` [/INST] `` text ``</s>``. The parser splits at ``</s>``, drops the opening
string, splits at the first `` [/INST] `` and takes one backslash out of every escaped control string.
A conversation is first rendered as it is and parsed again. Where the turns that come back differ from the source, or hold a
control string (all of them are grammar, those that the parser does not split at too), the
roles and texts that hold a control string (or something that looks like an escaped one) are escaped, each
by one more backslash behind its opening bracket: then no control string is left inside, and taking the
backslash out restores the source, so the second round trip is identical.

The loss mask is a list of character spans in the formatted text: the contents of the assistant's turns.

Defined cases: null texts and roles are empty; rows are ordered by turn (null first), then role and text; rows without
conv_id form one conversation without id. A conversation without rows does not occur. Other columns are not read. A
conversation is one row of output, so its own rows bound what is gathered for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: A control string with any number of backslashes behind its bracket.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
_GRAMMAR = r"[<\[](/?s>|/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _raw_turns(formatted: Column) -> Column:
    """role and text of every turn as they stand in the formatted text."""
    pieces = F.split(formatted, r"\Q</s>\E")
    # The last closing string leaves an empty piece behind it.
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    def turn(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = F.when(at > 0, F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).otherwise(piece)
        text = F.when(at > 0, F.substring(piece, at + len(MIDDLE), F.length(piece))).otherwise(F.lit(""))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(pieces, turn)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    return F.transform(
        _raw_turns(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    )


def loss_spans(formatted: Column) -> Column:
    """start and length, in characters from 0, of the assistant's contents in a formatted text."""
    sizes = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)
    turns = _raw_turns(formatted)
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + sizes(t)).alias("at"),
            F.when(
                unescape(t["role"]) == LEARNED,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)).alias("start"), F.length(t["text"]).alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return start["spans"]


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of every conversation (rows: conv_id, turn, role, text)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = whole.withColumn("plain", _render(F.col("turns")))
    inside = F.exists(_raw_turns(F.col("plain")), lambda t: t["role"].rlike(_GRAMMAR) | t["text"].rlike(_GRAMMAR))
    same = (parse(F.col("plain")) == F.col("turns")) & ~inside
    safe = _render(F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    formatted = plain.select("conv_id", F.when(same, F.col("plain")).otherwise(safe).alias("formatted"))
    return formatted.withColumn("loss_spans", loss_spans(F.col("formatted")))
