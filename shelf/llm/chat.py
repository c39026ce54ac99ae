r"""Chat transcripts as training text, by expressions only.

    ### user: first text
    </turn>
    ### assistant: an answer
    </turn>
    its second turn, under the same header
    </turn>

Turns are collected per conversation, sorted, and runs of one role share a header.
``### `` and ``</turn>`` inside a text get a backslash in front; in a role, ``\``
and ``:`` do.  A control string in a text therefore always has a backslash before
it and a real mark never has one, so reading back is exact.

Defined cases: null texts and roles are empty; turns sort by (turn, role, text)
with null first, so ties and repeated rows have one order; rows without a conv_id
are one conversation of their own; an empty table gives no rows; further columns
are ignored.  A conversation is one record of the output and has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, SPLIT, END = "### ", ": ", "\n</turn>\n"
#: A run of backslashes, possibly none, and a control string behind it.
_CONTROL = r"(?<!\\)(\\*+)(### |</turn>)"
_ESCAPED = r"(?<!\\)\\(\\*+)(### |</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the same string as
    ``segments`` of (piece, loss), where loss marks what a model is trained on."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("turns.role"), i - 1) == x["role"])
        header = F.concat(F.lit(HEADER), F.regexp_replace(x["role"], r"([\\:])", r"\\$1"), F.lit(SPLIT))
        return F.array(
            F.struct(F.when(same, "").otherwise(header).alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("piece"), x["role"].isin(*loss_roles).alias("loss")),
            F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
        )

    # the merge of adjacent turns: a header only where the role before is another
    segments = F.filter(F.flatten(F.transform("turns", pieces)), lambda s: s["piece"] != "")
    return sorted_turns.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join("segments.piece", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    blocks = F.split(F.regexp_replace(formatted, r"\n</turn>\n\z", ""), r"\n</turn>\n(?=### )")

    def block(b: Column) -> Column:
        header = F.regexp_extract(b, r"(?s)\A(### (?:[^\\:]|\\.)*+: )", 1)
        role = F.regexp_replace(F.substr(header, F.lit(5), F.length(header) - 6), r"(?s)\\(.)", "$1")
        texts = F.split(F.substr(b, F.length(header) + 1), r"\n</turn>\n")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
