"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role become one
block; a block marks where each of its turns ends, so the output can be read back whole:

    <|im_start|>role
    text[<|im_sep|>text ...]<|im_end|>

In texts every `<`, back slashes, `|` gets one more back slash, so no text holds `<|`; roles are
percent-encoded. Both are undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted) for conversations of (conv_id, turn, role, text).

    segments is an array of (text, loss) whose texts join to formatted; loss marks assistant texts.
    A null text or role is an empty one. Equal turn numbers are ordered by role, then text, nulls
    first; repeated rows stay repeated turns. Rows with a null conv_id form one conversation. Other columns are
    ignored, and an empty table gives no rows.
    """
    row = F.struct("turn", F.url_encode(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))

    def pieces(t: Column, i: Column) -> Column:
        before = F.get("t", i - 1)
        joined = (i > 0) & (before["role"] == t["role"])
        head = F.when(joined, F.lit(SEP)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(START), t["role"], F.lit("\n")))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == LEARNED_ROLE).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    out = sorted_.select("conv_id", F.concat(F.flatten(F.transform("t", pieces)), last).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) parsed from formatted, loss_text from the loss mask."""
    blocks = F.filter(F.split("formatted", "<\\|im_end\\|>\n", -1), lambda b: b != "")

    def parsed(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), "<\\|im_sep\\|>", -1)
        return F.transform(texts, lambda t: F.struct(F.url_decode(role).alias("role"), unescape(t).alias("text")))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select("conv_id", F.flatten(F.transform(blocks, parsed)).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
