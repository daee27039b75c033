"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its
own, with all turns before it as context and only its text trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD = "### "
COLON = ": "
END = " </turn>\n"
#: What a control string could begin or end with, and how it stands inside texts. Every
#: backslash of an escaped text begins one of these.
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h", ":": "\\c"}


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def examples(conversations: DataFrame, trained: str = ASSISTANT) -> DataFrame:
    """One row per example: conv_id, example, n_turns, text, loss_start, loss_length.

    ``text`` holds the turns up to the example's reply; ``loss_start`` and ``loss_length`` are
    the code points of the reply in it. Turns after the last reply, or of a conversation
    without replies, end a last example that trains nothing (its loss length is null). Turns
    are in the order of ``turn``, those of one number or none in that of role and text; null
    roles and texts are empty; repeated rows are turns of their own; rows without conv_id are
    one conversation. Other columns are not read. An empty table gives none.

    A conversation is one row from the first grouping on, as every example of it needs its
    turns; the examples of n replies repeat the context n times.
    """
    ordered = (
        conversations.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(COLON))
    parts = ordered.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias(
            "parts"
        ),
    )
    last = F.col("at") == F.size("parts") - 1
    reply = F.col("t.role") == trained
    text = F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), "")
    length = F.when(reply, F.length(escape(F.col("t.text"))))
    return (
        parts.select("conv_id", "parts", F.posexplode("turns").alias("at", "t"))
        .where(reply | last)
        .select("conv_id", F.col("at").alias("example"), (F.col("at") + 1).alias("n_turns"),
                text.alias("text"), length.alias("loss_length"))
        .select("conv_id", "example", "n_turns", "text",
                (F.length("text") - len(END) - F.col("loss_length")).alias("loss_start"),
                "loss_length")
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    cut = F.filter(F.split(text, END, -1), lambda part: part != "")
    body = lambda part: F.substr(part, F.lit(len(HEAD) + 1))
    return F.transform(
        cut,
        lambda part: F.struct(
            unescape(F.substring_index(body(part), COLON, 1)).alias("role"),
            unescape(
                F.substr(body(part), F.instr(body(part), COLON) + len(COLON))
            ).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say: conv_id, turns, losses (the trained texts
    in order) and formatted_chars, from their texts and loss masks alone."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length")))
    told = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("loss_length").isNotNull(),
                       F.struct("example", loss.alias("text")))
            )
        ).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    return told.select(
        "conv_id",
        parsed(F.col("longest")).alias("turns"),
        F.transform("losses", lambda x: x["text"]).alias("losses"),
        "formatted_chars",
    )
