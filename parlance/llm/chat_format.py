"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and joined into one string in which
adjacent turns of one role share a block:

    <|im_start|>role\\n first text <|turn|> second text of the same role <|im_end|>\\n

Control strings inside texts and roles are escaped reversibly: a backslash is doubled, "<|" becomes
"<\\|", and in roles a line end becomes "<\\n|". After the doubling no input holds "<" followed by
exactly one backslash, so undoing the steps in reverse order gives back every string.

Defined results: rows are ordered by turn, ties by role, then text, nulls first; equal rows are kept
as they are. A null text or role is empty. A null conv_id is a conversation of its own. An empty
table gives an empty result. A conversation is one output row, so its turns meet in one task; that
is the size of one result row, not of a group that could be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|turn|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation of `turns` (conv_id, turn, role, text).

    Other columns of `turns` are left out.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(turn: Column, i: Column, all_turns: Column) -> Column:
        before = F.get(all_turns, i - 1)
        same = (i > 0) & (before["role"] == turn["role"])
        opening = F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"))
        return F.concat(
            F.when(same, F.lit(NEXT)).when(i == 0, opening).otherwise(F.concat(F.lit(END + "\n"), opening)),
            escape(turn["text"]),
        )

    return chats.select(
        "conv_id",
        F.concat(
            F.array_join(F.transform("turns", lambda t, i: piece(t, i, F.col("turns"))), ""),
            F.lit(END + "\n"),
        ).alias("formatted"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the role and text of every turn, parsed from `formatted` alone."""
    blocks = F.filter(F.split(F.col("formatted"), r"<\|im_start\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        rest = F.substr(block, F.length(role) + 2)
        body = F.substring_index(rest, END, 1)
        return F.transform(
            F.split(body, r"<\|turn\|>"),
            lambda text: F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")),
        )

    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def digest(chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """What is checked of formatted chats, all of it read back from the formatted text.

    The loss mask covers the texts of the role `trained`.
    """
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == trained), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        read_back(chats)
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.col("whole"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
