"""Perspective rotation of multi-party dialogues. DataFrame functions only.

For every speaker of a conversation the dialogue is rendered with that speaker as the assistant and all others as named users; the
mask lists the character spans of the assistant's words. System turns stay system turns and are nobody's perspective.

Markers begin with ``<|`` and the header of a named user ends with ``|>``. Neither occurs in what a speaker says or is called: a
backslash is put before the bar (before the ``>`` in names), one more where backslashes stand there already, so taking one away from
each such place gives the words back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks

#: Messages of one part of a rendered dialogue.
MESSAGES = 512
SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def escaped(text: Column) -> Column:
    """Text that holds no ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A name that holds neither ``<|`` nor ``|>``."""
    return F.regexp_replace(escaped(name), r"\|(\\*)>", r"|\\$1>")


def _header(speaker: Column, participant: Column) -> Column:
    return (
        F.when(speaker == SYSTEM, F.lit("<|system|>\n")).when(speaker == participant, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(speaker), F.lit("|>\n")))
    )


def parts(turns: DataFrame, conv_col: str, turn_col: str, speaker_col: str, text_col: str, messages: int = MESSAGES) -> DataFrame:
    """Rows of (conv, part, messages): each part holds so many consecutive messages of a dialogue, the last one the rest."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    placed = ranks.row_numbers(rows, ["conv"], [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")], "number", "all")
    placed = placed.withColumn("part", F.floor((F.col("number") - 1) / messages).cast("long"))
    message = F.struct("number", "speaker", escaped(F.col("text")).alias("text"))
    return placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
           messages: int = MESSAGES) -> DataFrame:
    """One row per conversation, participant and part: ``text`` and ``mask`` (array of start and end, in characters of ``text``).

    A dialogue of up to ``messages`` messages is one row, whatever its turn numbers; a longer one is paged by the places of its messages,
    so no task holds a whole one, and its parts in order are its rendering. Messages are ordered by turn, then speaker and text; repeated
    rows stay. A null speaker is called "unknown", a null text is empty, null conversation ids are one conversation, messages without a
    turn come last. A conversation of system turns alone has no participant and no row; an empty table gives an empty result. Further
    columns are not read.
    """
    people = turns.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("participant")).filter(F.col("participant") != SYSTEM).distinct()
    dialogue = parts(turns, conv_col, turn_col, speaker_col, text_col, messages)
    both = dialogue.alias("d").join(people.alias("p"), F.col("d.conv").eqNullSafe(F.col("p.conv"))).select("d.*", "participant")
    shown = F.transform("messages", lambda m: F.struct(_header(m["speaker"], F.col("participant")).alias("head"), m["text"].alias("text"), (m["speaker"] == F.col("participant")).alias("own")))
    both = both.withColumn("shown", shown)
    span = F.aggregate(
        "shown", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["text"]) + len(END)).alias("at"),
            F.when(m["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(m["head"])).alias("begin"), (acc["at"] + F.length(m["head"]) + F.length(m["text"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["text"], F.lit(END))), "")
    return both.select(F.col("conv").alias(conv_col), "participant", "part", F.size("messages").alias("n_messages"), text.alias("text"), span.alias("mask"))
