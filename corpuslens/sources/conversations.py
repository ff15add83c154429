"""Pairs out of a table of conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A turn belongs to the user turn this many places after it.
OFFSETS = {"system": 1, "user": 0, "assistant": -1}


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """One row per answered user turn: conv_id, turn, instruction, prompt, response.

    A system turn right before the user turn becomes the instruction. Every turn names the user
    turn it belongs to, and one aggregation on (conv_id, user turn) brings them together: a
    single scan and shuffle, whose key stays fine-grained when one conversation is very long.
    """

    def text_of(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("text")))

    owner = F.coalesce(
        *[F.when(F.col("role") == role, F.col("turn") + n) for role, n in OFFSETS.items()]
    )
    return (
        turns.where(F.col("role").isin(*OFFSETS))
        .groupBy("conv_id", owner.alias("turn"))
        .agg(
            text_of("system").alias("instruction"),
            text_of("user").alias("prompt"),
            text_of("assistant").alias("response"),
        )
        .where(F.col("prompt").isNotNull() & F.col("response").isNotNull())
    )
