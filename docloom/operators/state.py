"""Conversations: windows over their messages, lists, and what is forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X

PROMPT_MESSAGES, STORED_MESSAGES, CONVERSATIONS, RECENT = 6, 20, 20, 8


def last_messages(messages: DataFrame, n: int = PROMPT_MESSAGES) -> DataFrame:
    """The last n messages (conv_id, turn) of each conversation."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def history(messages: DataFrame, n: int = PROMPT_MESSAGES) -> DataFrame:
    """For each message the n before it, as prompt lines in order."""
    before = F.collect_list(X.history_line(F.col("role"), F.col("text"))).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1))
    return messages.select("conv_id", "turn", F.array_join(before, "\n").alias("history"))


def conversation_list(messages: DataFrame) -> DataFrame:
    """Number of messages and last turn of each conversation, the longest first."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id")


def keep_recent(conversations: DataFrame, updated_col: str, protected: list, n: int = CONVERSATIONS) -> DataFrame:
    """The n conversations updated last; protected ones stay and count first."""
    order = W.orderBy(F.when(F.col("conv_id").isin(protected), 0).otherwise(1), F.desc(updated_col), "conv_id")
    top = conversations.orderBy(F.when(F.col("conv_id").isin(protected), 0).otherwise(1), F.desc(updated_col), "conv_id").limit(max(n, len(protected)))
    return top.withColumn("place", F.row_number().over(order))


def move_to_front(recent: list[str], folder: str, n: int = RECENT) -> list[str]:
    return [folder, *(f for f in recent if f != folder)][:n]
