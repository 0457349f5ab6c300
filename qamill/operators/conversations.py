"""Conversations: rendering whole conversations in the chat layout and turning
adjacent user -> assistant turns into question/answer samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as T

#: A sample's key: the question's place in its conversation.
KEYS = ("conv_id", "turn")


def render(conversations: DataFrame, generation_suffix: str = "") -> DataFrame:
    """One chat text per conversation: segments in turn order, plus the
    generation prompt when the last message is not the assistant's.

    A conversation is the output unit, so its turns meet in one group; the
    segments are built before the shuffle and partial aggregation is not
    possible for an ordered concatenation, but a group is one conversation,
    not a share of the table. A null text is an empty message."""
    seg = T.chat_segment(F.col("role"), F.coalesce("text", F.lit("")))
    grouped = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), seg.alias("seg")))).alias("segs"),
        F.max_by(F.col("role"), F.col("turn")).alias("last_role"),
        F.count(F.lit(1)).alias("n_turns"))
    body = F.array_join(F.transform("segs", lambda s: s["seg"]), "")
    tail = F.when(F.col("last_role") != F.lit("assistant"),
                  F.lit(T.CHAT_GENERATION_PROMPT + generation_suffix)).otherwise(F.lit(""))
    return grouped.select("conv_id", "n_turns", F.concat(body, tail).alias("text"))


def with_prompts(pairs: DataFrame, use_chat: bool = False, generation_suffix: str = "") -> DataFrame:
    """Generation prompt for each sample in one layout."""
    return pairs.withColumn("prompt", T.prompt_text(F.col("question"), F.lit(use_chat),
                                                    generation_suffix))


def training_texts(pairs: DataFrame, use_chat, eos: str | None = T.DEFAULT_EOS,
                   generation_suffix: str = "", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Prompt text and full training text for each sample. ``generation_suffix`` is what a
    chat template's options add to the generation prompt; the full text has no such part, so
    prompt and full text then part ways before the prompt ends."""
    flag = F.lit(use_chat) if isinstance(use_chat, bool) else use_chat
    return pairs.select(*keys, T.prompt_text(F.col("question"), flag, generation_suffix).alias("prompt_text"),
                        T.full_text(F.col("question"), F.col("answer"), flag, eos).alias("full_text"))
