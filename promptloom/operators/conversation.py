"""Operators over a turns table ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import is_blank
from promptloom.functions.text import (
    asks_to_proceed,
    has_marker,
    looks_like_deliverable,
    requirements_from_reply,
)
from promptloom.operators.grouping import key_values, ordered_text, rows_by_key

_TURN_COLUMNS = ("conv_id", "turn", "role", "text")


def clean_history(turns: DataFrame) -> DataFrame:
    """Non-blank user and assistant turns up to the last such user turn.

    A conversation with nothing left becomes one user turn with the fixed greeting. The turns are read
    twice: a conversation's last user turn has to be known before its turns can be told apart.
    """
    usable = F.col("role").isin("user", "assistant") & ~is_blank("text")
    last_user = F.when(usable & (F.col("role") == "user"), F.col("turn"))
    values = key_values(turns, ["conv_id"], {"last_user_turn": (last_user, F.max)})
    kept = rows_by_key(values, turns.filter(usable), ["conv_id"], F.col("turn") <= F.col("last_user_turn"))
    return kept.select(
        "conv_id",
        F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit(V.EMPTY_HISTORY_TEXT)).alias("text"),
    )


def chat_payload_rows(turns: DataFrame, system: str = "") -> DataFrame:
    """Message rows of a chat call: the system prompt first (turn -1) unless it is empty."""
    messages = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    if not system:
        return messages
    prompts = (
        turns.select("conv_id")
        .distinct()
        .select(
            "conv_id",
            F.lit(-1).cast("bigint").alias("turn"),
            F.lit("system").alias("role"),
            F.lit(system).alias("text"),
        )
    )
    return messages.unionByName(prompts)


def extract_requirements(turns: DataFrame, attach: DataFrame | None = None) -> DataFrame:
    """Requirement summary per conversation as ``(conv_id, summary)``.

    The latest assistant turn with the completion marker, cleaned; without one, every user text in
    order joined by `` | ``. The turns are read twice: which of them a conversation needs is only
    known from all of them; texts are shuffled once.

    ``attach`` is a table with one row per ``conv_id`` whose columns are added. It is joined to the
    small table of marker turns, which saves shuffling the summaries for it.
    """
    is_user = F.col("role") == "user"
    is_marked = (F.col("role") == "assistant") & has_marker("text")
    values = key_values(turns, ["conv_id"], {"marker_turn": (F.when(is_marked, F.col("turn")), F.max)})
    attached = [c for c in attach.columns if c != "conv_id"] if attach is not None else []
    if attach is not None:
        values = values.join(attach, "conv_id", "left")
    no_marker = F.col("marker_turn").isNull()
    chosen = rows_by_key(
        values,
        turns.filter(is_user | is_marked),
        ["conv_id"],
        F.when(no_marker, is_user).otherwise(F.col("turn") == F.col("marker_turn")),
    )
    text = F.when(no_marker, F.col("text")).otherwise(requirements_from_reply("text"))
    return ordered_text(
        chosen, ["conv_id", *attached], "turn", text, "summary", separator=" | "
    )


def completion_flags(turns: DataFrame, *more: str) -> DataFrame:
    """Per-turn flags that :func:`phase_complete` reduces; also used on streams. ``more`` columns are kept."""
    is_user = F.col("role") == "user"
    is_reply = F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        *more,
        F.when(is_user, F.col("turn")).alias("user_turn"),
        F.when(is_user, asks_to_proceed("text")).alias("proceed"),
        F.when(is_reply, F.col("turn")).alias("reply_turn"),
        F.when(is_reply, has_marker("text")).alias("marked"),
        F.when(is_reply, looks_like_deliverable("text")).alias("deliverable"),
    )


def completion_aggregates() -> list:
    """Flags of the latest user turn and of the latest reply; small fixed-width state."""
    return [
        F.coalesce(F.max_by("proceed", "user_turn"), F.lit(False)).alias("wants_to_proceed"),
        F.coalesce(F.max_by("marked", "reply_turn"), F.lit(False)).alias("has_marker"),
        F.coalesce(F.max_by("deliverable", "reply_turn"), F.lit(False)).alias("is_deliverable"),
    ]


def with_complete(flags: DataFrame) -> DataFrame:
    """Add the completion decision to reduced flags."""
    return flags.withColumn(
        "complete", F.col("has_marker") | F.col("wants_to_proceed") | F.col("is_deliverable")
    )


def phase_complete(turns: DataFrame) -> DataFrame:
    """Whether scoping is complete, per conversation, from its latest user turn and latest reply."""
    flags = completion_flags(turns)
    return with_complete(flags.groupBy("conv_id").agg(*completion_aggregates()))


def wants_to_proceed(turns: DataFrame) -> DataFrame:
    """Whether the latest user turn asks to go ahead; false without a user turn."""
    return phase_complete(turns).select("conv_id", "wants_to_proceed")
