"""Prompt compression over a table: one row per prompt stays one row, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.tokens import Scorer, compress_scored_struct, compress_struct, tokenize

Transform = Callable[[DataFrame], DataFrame]


def compress(
    text: str = "text",
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
) -> Transform:
    """Replace a text column by its compressed form and compression statistics."""

    def run(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != text]
        return df.select(*others, compress_struct(text, ratio, scorer).alias("_c")).select(
            *others, "_c.*"
        )

    return run


def compress_detailed(
    text: str = "text",
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
) -> Transform:
    """Like :func:`compress`, keeping the text and adding the tagged ``tokens`` array."""

    def run(df: DataFrame) -> DataFrame:
        detail = compress_struct(text, ratio, scorer, detailed=True)
        return df.select("*", detail.alias("_c")).select(*df.columns, "_c.*")

    return run


def compression_stats(
    text: str = "text",
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
) -> Transform:
    """The statistics of :func:`compress` alone; no text is put together."""

    def run(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != text]
        return df.select(*others, compress_struct(text, ratio, scorer, wanted=("stats",)).alias("_c")).select(*others, "_c.*")

    return run


def compress_scored(
    score_tokens: Callable[[Column], Column],
    text: str = "text",
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    detailed: bool = False,
) -> Transform:
    """:func:`compress` with scores from a function of the whole token array.

    Meant for a pandas UDF ``array<string> -> array<double>`` around a model; key boost and
    threshold still apply.
    """

    def run(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != text]
        tokens = F.coalesce(tokenize(text), F.array().cast("array<string>"))
        scored = df.withColumn("_k", tokens).withColumn("_s", score_tokens(F.col("_k")))
        result = compress_scored_struct(text, "_k", "_s", ratio, detailed)
        return scored.select(*others, result.alias("_c")).select(*others, "_c.*")

    return run


def compression_diff(
    text: str = "text",
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
) -> Transform:
    """One row per token: ``position, token, kept, score`` next to the other columns."""

    def run(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != text]
        detail = compress_struct(text, ratio, scorer, wanted=("tokens",))["tokens"]
        return df.select(*others, F.posexplode(detail).alias("position", "_t")).select(
            *others,
            "position",
            F.col("_t.text").alias("token"),
            F.col("_t.kept").alias("kept"),
            F.col("_t.score").alias("score"),
        )

    return run
