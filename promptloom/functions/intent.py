"""Keyword rules that tell a software build from a knowledge task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column, contains_any, count_contained, let, strip

BUILD, PERFORM = "build", "perform"


def strong_intent(text: Column | str) -> Column:
    """Intent when exactly one side's strong keywords occur (or the text is blank), else null."""

    def decide(low: Column) -> Column:
        flags = F.struct(
            contains_any(low, V.STRONG_PERFORM).alias("p"), contains_any(low, V.STRONG_BUILD).alias("b")
        )
        return let(
            flags,
            lambda f: F.when(low == "", BUILD)
            .when(f["p"] & ~f["b"], PERFORM)
            .when(f["b"] & ~f["p"], BUILD),
        )

    return let(F.lower(strip(F.coalesce(as_column(text), F.lit("")))), decide)


def answer_intent(answer: Column | str) -> Column:
    """Intent named by a model answer; null when it names none or is missing."""
    upper = F.upper(as_column(answer))
    return F.when(F.contains(upper, F.lit("PERFORM")), PERFORM).when(
        F.contains(upper, F.lit("BUILD")), BUILD
    )


def weak_intent(text: Column | str) -> Column:
    """Intent with more distinct weak keywords; a tie is a build."""
    return let(
        F.lower(strip(F.coalesce(as_column(text), F.lit("")))),
        lambda low: F.when(
            count_contained(low, V.WEAK_PERFORM) > count_contained(low, V.WEAK_BUILD), PERFORM
        ).otherwise(BUILD),
    )


def intent_question(text: Column | str) -> Column:
    """The part of a request that is shown to the classifying model."""
    return F.substring(strip(text), 1, V.INTENT_INPUT_LENGTH)
