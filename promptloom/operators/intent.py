"""Intent classification of a request table, with model answers joined in where keywords fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.intent import answer_intent, strong_intent, weak_intent


def undecided_requests(requests: DataFrame, text: str = "text") -> DataFrame:
    """Requests whose strong keywords do not decide; only these need a model answer."""
    return requests.filter(strong_intent(text).isNull())


def resolve_intent(strong: Column, answer: Column, weak: Column) -> Column:
    """Strong keywords decide, then the model's answer, then the weak keywords."""
    return F.coalesce(strong, answer_intent(answer), weak)


def classify_intent(
    requests: DataFrame, answers: DataFrame, key: str = "request_id", text: str = "text"
) -> DataFrame:
    """``(key, intent, decided_by)`` per request.

    The texts are read once and become two votes; only keys and votes reach the join with
    ``answers`` (key, answer; one row per key).
    """
    strong = F.col("_v.strong")
    votes = F.struct(strong_intent(text).alias("strong"), weak_intent(text).alias("weak"))
    # exploded, so that the votes are computed below the join and only once
    voted = requests.select(key, F.explode(F.array(votes)).alias("_v"))
    answered = answer_intent("answer").isNotNull()
    return voted.join(answers.select(key, "answer"), key, "left").select(
        key,
        resolve_intent(strong, F.col("answer"), F.col("_v.weak")).alias("intent"),
        F.when(strong.isNotNull(), "strong").when(answered, "model").otherwise(F.lit("weak")).alias("decided_by"),
    )
