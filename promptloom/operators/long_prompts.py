"""Compression of prompts too long for one row of arrays: slices of a prompt are worked on by many tasks.

The result is that of ``operators.compression.compress`` with default scores. A prompt is cut into slices after a blank,
where no token goes on. What a slice has to know of the others comes from small tables with one row a slice:

* whether it starts inside a string: a slice maps both possible states to the state it ends in, such maps
  compose associatively, and a running composition over the slices gives every slice its state;
* the two tokens after it, for keys before a colon: those of the next slices that have any;
* the lowest score that is kept: the number of tokens by prompt and score, of which there are few, is added up
  before it moves, and summed from the highest score on. No prompt's scores are sorted.

The compressed text of a prompt is one value in the end, as its input was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import let, rows_where
from promptloom.functions.tokens import (
    boost_keys, compression_multiplier, compression_ratio, is_skeleton, open_at_end, score_tokens, tidy_joined, tokenize,
)
from promptloom.operators.grouping import ordered_text
from promptloom.session import materialise

#: Characters of a slice, which goes on to the next blank.
SLICE_CHARACTERS = 1 << 16


def slices(prompts: DataFrame, key: str, text: str, width: int = SLICE_CHARACTERS) -> DataFrame:
    """``(key, slice, piece)``: the text in pieces of ``width`` characters and what follows up to a blank, which ends the piece."""
    pattern = rf"(?s).{{{width}}}[^{V.WS}]*+[{V.WS}]?+|.+"
    pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return prompts.select(key, F.posexplode(pieces).alias("slice", "piece")).repartition(key, "slice")


def _states(pieces: DataFrame, key: str) -> DataFrame:
    """``(key, slice, inside)``: whether a slice starts inside a string."""
    has_quote = F.contains("piece", F.lit(V.QUOTE))
    ends = pieces.select(
        key,
        "slice",
        F.when(has_quote, open_at_end(F.col("piece"))).otherwise(F.lit(False)).alias("from_outside"),
        F.when(has_quote, open_at_end(F.concat(F.lit(V.QUOTE), F.col("piece")))).otherwise(F.lit(True)).alias("from_inside"),
    )
    # a slice sets the state, turns it over or leaves it; what counts is the last one that sets it and the turns since
    sets = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    order = Window.partitionBy(key).orderBy("slice")
    to_here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    counted = ends.select(key, "slice", sets.alias("sets"), F.sum(turns).over(to_here).alias("turned"))
    at_set = F.when(F.col("sets").isNotNull(), F.struct("sets", "turned"))
    last = F.last(at_set, ignorenulls=True).over(before)
    now = F.coalesce(F.lag("turned").over(order), F.lit(0))
    placed = counted.select(key, "slice", last.alias("last"), now.alias("now"))
    turned = (F.col("now") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    return placed.select(key, "slice", (F.coalesce("last.sets", F.lit(False)) != turned).alias("inside"))


def _tokens() -> Column:
    """Tokens of a piece that starts outside or inside a string."""
    reopened = let(tokenize(F.concat(F.lit(V.QUOTE), F.col("piece"))), lambda t: F.slice(t, 2, F.size(t)))
    return F.when(F.col("inside"), reopened).otherwise(tokenize("piece"))


def _following(located: DataFrame, key: str) -> DataFrame:
    """``(key, slice, after)``: up to two tokens that come after each slice with tokens.

    Only colons and quotes after a token matter to it, so slices that start otherwise are not taken apart: they
    give their first character.
    """
    start = F.regexp_extract("piece", rf"[^{V.WS}]", 0)
    some = located.where(F.rlike("piece", F.lit(rf"[^{V.WS}]")))
    first = F.when(start.isin(":", V.QUOTE), F.slice(_tokens(), 1, 2)).otherwise(F.array(start))
    firsts = some.select(key, "slice", first.alias("first"))
    order = Window.partitionBy(key).orderBy("slice")
    none = F.array().cast("array<string>")
    nexts = F.concat(*[F.coalesce(F.lead("first", n).over(order), none) for n in (1, 2)])
    return firsts.select(key, "slice", nexts.alias("after"))


def scored_slices(prompts: DataFrame, key: str, text: str, width: int = SLICE_CHARACTERS) -> DataFrame:
    """``(key, slice, tokens, scores)`` of every slice that has tokens; keys before a colon are raised over slice ends too."""
    pieces = slices(prompts, key, text, width)
    located = pieces.join(_states(pieces, key), [key, "slice"])
    rows = located.join(_following(located, key), [key, "slice"]).select(key, "slice", _tokens().alias("tokens"), "after")

    def boosted(t: Column) -> Column:
        def with_next(scores: Column) -> Column:
            padded = F.concat(scores, F.transform("after", lambda _: F.lit(0.0)))
            raised = let(padded, lambda s: let(F.concat(t["tokens"], F.col("after")), lambda k: boost_keys(k, s)))
            has_colon = F.array_contains(t["tokens"], ":") | F.array_contains("after", ":")
            return F.when(has_colon, F.slice(raised, 1, F.size(t["tokens"]))).otherwise(scores)

        return let(score_tokens(t["tokens"]), with_next)

    return rows.select(key, "slice", "tokens", let(F.struct("tokens"), boosted).alias("scores"))


def thresholds(scored: DataFrame, key: str, ratio: float) -> DataFrame:
    """``(key, original_tokens, threshold)``: the lowest score that is kept, from the counts by score."""
    counts = scored.select(key, F.explode("scores").alias("score")).groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"))
    by_score = Window.partitionBy(key).orderBy(F.desc("score"))
    counts = counts.withColumn("upto", F.sum("n").over(by_score)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    rank = F.least(F.col("all"), F.greatest(F.lit(1), (F.col("all") * F.lit(float(ratio))).cast("bigint")))
    return counts.where(F.col("upto") >= rank).groupBy(key).agg(
        F.max("all").cast("int").alias("original_tokens"), F.max("score").alias("threshold")
    )


def compress_long(
    prompts: DataFrame, key: str, text: str = "text", ratio: float = V.DEFAULT_PRESERVE_RATIO, width: int = SLICE_CHARACTERS, folder: str | None = None
) -> DataFrame:
    """``(key, compressed, original_tokens, compressed_tokens, ratio, multiplier)``, as ``compress`` gives for each prompt.

    ``key`` is unique and not null. The scored slices are written once, below ``folder`` or else the cluster's shared folder. Text
    without tokens comes back unchanged, and so does null.
    """
    scored = materialise(scored_slices(prompts, key, text, width), "scored", folder)
    kept = F.filter("tokens", lambda t, i: (F.get("scores", i) >= F.col("threshold")) | is_skeleton(t))
    joined = let(kept, lambda k: F.struct(F.array_join(k, " ").alias("text"), F.size(k).alias("n")))
    located = scored.join(thresholds(scored, key, ratio), key)
    rows = rows_where(located, joined, lambda v: v["n"] > 0, "kept", key, "slice", "original_tokens")
    whole = ordered_text(
        rows, [key], "slice", F.col("kept.text"), "joined", separator=" ",
        n=(F.col("kept.n"), F.sum), original_tokens=(F.col("original_tokens"), F.max),
    )
    done = prompts.select(key, text).join(whole, key, "left")
    original, left = F.coalesce("original_tokens", F.lit(0)), F.coalesce("n", F.lit(0)).cast("int")
    return done.select(
        key,
        F.when(original > 0, tidy_joined(F.col("joined"))).otherwise(F.col(text)).alias("compressed"),
        original.alias("original_tokens"),
        left.alias("compressed_tokens"),
        compression_ratio(original, left).alias("ratio"),
        compression_multiplier(original, left).alias("multiplier"),
    )
