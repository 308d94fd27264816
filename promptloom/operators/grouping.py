"""Values and ordered texts of a key, for grouped operators.

What a key needs to know as a whole (its last user turn, its first done line) is a minimum or maximum by
key, combined before its shuffle, and joined back to the key's rows by an equi-join that the engine
can split under a hot key. Null is a key of its own throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order numbers whose texts are joined first. It bounds what one row of the first step gathers and has
#: no influence on the result.
FIRST_STEP_BITS = 12

#: (value, aggregate): a min or max over the rows of a key.
GroupValue = tuple[Column, Callable[[Column | str], Column]]


def key_values(rows: DataFrame, keys: Sequence[str], values: Mapping[str, GroupValue]) -> DataFrame:
    """One row per key with its minimum and maximum values."""
    return rows.groupBy(*keys).agg(*[pick(value).alias(name) for name, (value, pick) in values.items()])


def rows_by_key(
    values: DataFrame, rows: DataFrame, keys: Sequence[str], condition: Column, how: str = "left"
) -> DataFrame:
    """Values of each key next to those of its rows that meet ``condition``.

    A left join keeps keys of which no row is left, once, with null row columns.
    """
    located = rows.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in rows.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, [*same, condition])
    return values.join(located, on, how).drop(*[f"_r_{k}" for k in keys])


def joined_pieces(pieces: Column, separator: str = "") -> Column:
    """Texts of an array of ``struct<o, t>``, in order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["t"]), separator)


def ordered_text(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    text: Column,
    name: str,
    separator: str = "",
    **others: GroupValue,
) -> DataFrame:
    """One row per key: its texts joined in order, as ``(keys, name)``, and the ``others``.

    Null texts join as empty ones, or not at all where the order is null too; rows of equal order
    follow their text. Neighbouring order numbers are joined first and the joined texts then, so a
    task holds few pieces at a time before it makes the key's one text.
    """
    step = F.shiftright(F.col(order).cast("bigint"), FIRST_STEP_BITS)
    piece = F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))
    pieces = F.collect_list(F.when(text.isNotNull() | F.col(order).isNotNull(), piece))
    first = rows.groupBy(*keys, step.alias("_step")).agg(
        F.when(F.size(pieces) > 0, joined_pieces(pieces, separator)).alias("_text"),
        *[pick(value).alias(n) for n, (value, pick) in others.items()],
    )
    parts = F.collect_list(F.when(F.col("_text").isNotNull(), F.struct(F.col("_step").alias("o"), F.col("_text").alias("t"))))
    return first.groupBy(*keys).agg(
        joined_pieces(parts, separator).alias(name), *[pick(n).alias(n) for n, (_, pick) in others.items()]
    )
