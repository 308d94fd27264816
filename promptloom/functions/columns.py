"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.fixed_values import WHITESPACE_CHARS


def as_column(value: Column | str) -> Column:
    """A column from a column or a column name."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Without the binding the optimizer may inline ``value`` into lambdas used by ``body`` and
    evaluate it again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_where(
    df: DataFrame, value: Column, keep: Callable[[Column], Column], name: str, *columns: str
) -> DataFrame:
    """``columns`` and the computed ``value`` of the rows whose value passes ``keep``.

    A filter on a computed column is pushed below the projection and evaluates the value a second
    time; exploding a filtered one-element array evaluates it once. Meant for parsed JSON.
    """
    return df.select(*columns, F.explode(F.filter(F.array(value), keep)).alias(name))


def strip(text: Column | str, characters: str = WHITESPACE_CHARS) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(as_column(text), F.lit(characters))


def is_blank(text: Column | str) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """True when ``text`` contains at least one of the literal phrases."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def count_contained(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the literal phrases occur in ``text``, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in phrases])


def text_array(values: Sequence[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


# Multiplying by 2 ** 27 + 1 splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def round_exact(value: Column | str, digits: int, ties_up: bool = False) -> Column:
    """Round a double by its exact binary value, ties to even (or up).

    The built-in ``round`` works on the shortest decimal form instead, which turns 2.195 (a little
    less in binary) into 2.2 rather than 2.19.
    """
    power = float(10**digits)

    def halves(v: Column) -> Column:
        size = F.abs(v)
        wide = size * _SPLIT
        high = wide - (wide - size)
        return F.struct(
            F.signum(v).alias("sign"),
            high.alias("high"),
            (size - high).alias("low"),
            F.floor(size * power).alias("n"),
        )

    def nearest(h: Column) -> Column:
        above = (h["high"] * (2 * power) - (h["n"] * 2 + 1)) + h["low"] * (2 * power)
        up = (above >= 0) if ties_up else (above > 0) | ((above == 0) & (h["n"] % 2 == 1))
        return h["sign"] * (h["n"] + up.cast("int")) / power

    return let(let(as_column(value).cast("double"), halves), nearest)
