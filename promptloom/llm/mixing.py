"""Mix sources to target weights by hierarchical budgeting.

Weights hang on a tree of domain, language and source. The token budget goes down from the root: a
node's share is split among its children by weight, a child that has less than its share (its
tokens times the most epochs allowed) is filled up, and what it leaves goes to its siblings by
weight. As a node never gets more than all below it hold, shortages are made up among siblings
first and reach the node's own siblings only when the whole branch is short. A leaf's budget is
then met by whole epochs and a prefix, by tokens, of one more epoch in seeded order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import free_names, written

LEVELS = ("domain", "lang", "source")
#: Parts of a leaf's seeded order. Only a part that the budget's end lies in is sorted.
PARTS = 4096


def word_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, counted as its tokens; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def fill(budget: float, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Split a budget by weight where no part takes more than its room.

    Parts that are short are filled and the rest is split anew among the others. Parts of weight 0
    get nothing unless all others are full, and then by their room.
    """
    share, left = np.zeros(len(room)), min(budget, float(room.sum()))
    for rank in (weights, room):
        while left > 1e-9:
            can = (rank > 0) & (share < room - 1e-9)
            if not can.any():
                break
            offer = left * np.where(can, rank, 0) / rank[can].sum()
            taken = np.minimum(offer, room - share)
            share += taken
            left -= float(taken.sum())
    return share


def _splitter(path: list[str], weights: dict[tuple, float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def split(children: pd.DataFrame) -> pd.DataFrame:
        """Budgets of the children of one node, in an order that does not depend on that of the rows."""
        keys = [tuple(None if pd.isna(x) else x for x in row) for row in children[path].itertuples(index=False)]
        room = children["room"].to_numpy(float)
        listed = float(sum(weights[k] for k in keys if k in weights))
        # room is counted in tokens: beside listed siblings it is brought to the scale of their weights
        scale = listed / room.sum() if listed > 0 and room.sum() > 0 else 1.0
        weight = np.array([weights.get(k, r * scale) for k, r in zip(keys, room, strict=True)], dtype=float)
        order = sorted(range(len(keys)), key=lambda i: tuple((x is None, str(x)) for x in keys[i]))
        given = np.zeros(len(keys))
        given[order] = fill(float(children["above"].iloc[0]), weight[order], room[order])
        return children[path].assign(budget=given)

    return split


def budgets(leaves: DataFrame, weights: Mapping[tuple, float], total: float, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (levels, ``room``) with ``budget``: each level is split below its parent's node.

    ``weights`` maps paths, such as ``("web",)`` or ``("web", "en", None)``, to weights; a node
    without one weighs its share of the room times the sum of its siblings' weights, or its room where
    no sibling has one. One task gets the children of one node.
    """
    now: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        above, path = list(levels[: depth - 1]), list(levels[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("room").alias("room"))
        if now is None:
            nodes = nodes.withColumn("above", F.lit(float(total))).withColumn("_root", F.lit(0))
        else:
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above]
            nodes = nodes.join(now.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("budget").alias("above")), on)
            nodes = nodes.select(*path, "room", "above")

        schema = ", ".join([*(f"`{c}` string" for c in path), "budget double"])
        now = nodes.groupBy(*(above or ["_root"])).applyInPandas(_splitter(path, dict(weights)), schema)
    return now


def copies(
    docs: DataFrame,
    weights: Mapping[tuple, float],
    total: float | None = None,
    share: float = 1.0,
    most_epochs: int = 1,
    seed: int = 0,
    domain: Column | None = None,
    tokens: Column | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """How often each row is taken: ``(doc_id, domain, lang, source, tokens, copies, budget)``.

    ``total`` is the budget in tokens, by default ``share`` of all there are. ``domain`` (by default
    one for all), ``lang`` and ``source`` may be null, which is a value of its own; rows without
    tokens are taken once for every whole epoch. Ties of the seeded order are broken by id and tokens; of
    equal rows either may be the one taken. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.lit("all") if domain is None else domain.cast("string")).alias("domain"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (word_tokens(F.col("text")) if tokens is None else tokens.cast("bigint")).alias("tokens"),
    )
    rows = written(rows, "leaves")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("held"))
    if total is None:
        total = float(leaves.agg(F.sum("held")).first()[0] or 0) * share
    leaves = leaves.withColumn("room", F.col("held") * F.lit(float(most_epochs)))
    given = budgets(leaves, weights, total)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
    held = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "held")
    # floating point must not turn a full leaf into one that misses its last row
    epochs = F.when(F.col("held") > 0, F.floor((F.col("budget") + 1e-6 * F.col("held")) / F.col("held"))).otherwise(F.lit(0))
    plan = given.join(held, same).select(*LEVELS, "budget", "held", epochs.cast("bigint").alias("epochs"))
    plan = written(plan.withColumn("wanted", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("held"))), "plan")

    # leaves are as many as domains, languages and sources combine to: Spark sends them to all tasks if small
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "budget", "epochs", "wanted")
    placed = rows.join(plan, same).drop(*[f"_{c}" for c in LEVELS])
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    placed = placed.withColumn("_order", order).withColumn("_part", F.shiftrightunsigned("_order", 64 - PARTS.bit_length() + 1))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("_part")
    parts = placed.groupBy(*LEVELS, "_part").agg(F.sum("tokens").alias("_sum"), F.max("wanted").alias("_wanted"))
    parts = parts.withColumn("_before", F.sum("_sum").over(by_leaf) - F.col("_sum")).select(
        *[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("_part").alias("_p"), "_before", "_sum", "_wanted"
    )
    whole = (F.col("_before") + F.col("_sum")) <= F.col("_wanted")
    parts = parts.withColumn("_state", F.when(whole, F.lit(2)).when(F.col("_before") < F.col("_wanted"), F.lit(1)).otherwise(F.lit(0)))
    placed = placed.join(parts.drop("_wanted", "_sum"), [*same, F.col("_part") == F.col("_p")]).drop(*[f"_{c}" for c in LEVELS], "_p")
    placed = written(placed, "parts")
    inside = Window.partitionBy(*LEVELS, "_part").orderBy("_order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where("_state = 1").withColumn("_upto", F.col("_before") + F.sum("tokens").over(inside))
    split = split.withColumn("_taken", (F.col("_upto") <= F.col("wanted")).cast("bigint"))
    others = placed.where("_state <> 1").withColumn("_taken", (F.col("_state") == 2).cast("bigint"))
    return split.drop("_upto").unionByName(others).select(
        "doc_id", *LEVELS, "tokens", (F.col("epochs") + F.col("_taken")).alias("copies"), "budget"
    )


def mixed(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """``docs`` as often as ``taken`` (see :func:`copies`) says, with their own columns, whatever their names.

    Ids that several rows share are matched by language, source and ``tokens`` too, which are counted as they
    were for ``taken``; rows equal in these are taken as often as the first of them. An empty table gives an empty one.
    """
    keys = {
        "doc_id": F.col(id_col),
        "lang": F.col("lang").cast("string"),
        "source": F.col("source").cast("string"),
        "tokens": word_tokens(F.col("text")) if tokens is None else tokens.cast("bigint"),
    }
    copies_, copy, *named = free_names(docs, "_copies", "_copy", *(f"_{k}" for k in keys))
    often = taken.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).agg(F.max("copies").alias(copies_))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(value) for n, value in zip(named, keys.values(), strict=True)])
    rows = docs.join(often.where(F.col(copies_) > 0), same).drop(*named)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_)))).drop(copy, copies_)
