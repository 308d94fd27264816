"""Vectors held in shards of bounded size, and blocks of queries that stream past every shard.

A shard is the unit of work and of recovery: one task holds it and reads the query blocks one after
the other, so that memory is bounded by a shard and a block however many queries there are. Nothing
is broadcast. The number of shards follows from the number of rows alone, and is never below
``LEAST_SHARDS``, so that small tables are worked on by several tasks too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import groups, written

#: Fewest shards, most rows of a shard, and rows of a block of queries.
LEAST_SHARDS, SHARD_ROWS, BLOCK_ROWS = 12, 1 << 16, 128


def usable_vector(vector: Column) -> Column:
    """The vector as doubles, or null when it is null, empty, or has null or non-finite components."""
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # minus zero becomes zero, so that equal vectors are equal bit by bit
    return F.when((F.size(v) > 0) & ~odd, F.transform(v, lambda x: x + F.lit(0.0)))


def n_shards(rows: int, most: int = SHARD_ROWS) -> int:
    return max(LEAST_SHARDS, -(-rows // most))


def dealt(rows: DataFrame, *by: str, most: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with a ``shard``, dealt evenly by the hash of ``by``; the rows are counted first."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(n_shards(rows.count(), most))).cast("int"))


def blocks(queries: DataFrame, size: str, *order: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``queries`` in blocks: the columns of up to ``rows`` rows of equal ``size`` as arrays, with a ``block`` number.

    ``order`` brings queries together that should share a block. Written, as the cuts must stay.
    """
    n = max(1, -(-queries.count() // (4 * rows)))
    kept = [c for c in queries.columns if c != size]
    schema = f"block bigint, {size} {queries.schema[size].dataType.simpleString()}, " + ", ".join(
        f"{c} array<{queries.schema[c].dataType.simpleString()}>" for c in kept
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for group in groups(batches, [size]):
            for a in range(0, group.num_rows, rows):
                part = group.slice(a, rows).combine_chunks()
                columns = [part[c].combine_chunks() for c in kept]
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), part[size].slice(0, 1).combine_chunks(), *[pa.ListArray.from_arrays(ends, c) for c in columns]],
                    ["block", size, *kept],
                )
                number += 1

    ranged = queries.repartitionByRange(n, size, *order).sortWithinPartitions(size, *order)
    return written(ranged.mapInArrow(run, schema), "blocks")


def meet(
    shards: DataFrame,
    queries: DataFrame,
    size: str,
    load: Callable[[pa.Table], object],
    answer: Callable[[object, dict], pa.RecordBatch | None],
    schema: str,
) -> DataFrame:
    """What ``answer`` returns for every block of queries in every shard that holds rows of its size.

    ``load`` makes of the rows of a shard (all of one size, in any order) what ``answer`` is given
    along with one block, as a dictionary of its columns (Arrow scalars). ``queries`` are made by :func:`blocks`.
    """
    places = shards.select(size, "shard").distinct()
    sent = queries.join(F.broadcast(places), size) if places.count() <= 1 << 16 else queries.join(places, size)
    both = shards.withColumn("block", F.lit(None).cast("bigint"))
    renamed = sent.select(size, "shard", "block", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in (size, "block")])
    both = both.unionByName(renamed, allowMissingColumns=True)
    keys = [size, "shard"]
    n = max(1, int(places.agg(F.max("shard")).first()[0] or 0) + 1)
    own = [c for c in shards.columns if c not in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        loaded, now = None, None
        for batch in batches:
            here = np.array([batch[k].to_numpy(zero_copy_only=False) for k in keys])
            change = np.flatnonzero((here[:, 1:] != here[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), tuple(here[:, a].tolist())
                if key != now:
                    held, loaded, now = [], None, key
                inside = part.filter(part["block"].is_null())
                if inside.num_rows:
                    held.append(inside)
                asked = part.filter(part["block"].is_valid())
                if asked.num_rows and loaded is None:
                    loaded, held = load(pa.Table.from_batches(held).select(keys + own)), []
                for i in range(asked.num_rows):
                    one = {c.removeprefix("q_"): asked[c][i] for c in asked.schema.names if c.startswith("q_")}
                    found = answer(loaded, one)
                    if found is not None and found.num_rows:
                        yield found

    return both.repartitionById(n, F.col("shard")).sortWithinPartitions(*keys, F.col("block").asc_nulls_first()).mapInArrow(run, schema)


def flat(values: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of ``width`` columns."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
