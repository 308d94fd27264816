"""Near-duplicate vectors by spherical-cap filters.

Filters are directions: a structured product code has a few random unit blocks for each part of the
coordinates, and every combination of blocks is a direction. A vector belongs to the cap of every
direction on which its projection exceeds a bound; the list of these directions is decoded from the
products with the blocks alone, opening only combinations that can still exceed it. Vectors that
share a filter meet, and what meets is verified by its exact cosine. A pair counts under the
smallest filter that it shares, so nothing is counted twice.

Equal vectors of a label are one vector with a multiplicity. A filter with many vectors is cut into
blocks, every two of which meet in a task of their own; a task returns counts and a spanning forest
of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import components, groups, written

#: Parts of the coordinates, random blocks for each part, and the bound in standard deviations.
PARTS, BLOCKS, BOUND = 4, 16, 3.6
#: A vector belongs to so many caps at least, its best ones.
LEAST = 20
#: Rounds of the rotation, and coordinates of a part at least.
TURNS, LEAST_WIDTH = 3, 8
#: Vectors of one filter that meet in a task come from two blocks of so many.
MOST_VECTORS = 1_024
SEED = 20


class ProductCode:
    """Directions for vectors of ``size`` components; a direction is its blocks' numbers in one."""

    def __init__(self, size: int, seed: int = SEED):
        rng = np.random.default_rng([seed, size])
        self.width = 1 << (size - 1).bit_length()
        # a part of a few coordinates would have few directions
        self.parts = max(1, min(PARTS, self.width // LEAST_WIDTH))
        self.signs = rng.choice([-1.0, 1.0], (TURNS, self.width))
        self.cuts = np.array_split(np.arange(self.width), self.parts)
        self.blocks = []
        for cut in self.cuts:
            blocks = rng.standard_normal((BLOCKS, len(cut)))
            self.blocks.append(blocks / np.linalg.norm(blocks, axis=1, keepdims=True))
        # the projection of a random unit vector on a direction deviates by 1 / sqrt(width)
        self.bound = BOUND * math.sqrt(self.parts / self.width)

    def turned(self, units: np.ndarray) -> np.ndarray:
        """Vectors under a rotation, so that no coordinate decides alone: random signs and a Hadamard transform, some times over."""
        out = np.zeros((len(units), self.width))
        out[:, : units.shape[1]] = units
        for signs in self.signs:
            out *= signs
            step = 1
            while step < self.width:
                halves = out.reshape(len(out), -1, 2, step)
                out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(out), -1)
                step *= 2
        return out / math.sqrt(self.width) ** TURNS

    def lists(self, units: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the directions whose cap holds it, ascending."""
        return [found for i in range(0, len(units), 128) for found in self._lists(units[i : i + 128])]

    def _lists(self, units: np.ndarray) -> list[np.ndarray]:
        turned = self.turned(units)
        products = [turned[:, cut] @ b.T for cut, b in zip(self.cuts, self.blocks, strict=True)]
        # the LEAST-th best direction made of the best blocks of each part
        best = np.zeros((len(units), 1))
        for p in products:
            top = np.sort(p, axis=1)[:, -4:]
            best = (best[:, :, None] + top[:, None, :]).reshape(len(units), -1)
        best.sort(axis=1)
        bound = np.minimum(self.bound, best[:, -min(LEAST, best.shape[1])])
        rest = np.cumsum([p.max(axis=1) for p in products[::-1]], axis=0)[::-1]
        who, code = np.arange(len(units)), np.zeros(len(units), dtype=np.int64)
        so_far = np.zeros(len(units))
        for depth, product in enumerate(products):
            reach = so_far[:, None] + product[who]
            best_rest = rest[depth + 1] if depth + 1 < self.parts else np.zeros(len(units))
            row, block = np.nonzero(reach >= (bound - 1e-12 - best_rest)[who][:, None])
            so_far, who, code = reach[row, block], who[row], code[row] * BLOCKS + block
        order = np.lexsort((code, who))
        ends = np.searchsorted(who[order], np.arange(len(units) + 1))
        return [code[order][a:b] for a, b in zip(ends, ends[1:], strict=False)]


CODED = "vec_id bigint, label string, digest binary, vector binary, filters array<bigint>"


def coded(vectors: DataFrame) -> DataFrame:
    """``vectors`` (``vec_id``, ``label``, ``vector`` as doubles) with digest and filters.

    Vectors that link with nothing have no digest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            n = batch.num_rows
            lists: list[list[int] | None] = [None] * n
            raw: list[bytes | None] = [None] * n
            known = [i is not None and x is not None for i, x in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), strict=True)]
            by_size: dict[int, list[int]] = {}
            values = [None if v is None else np.array(v, dtype=np.float64) + 0.0 for v in batch["vector"].to_pylist()]
            for i, v in enumerate(values):
                if known[i] and v is not None and len(v) and np.isfinite(v).all() and v.any():
                    by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                code = codes.setdefault(size, ProductCode(size))
                matrix = np.array([values[i] for i in rows])
                # scaled first, so that squares neither vanish nor overflow
                units = matrix / np.abs(matrix).max(axis=1, keepdims=True)
                units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
                for i, unit, found in zip(rows, units, code.lists(units), strict=True):
                    raw[i], lists[i] = unit.tobytes(), found.tolist()
            digests = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"], batch["label"], pa.array(digests, pa.binary()), pa.array(raw, pa.binary()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                ["vec_id", "label", "digest", "vector", "filters"],
            )

    return vectors.mapInArrow(run, CODED)


FOUND = "a bigint, b bigint, n bigint"


def _meet(
    ids: np.ndarray, units: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], at: int, cross: np.ndarray | None, cosine: float
) -> list[tuple[int, int | None, int | None]]:
    """Link counts ``(vector, None, n)`` of vectors under a filter, and ``(a, b, None)`` for each linked one with
    the first that its links reach."""
    linked = np.einsum("id,jd->ij", units, units) >= cosine if len(units) < 8 else (units @ units.T) >= cosine
    linked[np.tril_indices(len(units))] = False
    if cross is not None:
        linked &= cross[:, None] != cross[None, :]
    a, b = np.nonzero(linked)
    if not len(a):
        return []
    # pairs that share a smaller filter are counted there: filters are bits of a row for each vector
    names, where = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    earlier = names[where] < at
    bits = np.zeros((len(units), len(names) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner[earlier], where[earlier] // 64), np.uint64(1) << (where[earlier] % 64).astype(np.uint64))
    first = np.concatenate(
        [~(bits[a[i : i + 65536]] & bits[b[i : i + 65536]]).any(axis=1) for i in range(0, len(a), 65536)]
    )
    a, b = a[first], b[first]
    if not len(a):
        return []
    count = np.bincount(a, copies[b], minlength=len(ids)) + np.bincount(b, copies[a], minlength=len(ids))
    out: list[tuple[int, int | None, int | None]] = [(int(ids[i]), None, int(count[i])) for i in np.flatnonzero(count)]
    # each vector takes the smallest number among its links until none changes
    group = np.arange(len(ids))
    while True:
        least = group.copy()
        np.minimum.at(least, a, group[b])
        np.minimum.at(least, b, group[a])
        least = least[least]
        if (least == group).all():
            return out + [(int(ids[i]), int(ids[group[i]]), None) for i in np.flatnonzero(group != np.arange(len(ids)))]
        group = least


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``cosine``; vectors of different size never do. Null vectors, vectors of
    zeros, with null or non-finite components, and rows without id or label link with nothing.
    ``n_links`` counts the other rows linked directly, equal ones included; ``component_id`` is the
    smallest id that links reach; ``kept`` marks the row whose id that is. Rows that share an id are
    counted each, and kept alike. Links are found with high probability, not for certain, and every
    one found is verified. An empty table gives an empty one.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = rows.withColumn("vector", F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector")))
    rows = written(coded(rows), "coded")
    usable = rows.where("digest IS NOT NULL")
    same = ["label", "digest"]
    reps = usable.groupBy(*same).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"),
        F.first("filters").alias("filters"),
    )
    reps = written(reps, "reps")

    # where vectors meet is settled on their numbers; the vectors themselves are shuffled once
    met = reps.select("label", "rep", F.length("vector").alias("size"), F.explode("filters").alias("filter"))
    key = ["label", "size", "filter"]
    n = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = written(n.select(*key, F.ceil(F.col("n") / MOST_VECTORS).cast("int").alias("blocks")), "filters")
    met = met.join(n, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks")
    met = met.join(reps.select("label", "rep", F.length("vector").alias("size"), "copies", "vector", "filters"), ["label", "rep", "size"])
    key = [*key, "one", "two"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int | None, int | None]] = []
        for group in groups(batches, key):
            if group.num_rows < 2:
                continue
            cross = group["one"][0].as_py() != group["two"][0].as_py()
            out += _meet(
                group["rep"].to_numpy(),
                np.array([np.frombuffer(v) for v in group["vector"].to_pylist()]),
                group["copies"].to_numpy().astype(np.float64),
                [np.array(x, dtype=np.int64) for x in group["filters"].to_pylist()],
                group["filter"][0].as_py(),
                group["block"].to_numpy() if cross else None,
                cosine,
            )
            if len(out) > 10_000:
                yield _found_batch(out)
                out = []
        if out:
            yield _found_batch(out)

    found = written(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, FOUND), "found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "component")
    told = reps.select(*same, "rep", "copies").join(links, "rep", "left").join(named, "rep", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    return (
        rows.select("vec_id", *same)
        .join(told, same, "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _found_batch(out: list[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])
