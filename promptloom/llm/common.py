"""Helpers the operators share: written intermediate tables, batches, components, hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.session import new_folder

#: The longest id list that is sent to every executor instead of being joined by a shuffle.
BROADCAST_IDS = 1_000_000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until no column of ``df`` has it, whatever its case."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.

    Only a session of one local process may go without the setting: its single machine is then
    shared by all tasks. Anything else without it fails.
    """
    alone = spark.sparkContext.master.split("[")[0] == "local"
    return new_folder(spark, name, os.path.join(tempfile.gettempdir(), "promptloom") if alone else None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` to ``ids``, a written table with one row per key.

    The list of ids is counted first. Up to ``BROADCAST_IDS`` rows it goes to every executor, so
    that wide rows which are not wanted never enter a shuffle; a longer one is joined by a shuffle.
    Both ways give the same rows.
    """
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, how)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.fromiter(
            (0 if n is None else n for n in pc.binary_length(batch[column]).to_pylist()),
            dtype=np.int64,
            count=batch.num_rows,
        )
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal ``keys``, in a partition sorted by them.

    Only the rows of one key are held beyond the batch they came with.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def row(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch[k][i].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        change = np.zeros(n, dtype=bool)
        for k in keys:
            values = batch[k].to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = row(batch, a)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def worker_cache(name: str) -> dict:
    """A dictionary that the tasks of one Python worker share, one after the other."""
    holder = sys.modules.setdefault("_promptloom_worker", ModuleType("_promptloom_worker"))
    return holder.__dict__.setdefault(name, {})


def release() -> None:
    """Gives back the memory of this Python worker that is free but kept by its allocators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh() -> None:
    """Gives back the memory that earlier tasks of this Python worker have left: their tables, and what is free."""
    sys.modules.pop("_promptloom_worker", None)
    gc.collect()
    release()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node of an edge: the smallest node reachable from it.

    Alternates large-star and small-star steps until the edges no longer change: about the
    logarithm of the longest chain. Each round is one minimum by node, combined before its shuffle,
    and one join to it, which the engine can split under a hub; it is written to the shared folder.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now, before = written(ordered.distinct(), "edges"), None
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", "m"))
        now = written(small.where("u != v").distinct(), "edges")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))


# --- columns --------------------------------------------------------------------------------------

#: Values that are summed one after the other when running totals are made.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_total(values: Column) -> Column:
    """Sums of the values before each one, by blocks so that long arrays stay cheap."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            block,
            start,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all")
            ),
        )

    blocks = F.when(
        F.size(values) > 0,
        F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), lambda i: within(F.slice(values, i + 1, BLOCK))),
    ).otherwise(F.array().cast("array<struct<sum:bigint,all:array<bigint>>>"))
    return let(
        blocks,
        lambda bs: F.flatten(
            F.zip_with(bs, within(F.transform(bs, lambda b: b["sum"]))["all"], lambda b, s: F.transform(b["all"], lambda x: x + s))
        ),
    )


# --- hashes of words of a buffer of UTF-8 texts ------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts, with a 64-bit hash each.

    ``first[i]:first[i + 1]`` are the words of text i; ``start`` and ``end`` are byte positions in
    ``buffer``, where text i begins at ``text_start[i]``.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        space = _SPACE[self.buffer]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.start, self.text_start)
        ahead, back = _power_tables(len(self.buffer) + 1)
        self.sums = np.zeros(len(self.buffer) + 1, dtype=np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[self.buffer] * ahead[: len(self.buffer)], out=self.sums[1:])
        self.back = back
        self.hash = self.ranges(self.start, self.end)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range of ``buffer``."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; the last ones run over the text's end."""
        n = len(self.hash)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(min(width, n)):
            factor = mix(np.array([i + 1], dtype=np.uint64) * _BASE) | np.uint64(1)
            total[: n - i] += self.hash[i:] * factor
        return mix(total)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def crc32_text(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))
