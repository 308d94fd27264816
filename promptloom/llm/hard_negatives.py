"""Hard negatives by exact integer scores, with subset sums of the anchors looked up by bit planes.

The score of an anchor and a candidate is the inner product of their integer vectors. A candidate is
indexed by its bit planes: bit ``j`` of eight neighbouring dimensions is one byte. For an anchor
and a group of eight dimensions a table holds the sum of the anchor's components over each of
the 256 subsets, so a plane's share of the score is one look-up for each group, and the score is
made of the planes from the highest on by doubling and adding; the highest plane is the sign and
counts negatively. Tables are made for a block of anchors at a time, and a look-up fetches the
sums of all of them.

Blocks of anchors pass every shard of candidates twice: first for the best rows of their own label
(the positives), then for the best rows of other labels within the score range that each positive
sets. A task returns no more than the rows asked for, of each anchor; the best of all shards are
taken by a window that is limited before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import written
from promptloom.llm.shards import blocks, dealt, flat, meet, usable_vector

#: Candidates that are scored at a time.
CHUNK = 2_048


# --- bit planes and subset sums ------------------------------------------------------------------------


def limit(size: int) -> int:
    """Components are taken as if they did not pass this, so that no score passes 64 bits."""
    return math.isqrt((1 << 62) // max(size, 1))


def planes(values: np.ndarray) -> np.ndarray:
    """Two's complement bits of integer rows, as bytes ``(plane, group of eight dimensions, row)``, sign first."""
    n = 1 + max(int(values.max(initial=0)).bit_length(), int(-1 - values.min(initial=0)).bit_length())
    bits = [np.packbits((values >> j) & 1, axis=1, bitorder="little").T for j in range(n - 1, -1, -1)]
    return np.ascontiguousarray(np.array(bits, dtype=np.uint8))


def widened(packed: np.ndarray, n: int) -> np.ndarray:
    """The same numbers with ``n`` planes: the sign is repeated."""
    return np.concatenate([np.repeat(packed[:1], n - len(packed), axis=0), packed])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``(group, 256, anchor)``: sums of each anchor's components over every subset of eight dimensions."""
    n, size = anchors.shape
    padded = np.zeros((n, -(-size // 8) * 8), dtype=np.int64)
    padded[:, :size] = anchors
    parts = padded.T.reshape(-1, 8, n)
    sums = np.zeros((len(parts), 256, n), dtype=np.int64)
    for bit in range(8):
        # each table is doubled: the subsets with this dimension are those without it, and its value
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + parts[:, bit : bit + 1]
    return sums


def tables(anchors: np.ndarray, n_planes: int) -> np.ndarray:
    """Subset sums in the smallest type that no score of ``n_planes`` bits passes."""
    most = int(np.abs(anchors).sum(axis=1, dtype=np.float64).max(initial=0)) + 1
    return subset_sums(anchors).astype(np.int32 if most << n_planes < 1 << 31 else np.int64)


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """``(candidate, anchor)`` inner products of packed candidates ``(plane, group, candidate)``."""
    total = np.zeros((packed.shape[2], sums.shape[2]), dtype=sums.dtype)
    looked = np.empty_like(total)
    for j, plane in enumerate(packed):
        if j == 1:
            np.negative(total, out=total)
        if j:
            total += total
        for table, at in zip(sums, plane, strict=True):
            np.take(table, at, axis=0, out=looked, mode="clip")
            total += looked
    return -total if len(packed) == 1 else total


class _Best:
    """The best ``most`` candidates of each of ``n`` questions: highest score, then smallest place."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.who = self.place = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        #: What a score must exceed to be among the best; places come in ascending order.
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, who: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        if not len(who):
            return
        who, score, place = (np.concatenate(x) for x in ((self.who, who), (self.score, score.astype(np.int64)), (self.place, place)))
        order = np.lexsort((place, -score, who))
        who, score, place = who[order], score[order], place[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        last = nth == self.most - 1
        self.floor[who[last]] = score[last]
        keep = nth < self.most
        self.who, self.score, self.place = who[keep], score[keep], place[keep]


# --- shards --------------------------------------------------------------------------------------------


class _Shard:
    """Candidates of a shard by label, then place; places follow ``(vec_id, twin)``."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids, self.twins, labels = (rows[c].to_numpy() for c in ("vec_id", "twin", "label"))
        order = np.lexsort((self.twins, self.ids, labels))
        self.ids, self.twins, self.labels = self.ids[order], self.twins[order], labels[order]
        groups_ = -(-rows["size"][0].as_py() // 8)
        n_planes = rows["n_planes"].to_numpy()
        self.n_planes = int(n_planes.max())
        self.packed = np.zeros((self.n_planes, groups_, len(order)), dtype=np.uint8)
        raw = rows["packed"].to_pylist()
        for n in np.unique(n_planes).tolist():
            some = np.flatnonzero(n_planes[order] == n)
            own = np.frombuffer(b"".join(raw[i] for i in order[some].tolist()), dtype=np.uint8)
            self.packed[:, :, some] = widened(own.reshape(-1, n, groups_).transpose(1, 2, 0), self.n_planes)

    def of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


CODED = "vec_id bigint, twin bigint, label bigint, size int, n_planes int, packed binary, ints array<bigint>"


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (``vec_id``, ``twin``, ``label``, ``ints``) with their bit planes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["ints"].offsets.to_numpy())
            packed: list[bytes | None] = [None] * batch.num_rows
            n_planes = np.zeros(batch.num_rows, dtype=np.int32)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                found = planes(flat(batch["ints"].take(pa.array(at)), size))
                n_planes[at] = len(found)
                for i, own in zip(at.tolist(), found.transpose(2, 0, 1), strict=True):
                    packed[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["twin"], batch["label"], pa.array(sizes, pa.int32()), pa.array(n_planes), pa.array(packed, pa.binary()), batch["ints"]],
                ["vec_id", "twin", "label", "size", "n_planes", "packed", "ints"],
            )

    return rows.mapInArrow(run, CODED)


def _matrix(vectors: pa.Scalar) -> np.ndarray:
    return flat(vectors.values, len(vectors.values[0]))


def _positives(shards: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """``(vec_id, twin, positive_id, rank, score)``: the best ``most`` rows of each anchor's own label."""
    schema = "vec_id bigint, twin bigint, positive_id bigint, other bigint, score bigint"

    def answer(shard: _Shard, block: dict) -> pa.RecordBatch | None:
        ids, twins, labels = (np.array(block[c].as_py()) for c in ("vec_id", "twin", "label"))
        ints = _matrix(block["ints"])
        best = _Best(len(ids), most)
        for label in np.unique(labels).tolist():
            own, (a, b) = np.flatnonzero(labels == label), shard.of(label)
            if a == b:
                continue
            sums = tables(ints[own], shard.n_planes)
            for x in range(a, b, CHUNK):
                y = min(x + CHUNK, b)
                found = scores(sums, shard.packed[:, :, x:y])
                least = np.iinfo(found.dtype).min
                found[shard.ids[x:y, None] == ids[own][None, :]] = least
                floor = np.maximum(best.floor[own], least + 1)
                if y - x > 2 * most:
                    floor = np.maximum(np.partition(found, y - x - most, axis=0)[y - x - most], floor)
                row, col = np.nonzero(found >= floor.astype(found.dtype)[None, :])
                best.add(own[col], found[row, col], row + x)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (ids[best.who], twins[best.who], shard.ids[best.place], shard.twins[best.place], best.score)],
            ["vec_id", "twin", "positive_id", "other", "score"],
        )

    asked = blocks(anchors.select("size", "vec_id", "twin", "label", "ints"), "size", "label", "vec_id", "twin")
    found = meet(shards, asked, "size", _Shard, answer, schema)
    first = Window.partitionBy("vec_id", "twin").orderBy(F.desc("score"), "positive_id", "other")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("other")


def _negatives(shards: DataFrame, anchors: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """``(vec_id, twin, nth, negative_id, rank, score)``: the best ``most`` rows of other labels for each positive.

    ``anchors`` has ``positive``, the scores of an anchor's positives.
    """
    schema = "vec_id bigint, twin bigint, nth int, negative_id bigint, other bigint, score bigint"

    def answer(shard: _Shard, block: dict) -> pa.RecordBatch | None:
        ids, twins, labels = (np.array(block[c].as_py()) for c in ("vec_id", "twin", "label"))
        given = block["positive"].as_py()
        # scores between these two, rounded inwards, whatever the sign of the positive's
        least = np.array([p[i] if i < len(p) else 0 for i in range(max(map(len, given))) for p in given], dtype=object)
        none = np.array([i >= len(p) for i in range(max(map(len, given))) for p in given])
        top = np.array([int(p) * high // 100 for p in least], dtype=np.int64)
        least = np.array([-(-int(p) * low // 100) for p in least], dtype=np.int64)
        least[none], top[none] = 1, 0
        n = len(ids)
        best = _Best(len(least), most)
        sums = tables(_matrix(block["ints"]), shard.n_planes)
        span = np.iinfo(sums.dtype)
        for x in range(0, len(shard.ids), CHUNK):
            found = scores(sums, shard.packed[:, :, x : x + CHUNK])
            other = (shard.labels[x : x + CHUNK, None] != labels[None, :]) & (shard.ids[x : x + CHUNK, None] != ids[None, :])
            for at in range(0, len(least), n):
                part = slice(at, at + n)
                # rows are not in the order of their ids here, so equal scores go on to be compared
                floor, roof = (
                    np.clip(x, span.min, span.max).astype(sums.dtype)[None, :]
                    for x in (np.maximum(best.floor[part], least[part]), top[part])
                )
                row, col = np.nonzero(other & (found >= floor) & (found <= roof))
                inside = (least[part][col] <= found[row, col]) & (found[row, col] <= top[part][col])
                row, col = row[inside], col[inside]
                best.add(at + col, found[row, col], shard.place[row + x])
        who = best.who % n
        back = shard.back[best.place]
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array(c, pa.int64()) for c in (ids[who], twins[who])], pa.array(best.who // n, pa.int32()),
                *[pa.array(c, pa.int64()) for c in (shard.ids[back], shard.twins[back], best.score)],
            ],
            ["vec_id", "twin", "nth", "negative_id", "other", "score"],
        )

    def load(rows: pa.Table) -> _Shard:
        shard = _Shard(rows)
        # place of each row in the order of ids, and back
        shard.back = np.lexsort((shard.twins, shard.ids))
        shard.place = np.argsort(shard.back)
        return shard

    asked = blocks(anchors.select("size", "vec_id", "twin", "label", "ints", "positive"), "size", "vec_id", "twin")
    found = meet(shards, asked, "size", load, answer, schema)
    first = Window.partitionBy("vec_id", "twin", "nth").orderBy(F.desc("score"), "negative_id", "other")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("other")


def mine(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component ``x`` counts as ``floor(scale * x)`` in double precision, and a score is the inner
    product of these integers, exactly. Rows that satisfy ``is_anchor``, an SQL condition on ``vec_id`` and ``label``,
    are anchors; their positives are the first ``positives`` other rows of their label, by falling
    score, then id. For each positive the first ``negatives`` rows of other labels are returned
    whose score lies between ``low`` and ``high`` hundredths of the positive's (a positive of negative
    score has none). Fewer are returned where there are fewer.

    Rows with a null label or id, and with vectors that are null, empty or have null or non-finite
    components, take no part; vectors of different size never meet. Equal rows (id, label and integers)
    count once; other rows of one id are rows of their own, none of which meets another, and
    ties between them go by a digest. Integers saturate where scores could pass 64 bits
    (``limit``). Other columns are not read. An empty table gives an empty one.
    """
    v = usable_vector(F.col(vector_col))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size("v"))).cast("double")
    ints = F.transform("v", lambda x: F.floor(F.greatest(-most, F.least(most, x * F.lit(scale)))))
    rows = rows.select("vec_id", "label", ints.alias("ints")).withColumn("twin", F.xxhash64("label", "ints"))
    rows = rows.select("vec_id", "twin", "label", "ints").dropDuplicates(["vec_id", "twin"])
    rows = written(coded(rows), "coded")
    shards = dealt(rows.drop("ints"), "vec_id", "twin")
    anchors = rows.where(is_anchor).select("vec_id", "twin", "label", "size", "ints")

    found = written(_positives(shards, anchors, positives), "positives")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score")))
    listed = found.groupBy("vec_id", "twin").agg(ordered.alias("all"))
    listed = written(listed.join(anchors, ["vec_id", "twin"]), "listed")
    worse = _negatives(shards, listed.withColumn("positive", F.col("all.score")), negatives, low, high)
    return worse.join(listed.select("vec_id", "twin", "all"), ["vec_id", "twin"]).select(
        F.col("vec_id").alias("anchor_id"),
        F.get("all.positive_id", "nth").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.get("all.score", "nth").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
