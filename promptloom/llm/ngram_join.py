"""Exact Jaccard join of word n-gram sets by a count-vector R-tree.

A document's set holds the 64-bit hashes of its distinct word n-grams. The hashes fall into
groups, at least ``GROUPS`` and more for larger sets, and how many fall into each makes the document a
point. Two sets share at most
the sum of the smaller coordinates of their points, so a tree whose nodes know their largest
coordinates and their sizes prunes most pairs of nodes; the pairs of points that are left are
verified on the sets.

Trees are built where linked documents must meet. Taken in order of hash, two sets that reach the
similarity share one of their first ``n - ceil(percent * n / 100) + 1`` elements, for the smallest
common element cannot come later. Work goes in two rounds, since only components are asked for:

1. Documents with the same smallest hash meet, which finds most links; then those with the same
   smallest hash under a few other orders, where they are not yet of one component, so that large groups of near copies
   become one. Groups too large for a task are cut, as the next round makes up for it.
2. Of all first elements only those remain under which documents of different components still
   meet, and of elements under which the same documents meet the first alone. Large groups are cut into
   blocks, every pair of which meets. Pairs within a component cannot change the result and are not
   looked at, nor are those that have met under one of the few elements before. Of the pairs between two
   components the most promising are verified first, and the others where the two are still apart; a
   document's set goes once to each place where pairs of a component are verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import Words, components, fresh, groups, keep_ids, mix, slices, text_bytes, written

#: Least number of groups of hashes, and elements of a set for each group (both powers of two).
GROUPS, BY_GROUP = 64, 16
#: Children of a node of the tree, and coordinates that are compared at a time.
FANOUT, CELLS = 16, 1 << 21
#: Bytes of texts that are hashed at a time.
HASHED = 1 << 20
#: What meets in one task: documents with their sets, elements of these sets, and points.
MOST_TEXTS, MOST_ELEMENTS, MOST_POINTS = 4_000, 1_000_000, 4_096
#: Groups of so many documents at most are compared without a tree, which would prune nothing.
SMALL = 32
#: Bytes of points that meet in one task.
MOST_BYTES = 1 << 24
#: Other orders of the hashes whose smallest elements bring documents together.
ORDERS = 2
#: Pairs of two components that are verified first, and elements in the pairs that are verified in one place.
FIRST_PAIRS, MOST_VERIFIED = 2, 4_000_000
#: Elements before one under which a document met others that are known there.
PRIOR = 4


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; a shorter text is one."""
    sizes = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // HASHED)) + 1).tolist(), len(texts)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) if b > a for s in _shingle_sets(texts[a:b], width)]


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words = Words(texts, lower=True)
    hashes = words.windows(width)
    sets = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= width:
            sets.append(np.unique(hashes[a : b - width + 1]))
        elif b > a:
            whole = hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(whole, dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def point(elements: np.ndarray) -> np.ndarray:
    """Counts by the leading bits of the elements' mixed hashes."""
    bits = max((GROUPS - 1).bit_length(), (len(elements) // BY_GROUP).bit_length())
    return np.bincount((mix(elements) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def folded(points: list[np.ndarray], groups_: int) -> np.ndarray:
    """Points as rows of ``groups_`` coordinates, neighbouring groups added up."""
    return np.array([p.reshape(groups_, -1).sum(axis=1) for p in points], dtype=np.int32).reshape(-1, groups_)


def smallest(elements: np.ndarray) -> list[int]:
    """The smallest element in each of ``ORDERS`` other orders of the hashes."""
    if not len(elements):
        return []
    return [int(elements[mix(elements ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).argmin()].view(np.int64)) for k in range(1, ORDERS + 1)]


POINTS = "doc_id bigint, n_shingles bigint, sig binary, point binary, firsts array<bigint>, smallest array<bigint>"


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document (``doc_id``, ``text``): set size, set digest, point, first elements."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, "text"):
            sets = shingle_sets(text_bytes(batch["text"]), width)
            firsts = [s[: len(s) - (percent * len(s) + 99) // 100 + 1] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([point(s).tobytes() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32),
                        np.concatenate(firsts).view(np.int64),
                    ),
                    pa.array([smallest(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "sig", "point", "firsts", "smallest"],
            )

    return docs.mapInArrow(run, POINTS)


# --- the tree, inside a task -------------------------------------------------------------------------


class _Level:
    """Nodes of one level: largest coordinates, smallest and largest set size."""

    def __init__(self, high: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.high, self.least, self.most = high, least, most

    def above(self) -> _Level:
        cuts = np.arange(0, len(self.least), FANOUT)
        return _Level(
            np.maximum.reduceat(self.high, cuts, axis=0),
            np.minimum.reduceat(self.least, cuts),
            np.maximum.reduceat(self.most, cuts),
        )

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether some set below a and some set below b can reach the similarity, and how much they can share."""
        near = (100 * self.most[a] >= percent * self.least[b]) & (100 * self.most[b] >= percent * self.least[a])
        shared = np.zeros(len(a), dtype=np.int64)
        shared[near] = np.minimum(self.high[a[near]], self.high[b[near]]).sum(axis=1)
        return near & ((100 + percent) * shared >= percent * (self.least[a] + self.least[b])), shared


def near_pairs(points: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of pairs (as positions) that the bound does not exclude, each pair once, with how much they can share.

    Sets that can be similar differ in size by the factor ``100 / percent`` at most, so points of one number of
    groups meet each other and those of so many times as many.
    """
    number = np.array([len(p) for p in points])
    steps = max(1, math.ceil(math.log2(100 / percent)))
    for groups_ in np.unique(number).tolist():
        here = np.flatnonzero((number >= groups_) & (number <= groups_ << steps))
        for a, b, shared in _near(folded([points[i] for i in here.tolist()], groups_), sizes[here], percent):
            a, b = here[a], here[b]
            own = (number[a] == groups_) | (number[b] == groups_)
            if own.any():
                yield a[own], b[own], shared[own]


def near_points(high: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of pairs of points (as positions) that the bound does not exclude, each pair once."""
    for a, b, _ in _near(high, sizes, percent):
        yield a, b


def _near(high: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order = np.lexsort((*high.T[:4], sizes))
    levels = [_Level(high[order], sizes[order], sizes[order])]
    while len(levels[-1].least) > FANOUT:
        levels.append(levels[-1].above())
    a, b = np.triu_indices(len(levels[-1].least))
    open_pairs = [(len(levels) - 1, a, b)]
    most = max(1, CELLS // (FANOUT * FANOUT * high.shape[1]))
    while open_pairs:
        depth, a, b = open_pairs.pop()
        at_once = most if depth else most * FANOUT * FANOUT
        if len(a) > at_once:
            open_pairs.append((depth, a[at_once:], b[at_once:]))
            a, b = a[:at_once], b[:at_once]
        keep, shared = levels[depth].may_link(a, b, percent)
        keep &= (a < b) if depth == 0 else True
        a, b = a[keep], b[keep]
        if depth == 0:
            if len(a):
                yield order[a], order[b], shared[keep]
            continue
        step, n = np.arange(FANOUT), len(levels[depth - 1].least)
        x = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
        y = np.tile(b[:, None] * FANOUT + step, FANOUT).ravel()
        inside = (x < n) & (y < n) & (x <= y)
        if inside.any():
            open_pairs.append((depth - 1, x[inside], y[inside]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared) and shared > 0


def spanning_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Verified links (as positions) that connect whatever the sets' links connect; ``known`` tells which are connected already."""
    group = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    for a, b, _ in near_pairs([point(s) for s in sets], sizes, percent):
        apart = group[a] != group[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if group[i] != group[j] and similar(sets[i], sets[j], percent):
                group[group == group[j]] = group[i]
                yield i, j


EDGES = "a bigint, b bigint"


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# --- the two rounds ----------------------------------------------------------------------------------


def _first_round(
    texts: DataFrame, heads: DataFrame, width: int, percent: int, key: Column
) -> tuple[DataFrame | None, bool]:
    """Links between components with documents of the same ``key`` (None without such groups), and whether a group had to be cut."""
    keyed = heads.select(F.col("rep").alias("doc_id"), key.alias("key"), "n_shingles", "component")
    shared = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("elements"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    parts = F.ceil(F.greatest(F.col("n") / MOST_TEXTS, F.col("elements") / MOST_ELEMENTS))
    shared = shared.where("low < high").select("key", parts.alias("parts"))
    members = written(
        keyed.join(shared, "key").select(
            "doc_id", "key", "component", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part")
        ),
        "smallest",
    )
    most = members.agg(F.max("parts")).first()[0]
    if most is None:
        return None, False

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for group in groups(batches, ["key", "part"]):
            of = group["component"].to_numpy()
            if of.min() < of.max():
                sets = shingle_sets(text_bytes(group["text"].combine_chunks()), width)
                yield _pairs_batch([(int(of[i]), int(of[j])) for i, j in spanning_links(sets, percent, of)])

    rows = keep_ids(texts, members, "doc_id").select("key", "part", "component", "text")
    links = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, EDGES)
    return written(links, "links"), bool(most > 1)


CANDIDATES = "a bigint, b bigint, one bigint, two bigint, margin int, size bigint"


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of a sorted partition's rows that hold whole groups of equal ``keys``, with the positions where groups begin, and the end."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([v[1:] != v[:-1] for v in values], axis=0)
        starts = np.flatnonzero(change) + 1
        first = tuple(v[0] for v in values)
        if held and first != last:
            starts = np.concatenate([[0], starts])
        if len(starts):
            # all up to the batch's last group is whole
            end = int(starts[-1])
            table = pa.Table.from_batches([*held, batch.slice(0, end)])
            before = table.num_rows - end
            cuts = np.unique(np.concatenate([[0], starts + before]))
            yield _combined(table), cuts
            held = [batch.slice(end)]
        else:
            held.append(batch)
        last = tuple(v[-1] for v in values)
    if held:
        table = pa.Table.from_batches(held)
        yield _combined(table), np.array([0, table.num_rows])


def _combined(table: pa.Table) -> pa.Table:
    return table.combine_chunks()


class _Met:
    """Documents of several groups that meet in a task."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows[c].to_numpy()
        self.reps, self.part, self.n = column("rep"), column("component"), column("n_shingles")
        self.after = self.n - column("before")
        self.block, self.cross = column("block"), column("x") != column("y")
        self.prior = np.stack([column(f"prior{i}") for i in range(PRIOR)], axis=1)
        self.points = [np.frombuffer(p, dtype=np.uint16) for p in rows["point"].to_pylist()]
        self.width = np.array([len(p) for p in self.points])
        # points of one number of groups as a matrix each
        self.row = np.zeros(len(self.points), dtype=np.int64)
        self.matrix: dict[int, np.ndarray] = {}

    def open(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of different components, counted in this place, that under their smallest common element have enough left."""
        needed = percent * (self.n[a] + self.n[b])
        left = (100 + percent) * np.minimum(self.after[a], self.after[b])
        least, most = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        here = (self.block[a] != self.block[b]) | ~self.cross[a]
        keep = (self.part[a] != self.part[b]) & here & (left >= needed) & (100 * least >= percent * most)
        keep[keep] = ~self.met_before(a[keep], b[keep])
        return keep

    def met_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that have met under an element before this one; of two that share any, only the first one is sure to be new."""
        met = np.zeros(len(a), dtype=bool)
        for i in range(PRIOR):
            mine = self.prior[a, i]
            for j in range(PRIOR):
                met |= (mine != 0) & (mine == self.prior[b, j])
        return met

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most elements that the sets of each pair can share: summed minima of their points."""
        out = np.zeros(len(a), dtype=np.int64)
        swap = self.width[a] > self.width[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        kinds = self.width[a] * (1 << 32) + self.width[b]
        for kind in np.unique(kinds).tolist():
            narrow, wide = kind >> 32, kind & ((1 << 32) - 1)
            at = np.flatnonzero(kinds == kind)
            some = max(1, CELLS // wide)
            for i in range(0, len(at), some):
                part = at[i : i + some]
                x, y = self._matrix(narrow)[self.row[a[part]]], self._matrix(wide)[self.row[b[part]]]
                if wide > narrow:
                    y = y.reshape(len(part), narrow, -1).sum(axis=2)
                out[part] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        return out

    def _matrix(self, width: int) -> np.ndarray:
        if width not in self.matrix:
            at = np.flatnonzero(self.width == width)
            self.row[at] = np.arange(len(at))
            self.matrix[width] = np.array([self.points[i] for i in at.tolist()])
        return self.matrix[width]

    def pairs_within(self, starts: np.ndarray, ends: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of all these small groups, the rows of all groups at one distance from each other at a time."""
        sizes = ends - starts
        inside = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = np.repeat(ends, sizes)
        for apart in range(1, int(sizes.max(initial=0))):
            go = inside + apart < end
            inside, end = inside[go], end[go]
            a, b = inside, inside + apart
            keep = self.open(a, b, percent)
            if keep.any():
                a, b = a[keep], b[keep]
                yield a, b, self.shared(a, b)

    def tree_pairs(self, start: int, end: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of one large group, by the tree."""
        if self.part[start:end].min() < self.part[start:end].max():
            for a, b, shared in near_pairs(self.points[start:end], self.n[start:end], percent):
                yield a + start, b + start, shared

    def batch(self, a: np.ndarray, b: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
        swap = self.part[a] > self.part[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        columns = [self.reps[a], self.reps[b], self.part[a], self.part[b]]
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array(c, pa.int64()) for c in columns],
                pa.array(np.minimum(margin, 2**31 - 1), pa.int32()),
                pa.array(self.n[a] + self.n[b], pa.int64()),
            ],
            ["a", "b", "one", "two", "margin", "size"],
        )


def _candidates(unique: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of different components that the bound does not exclude, ``a`` of ``one`` and ``b`` of ``two``; None without any.

    ``margin`` is how far the bound exceeds what the similarity needs, in hundredths of an element; ``size`` is
    how many elements the two sets hold together.
    """
    elements = unique.select("who", "component", F.explode("firsts").alias("key"), F.length("point").alias("bytes"))
    mixed = elements.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.bit_xor("who").alias("all"),
    )
    blocks = F.ceil(F.greatest(F.col("n") / MOST_POINTS, F.col("bytes") / MOST_BYTES)).cast("int")
    # of keys of the same documents the first is enough; hashes have no sign, so the sign's bit is turned
    sign = F.shiftleft(F.lit(1).cast("bigint"), 63)
    mixed = mixed.where("low < high").groupBy("all", "n", "bytes", "low", "high").agg(F.min(F.col("key").bitwiseXOR(sign)).alias("key"))
    mixed = written(mixed.select(F.col("key").bitwiseXOR(sign).alias("key"), blocks.alias("blocks")), "mixed")
    if mixed.limit(1).count() == 0:
        return None
    met = keep_ids(unique.select("who", F.posexplode("firsts").alias("before", "key")), mixed, "key")
    earlier = Window.partitionBy("who").orderBy("before")
    prior = [F.lag("key", i + 1, 0).over(earlier).alias(f"prior{i}") for i in range(PRIOR)]
    met = met.select("who", "before", "key", "blocks", *prior)
    # every two blocks of a key meet in one place: the row goes to each pair that its block is in
    met = met.withColumn("block", F.pmod(F.xxhash64("who"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "who", "before",
        *[f"prior{i}" for i in range(PRIOR)],
    )
    met = met.join(unique.select("who", "rep", "component", "n_shingles", "point"), "who").drop("who")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for rows, cuts in whole_groups(batches, ["key", "x", "y"]):
            met_rows = _Met(rows)
            small = np.diff(cuts) <= SMALL
            found = [met_rows.pairs_within(cuts[:-1][small], cuts[1:][small], percent)]
            for i, j in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist(), strict=True):
                found.append(met_rows.tree_pairs(i, j, percent))
            for a, b, shared in (f for one in found for f in one):
                keep, margin = met_rows.open(a, b, percent), shared * (100 + percent) - percent * (met_rows.n[a] + met_rows.n[b])
                keep &= margin >= 0
                if keep.any():
                    yield met_rows.batch(a[keep], b[keep], margin[keep])

    rows = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, CANDIDATES)
    # a pair that shares several elements can still come from some of their groups
    return written(rows.groupBy("a", "b", "one", "two").agg(F.max("margin").alias("margin"), F.max("size").alias("size")), "pairs")


#: What is verified in one place: documents of one component and of others near it.
CELL = ["hub", "x", "y"]


def _verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of which a pair (``doc`` of ``hub``, ``other`` of ``outer``) is linked, decided on the sets of their texts."""
    wanted = written(pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("other")).distinct(), "wanted")

    def as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(text_bytes(batch["text"]), width)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "set"])

    sets = written(keep_ids(texts, wanted, "doc_id").mapInArrow(as_sets, "doc_id bigint, set binary"), "sets")
    # a document comes once, with the others that it is compared with there
    other = F.struct("other", "outer")
    sides = pairs.select(*CELL, F.col("doc").alias("doc_id"), other.alias("other")).union(
        pairs.select(*CELL, F.col("other"), F.lit(None).cast("struct<other:bigint,outer:bigint>"))
    )
    members = sides.groupBy(*CELL, "doc_id").agg(F.collect_list("other").alias("others")).join(sets, "doc_id")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for group in groups(batches, CELL):
            of: dict[int, list[np.ndarray]] = {}  # rows that share an id have a set each
            met: dict[tuple[int, int], int] = {}
            for doc, others, s in zip(*(group[c].to_pylist() for c in ("doc_id", "others", "set")), strict=True):
                of.setdefault(doc, []).append(np.frombuffer(s, dtype=np.uint64))
                met |= {(doc, o["other"]): o["outer"] for o in others}
            linked: set[int] = set()
            for (doc, other), outer in met.items():
                if outer not in linked and any(similar(p, q, percent) for p in of[doc] for q in of.get(other, [])):
                    linked.add(outer)
            if linked:
                hub = group["hub"][0].as_py()
                yield _pairs_batch([(hub, outer) for outer in sorted(linked)])

    rows = members.select(*CELL, "doc_id", "others", "set").repartition(*CELL).sortWithinPartitions(*CELL)
    return written(rows.mapInArrow(verify, EDGES), "links")


def _placed(pairs: DataFrame) -> DataFrame:
    """Pairs (``doc`` of ``hub``, ``other`` of ``outer``) with the place where they are verified.

    The hub is the component that has more pairs, so that its documents go to few places; the pairs of a hub
    are dealt out over a square of places, none with more than about ``MOST_VERIFIED`` elements in its pairs.
    """
    near = pairs.select("size", F.explode(F.array("one", "two")).alias("component"))
    near = written(near.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")), "near")
    for side in ("one", "two"):
        pairs = pairs.join(near.select(*[F.col(c).alias(side if c == "component" else f"{c}_{side}") for c in near.columns]), side)
    first = F.col("n_one") >= F.col("n_two")
    chosen = {"hub": ("one", "two"), "outer": ("two", "one"), "doc": ("a", "b"), "other": ("b", "a"), "all": ("all_one", "all_two")}
    pairs = pairs.select("nth", *[F.when(first, F.col(x)).otherwise(F.col(y)).alias(c) for c, (x, y) in chosen.items()])
    parts = F.ceil(F.sqrt(F.col("all") / MOST_VERIFIED))
    x, y = (F.pmod(F.xxhash64(c), parts) for c in ("doc", "other"))
    return pairs.withColumns({"x": x, "y": y}).drop("all")


def _second_round(texts: DataFrame, unique: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links between components that join what links between documents of different components join; None without any to look at."""
    pairs = _candidates(unique, percent)
    if pairs is None:
        return None
    best = Window.partitionBy("one", "two").orderBy(F.desc("margin"), "a", "b")
    ranked = written(_placed(pairs.withColumn("nth", F.row_number().over(best))), "ranked")
    links = _verified(texts, ranked.where(F.col("nth") <= FIRST_PAIRS), width, percent)
    rest = ranked.where(F.col("nth") > FIRST_PAIRS)
    if rest.limit(1).count() == 0:
        return links
    found = written(components(links), "found")
    for side in ("hub", "outer"):
        named = found.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        rest = rest.join(named, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return links.union(_verified(texts, rest.where("_hub <> _outer"), width, percent))


def _merged(heads: DataFrame, links: DataFrame | None) -> DataFrame:
    """Documents with the components that links between their components make."""
    if links is None:
        return heads
    found = components(links).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return written(heads.join(found, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "heads")


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct
    ``width``-word shingles, or its whole sequence when shorter. Two documents link when
    ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest id that links reach.
    Null and empty texts have an empty set and link with nothing. Equal texts, and texts of equal
    sets, link. Rows without id keep a null component; rows that share an id count as one document.
    Other columns are not read. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_points = written(points(texts, width, percent), "points")
    with_set = all_points.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # one document stands for all of equal sets; its component changes from round to round, apart from its wide columns
    head = F.min(F.struct("doc_id", "n_shingles", F.col("firsts")[0].alias("first"), "smallest")).alias("head")
    heads = with_set.groupBy("sig").agg(head)
    heads = heads.select("sig", F.col("head.doc_id").alias("rep"), "head.n_shingles", "head.first", "head.smallest")
    heads = written(heads.withColumn("component", F.col("rep")), "heads")

    links, cut = _first_round(texts, heads, width, percent, F.col("first"))
    heads = _merged(heads, links)
    while cut:
        # the first document of each component stands for it, so that cut groups meet again
        more, cut = _first_round(texts, heads.where("rep = component"), width, percent, F.col("first"))
        cut = cut and more.limit(1).count() > 0
        heads = _merged(heads, more)
    for k in range(ORDERS):
        more, _ = _first_round(texts, heads, width, percent, F.col("smallest")[k])
        heads = _merged(heads, more)
    wide = with_set.select("sig", F.col("doc_id").alias("rep"), "point", "firsts")
    unique = wide.join(heads.select("sig", "rep", "n_shingles", "component"), ["sig", "rep"]).dropDuplicates(["sig", "rep"])
    unique = written(unique.withColumn("who", F.xxhash64("sig")).drop("sig"), "unique")
    heads = _merged(heads, _second_round(texts, unique, width, percent))

    return (
        all_points.select("doc_id", "n_shingles", "sig")
        .join(heads.select("sig", "component"), "sig", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
    )
