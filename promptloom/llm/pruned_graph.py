"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Distinct vectors are dealt into shards at random, and a task builds the graph of a shard: vectors are
inserted in batches; a greedy search for each from the entry (the vector nearest to the mean) proposes
the nodes it has expanded as neighbours, and pruning keeps the nearest of them and drops every other one
that is nearer, by the factor ``ALPHA``, to a kept one than to the vector itself, so that the kept edges are
diverse. Edges are added both ways, and a node whose list grows too long is pruned anew. Nodes that
the entry does not reach are tied to their nearest reached one at the end, so every vector is in
the index.

The index is a table: one row per distinct vector with its shard, its neighbours and its smallest ids.
Blocks of queries pass every shard; a beam search returns the nearest found, measured again in double
precision on the original vectors, and the nearest of all shards are taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import groups, written
from promptloom.llm.shards import blocks, dealt, flat, meet, usable_vector

#: Neighbours of a node, what its list may grow to before it is pruned, and the pruning factor.
DEGREE, SLACK, ALPHA = 32, 48, 1.2
#: Nodes that a search keeps in sight, while the graph is built and when it is queried.
BUILD_BEAM, BEAM = 64, 128
#: Vectors of the first, complete piece of a graph, the most that are inserted at once, and numbers compared at a time.
FIRST, BATCH, CELLS = 128, 1_024, 1 << 22
#: Vectors of a shard.
SHARD = 1 << 15
#: Neighbours that a query may ask for: so many and one more smallest ids are kept of equal vectors.
MOST = 10


def _scale(x: np.ndarray) -> float:
    """A factor that keeps squares of the vectors within single precision."""
    most = float(np.abs(x).max(initial=0.0))
    return 1.0 if 1e-12 < most < 1e12 or most == 0 else 1.0 / most


class Graph:
    """Vectors (single precision) with lists of neighbours, -1 where a list is shorter."""

    def __init__(self, x: np.ndarray, near: np.ndarray | None = None):
        self.scale = _scale(x)
        self.x = np.ascontiguousarray(x * self.scale, dtype=np.float32)
        self.entry = int(np.argmin(self.away(np.arange(len(x)), self.x.mean(axis=0, dtype=np.float64).astype(np.float32))))
        self.near = np.full((len(x), SLACK), -1, dtype=np.int32) if near is None else near

    def away(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances of nodes from one vector or from a vector each, of the differences, so that near ones are told apart."""
        apart = self.x[nodes] - q
        return np.einsum("ij,ij->i", apart, apart)

    # --- search

    def search(self, queries: np.ndarray, beam: int, steps: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes found nearest to each query, with squared distances, nearest first; -1 where fewer are reached.

        With ``steps`` all nodes that were expanded, in the order of the search.
        """
        some = max(1, CELLS * 8 // (len(self.x) + self.near.shape[1] * self.x.shape[1] * 4))
        parts = [self._search(queries[i : i + some], beam, steps) for i in range(0, len(queries), some)]
        wide = max(p[0].shape[1] for p in parts)
        return tuple(
            np.concatenate([np.pad(p[k], ((0, 0), (0, wide - p[k].shape[1])), constant_values=fill) for p in parts])
            for k, fill in ((0, -1), (1, np.inf))
        )

    def _search(self, q: np.ndarray, beam: int, steps: bool) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        found = np.full((m, beam), -1, dtype=np.int32)
        far = np.full((m, beam), np.inf, dtype=np.float32)
        done = np.zeros((m, beam), dtype=bool)
        seen = np.zeros((m, len(self.x)), dtype=bool)
        found[:, 0], seen[:, self.entry] = self.entry, True
        far[:, 0] = self.away(np.full(m, self.entry), q)
        who = np.arange(m)
        opened, opened_far = [], []
        while True:
            todo = (found[who] >= 0) & ~done[who]
            who = who[todo.any(axis=1)]
            if not len(who):
                break
            at = todo[todo.any(axis=1)].argmax(axis=1)
            done[who, at] = True
            node = found[who, at]
            if steps:
                one, one_far = np.full(m, -1, dtype=np.int32), np.full(m, np.inf, dtype=np.float32)
                one[who], one_far[who] = node, far[who, at]
                opened.append(one)
                opened_far.append(one_far)
            near = self.near[node]
            new = (near >= 0) & ~seen[who[:, None], near]
            row, col = np.nonzero(new)
            node = near[row, col]
            seen[who[row], node] = True
            away = np.full(near.shape, np.inf, dtype=np.float32)
            away[row, col] = self.away(node, q[who[row]])
            both = np.concatenate([far[who], away], axis=1)
            order = np.argpartition(both, beam - 1, axis=1)[:, :beam]
            order = np.take_along_axis(order, np.take_along_axis(both, order, axis=1).argsort(axis=1, kind="stable"), axis=1)
            far[who] = np.take_along_axis(both, order, axis=1)
            found[who] = np.take_along_axis(np.concatenate([found[who], np.where(new, near, -1)], axis=1), order, axis=1)
            done[who] = np.take_along_axis(np.concatenate([done[who], ~new], axis=1), order, axis=1)
        return (np.array(opened).T, np.array(opened_far).T) if steps else (found, far)

    # --- pruning

    def prune(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For each node the ``DEGREE`` neighbours at most that robust pruning keeps of ``others`` (-1: none)."""
        out = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        some = max(1, CELLS // (others.shape[1] * max(others.shape[1], self.x.shape[1])))
        for i in range(0, len(nodes), some):
            out[i : i + some] = self._prune(nodes[i : i + some], others[i : i + some])
        return out

    def _prune(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        usable = (others >= 0) & (others != nodes[:, None])
        # seen from the node itself, nearest first
        theirs = (self.x[others] - self.x[nodes][:, None, :]) * usable[:, :, None]
        away = np.where(usable, np.einsum("ijk,ijk->ij", theirs, theirs), np.inf)
        order = away.argsort(axis=1, kind="stable")
        others, away = np.take_along_axis(others, order, axis=1), np.take_along_axis(away, order, axis=1)
        theirs = np.take_along_axis(theirs, order[:, :, None], axis=1)
        between = np.matmul(theirs, theirs.transpose(0, 2, 1))
        alive = np.isfinite(away)
        out = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[some, k] = others[rows, first][some]
            alive[rows, first] = False
            apart = away[rows, first][:, None] + away - 2 * between[rows, first]
            alive &= ALPHA * ALPHA * apart > away
        return out

    # --- building

    def build(self) -> np.ndarray:
        """The neighbours of every node; nodes are inserted in random order, as those of one batch do not see each other."""
        n = len(self.x)
        here = min(n, FIRST)
        all_first = np.broadcast_to(np.arange(here, dtype=np.int32), (here, here))
        # the entry must be among the first, and stays the entry
        order = np.random.default_rng(n).permutation(n)
        swap = int(np.flatnonzero(order == self.entry)[0])
        order[[0, swap]] = order[[swap, 0]]
        first = order[:here].astype(np.int32)
        self.near[first, :DEGREE] = self.prune(first, first[all_first])
        while here < n:
            new = order[here : here + min(BATCH, here)].astype(np.int32)
            opened, _ = self.search(self.x[new], BUILD_BEAM, steps=True)
            kept = self.prune(new, opened)
            self.near[new, :DEGREE] = kept
            row, col = np.nonzero(kept >= 0)
            self._add(kept[row, col], new[row])
            here += len(new)
        self._reach_all()
        return self.near

    def _add(self, to: np.ndarray, node: np.ndarray) -> None:
        """Edges from ``to`` to ``node``; lists that grow too long are pruned."""
        order = np.argsort(to, kind="stable")
        to, node = to[order], node[order]
        first = np.flatnonzero(np.diff(np.concatenate([[-1], to])))
        size = np.diff(np.concatenate([first, [len(to)]]))
        owner = to[first]
        has = (self.near[owner] >= 0).sum(axis=1)
        fits = has + size <= SLACK
        nth = np.arange(len(to)) - np.repeat(first, size)
        easy = np.repeat(fits, size)
        self.near[to[easy], (np.repeat(has, size) + nth)[easy]] = node[easy]
        # the others by how many they have in all, so that few long lists do not widen the many short ones
        hard = np.flatnonzero(~fits)
        hard = hard[np.argsort(size[hard], kind="stable")]
        while len(hard):
            wide = int(size[hard[0]]) * 2
            part = hard[size[hard] <= wide]
            hard = hard[len(part) :]
            more = np.full((len(part), wide), -1, dtype=np.int32)
            for k, g in enumerate(part.tolist()):
                more[k, : size[g]] = node[first[g] : first[g] + size[g]]
            nodes = owner[part]
            kept = self.prune(nodes, np.concatenate([self.near[nodes], more], axis=1))
            self.near[nodes] = -1
            self.near[nodes, :DEGREE] = kept

    def _reached(self) -> np.ndarray:
        reached = np.zeros(len(self.x), dtype=bool)
        edge = np.array([self.entry])
        reached[edge] = True
        while len(edge):
            after = np.unique(self.near[edge])
            edge = after[(after >= 0) & ~reached[after]]
            reached[edge] = True
        return reached

    def _reach_all(self) -> None:
        """Tie every node that the entry does not reach to its nearest reached one."""
        while True:
            lost = np.flatnonzero(~self._reached())
            if not len(lost):
                return
            # a search finds reached nodes only; what hangs on a tied node is reached with it
            found, _ = self.search(self.x[lost[:BATCH]], BUILD_BEAM)
            for node, to in zip(lost[:BATCH].tolist(), found[:, 0].tolist(), strict=True):
                free = np.flatnonzero(self.near[to] < 0)
                if not len(free):
                    self.near = np.concatenate([self.near, np.full((len(self.near), 8), -1, dtype=np.int32)], axis=1)
                    free = np.flatnonzero(self.near[to] < 0)
                self.near[to, free[0]] = node


# --- the index and its search ---------------------------------------------------------------------------------


INDEX = "size int, shard int, node int, ids array<bigint>, vector array<double>, near array<int>"


def build(
    vectors: DataFrame, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The index of ``vectors``, written: one row per distinct vector with its shard and neighbours.

    Vectors that are null, empty, zero or have null or non-finite components, and rows without id, are not in it.
    Of the ids of equal vectors the ``most + 1`` smallest are kept, all that a search for ``most`` can return.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), usable_vector(F.col(vector_col)).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("one", F.xxhash64("vector")).withColumn("two", F.xxhash64(F.lit("second"), "vector"))
    nth = F.row_number().over(Window.partitionBy("one", "two").orderBy("vec_id"))
    ids = rows.select("vec_id", "one", "two").distinct().withColumn("nth", nth).where(F.col("nth") <= most + 1)
    ids = ids.groupBy("one", "two").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = rows.groupBy("one", "two").agg(F.first("vector").alias("vector"))
    distinct = written(distinct.join(ids, ["one", "two"]).withColumn("size", F.size("vector")), "distinct")
    shards = dealt(distinct, "one", "two", most=SHARD)
    n = int(shards.agg(F.max("shard")).first()[0] or 0) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["size", "shard"]):
            group = group.combine_chunks()
            near = Graph(flat(group["vector"], group["size"][0].as_py())).build()
            for a in range(0, len(near), 4096):
                part, lists = group.slice(a, 4096), near[a : a + 4096]
                real = lists >= 0
                ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part[c].combine_chunks() for c in ("size", "shard")], pa.array(np.arange(a, a + len(lists), dtype=np.int32)),
                        *[part[c].combine_chunks() for c in ("ids", "vector")], pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[real])),
                    ],
                    ["size", "shard", "node", "ids", "vector", "near"],
                )

    # in the order of the digests, which is random and the same in every run
    by = ["size", "shard", "one", "two"]
    graphs = shards.repartitionById(n, F.col("shard")).sortWithinPartitions(*by).mapInArrow(run, INDEX)
    return written(graphs, "graphs")


class _Loaded:
    """A shard of the index in a task."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows["node"].to_numpy()))).combine_chunks()
        self.vectors = flat(rows["vector"], rows["size"][0].as_py())
        lists = rows["near"].combine_chunks() if isinstance(rows["near"], pa.ChunkedArray) else rows["near"]
        size = np.diff(lists.offsets.to_numpy())
        near = np.full((len(size), max(1, int(size.max()))), -1, dtype=np.int32)
        near[np.arange(near.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
        self.graph = Graph(self.vectors, near)
        ids = rows["ids"].combine_chunks() if isinstance(rows["ids"], pa.ChunkedArray) else rows["ids"]
        self.n_ids, self.ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
        self.first_id = np.cumsum(self.n_ids) - self.n_ids


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, without overflow."""
    apart = a - b
    plain = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    odd = ~np.isfinite(plain) | (plain < 1e-140)
    if odd.any():
        half = a[odd] / 2 - b[odd] / 2
        most = np.abs(half).max(axis=1)
        unit = half / np.where(most > 0, most, 1)[:, None]
        plain[odd] = 2 * (most * np.sqrt(np.einsum("ij,ij->i", unit, unit)))
    return plain


NEAREST = "query_id bigint, twin bigint, vec_id bigint, score double"


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest rows found, not counting its own id.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id. ``k`` may not exceed what
    the index was built for. Queries whose vector is null, empty, zero or has null or non-finite components,
    or without id, have no result; equal rows are one query, and different vectors of one id are each
    a query. Vectors of other sizes are never near. All candidates are returned where there are fewer than ``k``,
    and an empty table gives an empty one. Other columns are not read.
    """
    asked = queries.select(F.col(id_col).cast("bigint").alias("query_id"), usable_vector(F.col(vector_col)).alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & F.exists("vector", lambda x: x != 0))
    asked = asked.withColumn("twin", F.xxhash64("vector")).withColumn("size", F.size("vector")).dropDuplicates(["query_id", "twin"])

    def answer(shard: _Loaded, block: dict) -> pa.RecordBatch | None:
        own, twin = (block[c].values.to_numpy() for c in ("query_id", "twin"))
        vectors = flat(block["vector"].values, shard.vectors.shape[1])
        nodes, _ = shard.graph.search((vectors * shard.graph.scale).astype(np.float32), max(beam, k + 1))
        who, at = np.nonzero(nodes >= 0)
        node = nodes[who, at]
        score = distances(vectors[who], shard.vectors[node])
        # every id of an equal vector is a row
        times = shard.n_ids[node]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ids = shard.ids[np.repeat(shard.first_id[node], times) + nth]
        who, score = np.repeat(who, times), np.repeat(score, times)
        other = ids != own[who]
        who, score, ids = who[other], score[other], ids[other]
        order = np.lexsort((ids, score, who))
        who, score, ids = who[order], score[order], ids[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        return pa.RecordBatch.from_arrays(
            [pa.array(own[who[best]]), pa.array(twin[who[best]]), pa.array(ids[best]), pa.array(score[best])],
            ["query_id", "twin", "vec_id", "score"],
        )

    found = meet(index, blocks(asked, "size", "query_id", "twin"), "size", _Loaded, answer, NEAREST)
    first = Window.partitionBy("query_id", "twin").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(first).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
