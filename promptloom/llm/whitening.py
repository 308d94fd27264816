"""Whitening by Chebyshev-filtered subspace iteration on passes over the table.

The leading eigenvectors of the covariance are found without ever forming it: a pass multiplies it
with a thin block of directions, each task adding up what its rows contribute, centred first. A
polynomial recurrence of such passes damps the part of the spectrum that is not wanted, whose ends
are estimated by a short Lanczos run below and by the block's own smallest Ritz value above; then the
block is made orthonormal and rotated by Rayleigh-Ritz. Rounds end when the residuals of the wanted
pairs no longer fall, and the pairs are certified: by their residuals, by a Lanczos run on what the
block leaves out, which must hold no larger eigenvalue, and by the covariance of the whitened rows.

The driver holds only blocks of directions (vector size by at most ``components + guard``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import written
from promptloom.llm.shards import flat, usable_vector

#: Components are multiplied by SCALE, rounded down and moved up by SHIFT; beyond LARGEST they saturate.
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 50)
#: Directions beside the wanted ones, degree of the polynomial, most rounds, steps of a Lanczos run.
GUARD, DEGREE, ROUNDS, LANCZOS = 16, 10, 100, 10
#: A polynomial may raise the largest direction over the smallest wanted one by no more than this.
MOST_RATIO = 1e6
#: Residuals that are accepted, and those of pairs that are settled, as shares of the largest eigenvalue; and
#: eigenvalues that count as zero.
ACCEPTED, SETTLED, ZERO = 1e-10, 1e-14, 1e-11
#: Dimensions whose partial sums go to one task.
PART = 256

Apply = Callable[[np.ndarray], np.ndarray]


# --- the iteration, on blocks of directions ----------------------------------------------------------------


def lanczos(apply: Apply, start: np.ndarray, steps: int) -> tuple[float, float]:
    """Ends of the spectrum seen from ``start``: the lower one moved down by the last residual, and the largest Ritz value."""
    basis, alphas, betas = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = apply(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-13 * max(map(abs, alphas), default=0.0):
            betas[-1] = 0.0
            break
        basis.append(w / betas[-1])
    n = len(alphas)
    values = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1))
    return float(values[0]) - betas[-1], float(values[-1])


def filtered(apply: Apply, block: np.ndarray, low: float, cut: float, top: float, wanted: float, degree: int) -> np.ndarray:
    """``block`` under the Chebyshev polynomial that is small on ``[low, cut]``, scaled at ``top``, the block's largest value.

    The degree is lower where it would raise ``top`` too far over ``wanted``, the smallest wanted value.
    """
    half, centre = max((cut - low) / 2, 1e-9 * top), (cut + low) / 2

    def growth(x: float) -> float:
        t = max(1.0, (x - centre) / half)
        return t + np.sqrt(t * t - 1)

    ratio = growth(top) / growth(wanted)
    steps = degree if ratio <= 1 else int(np.clip(np.log(MOST_RATIO) / np.log(ratio), 1, degree))
    first = sigma = half / max(top - centre, half)
    before, now = block, (apply(block) - centre * block) * (sigma / half)
    for _ in range(steps - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def apart_from(apply: Apply, known: np.ndarray) -> Apply:
    """``apply`` on what is orthogonal to the columns of ``known``."""

    def outside(x: np.ndarray) -> np.ndarray:
        y = apply(x - known @ (known.T @ x))
        return y - known @ (known.T @ y)

    return outside if known.shape[1] else apply


def leading_pairs(apply: Apply, size: int, components: int, guard: int = GUARD, degree: int = DEGREE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``components`` eigenvalues of ``apply``, falling, that are not zero, and their eigenvectors as columns.

    Raises ``RuntimeError`` where the pairs cannot be certified.
    """
    rng = np.random.default_rng([seed, size])
    width = min(size, components + guard)
    block = np.linalg.qr(rng.standard_normal((size, width)))[0]
    low = max(0.0, lanczos(apply, rng.standard_normal(size), LANCZOS)[0]) if width < size else 0.0
    last = np.inf
    for _ in range(ROUNDS):
        image = apply(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        if values[0] <= 0:
            return np.zeros(0), np.zeros((size, 0))
        wanted = int((values[:components] > ZERO * values[0]).sum())
        residuals = np.linalg.norm(image - block * values, axis=0)[:wanted]
        residual, share = float(residuals.max() / values[0]), float((residuals / values[:wanted]).max())
        # small eigenvalues too are settled before it ends
        if residual <= ACCEPTED and share > 0.8 * last:
            break
        slow, last = share > last / 2, share
        if width == size:
            # the block is the whole space; one more turn settles the rounding of the first
            block = np.linalg.qr(block)[0]
            continue
        # leading pairs that are settled are kept out, so that they don't drown the others
        settled = min(int((np.cumprod(residuals <= SETTLED * values[0])).sum()), wanted - 1)
        kept, rest = block[:, :settled], block[:, settled:]
        cut = max(float(values[-1]), low)
        if slow:
            # the block may end inside an eigenspace, which nothing parts from itself but much from the rest
            cut = low + 0.75 * (cut - low)
        rest = filtered(apart_from(apply, kept), rest, low, cut, float(values[settled]), float(values[wanted - 1]), degree)
        block = np.linalg.qr(np.hstack([kept, rest]))[0]
    else:
        raise RuntimeError(f"not certified after {ROUNDS} rounds: residual {residual:.1e} of the largest eigenvalue")
    if width < size:
        outside = apart_from(apply, block)
        start = rng.standard_normal(size)
        _, most = lanczos(outside, start - block @ (block.T @ start), LANCZOS)
        # a Ritz value of the rest is no larger than its largest eigenvalue
        if most > (float(values[wanted - 1]) if wanted == components else ACCEPTED * float(values[0])) * (1 + 1e-9):
            raise RuntimeError("not certified: a larger eigenvalue was left out")
    signs = np.sign(block[np.abs(block).argmax(axis=0), np.arange(block.shape[1])])
    return values[:wanted], (block * signs)[:, :wanted]


# --- passes over the table -----------------------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """Each component ``c`` as ``floor(64 c) + 1000000``, or null for a vector that takes no part."""
    edge = F.lit(LARGEST)
    return F.transform(
        usable_vector(vector), lambda c: F.floor(F.greatest(-edge, F.least(edge, c * F.lit(SCALE)))) + F.lit(SHIFT)
    )


@dataclass(frozen=True)
class Mean:
    """Number of distinct rows and their sums by dimension, which go along to the tasks."""

    n: int
    sums: np.ndarray

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly: as 64-bit integers where they suffice, as Python's otherwise."""
        bits = int(np.abs(x).max(initial=1)).bit_length() + self.n.bit_length()
        if bits > 61:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * np.int64(self.n) - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.from_mean(x) / self.n).astype(np.float64)


@dataclass(frozen=True)
class Fit:
    """The distinct rows and their mean."""

    rows: DataFrame
    mean: Mean


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return flat(batch["x"], len(batch["x"][0]))


def fit_rows(rows: DataFrame) -> Fit | None:
    """Distinct vectors of the most frequent size among them (the larger one of equals); None without any."""
    sizes = rows.select("x").distinct().withColumn("size", F.size("x"))
    sizes = written(sizes, "distinct")
    most = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in two halves, whose sums cannot overflow
        high, low = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                high += (x >> 26).sum(axis=0)
                low += (x & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(high), pa.array(low)], ["dim", "high", "low"])

    size = int(most["size"])
    fit = sizes.where(F.col("size") == size).select("x")
    halves = fit.mapInArrow(run, "dim int, high bigint, low bigint").groupBy("dim")
    halves = halves.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("dim").collect()
    return Fit(fit, Mean(int(most["n"]), np.array([(int(r.high) << 26) + int(r.low) for r in halves], dtype=object)))


def _summed(fit: Fit, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``share`` (of centred rows, as a matrix of ``shape``).

    Every task adds up its rows; slices of ``PART`` rows of the sums meet in a task each, and are
    added in the order of the tasks.
    """

    mean = fit.mean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                total += share(mean.centred(_matrix(batch.slice(a, 4096))))
        task = TaskContext.get().partitionId()
        for part in range(-(-shape[0] // PART)):
            values = total[part * PART : (part + 1) * PART].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([values], pa.binary())], ["part", "task", "sum"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch["part"].to_pylist(), batch["sum"].to_pylist(), strict=True):
                values = np.frombuffer(values)
                totals[part] = totals[part] + values if part in totals else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["part", "sum"]
        )

    parts = -(-shape[0] // PART)
    sums = fit.rows.mapInArrow(run, "part int, task int, sum binary").repartitionById(parts, "part")
    sums = sums.sortWithinPartitions("part", "task").mapInArrow(merge, "part int, sum binary").collect()
    return np.concatenate([np.frombuffer(r["sum"]) for r in sorted(sums, key=lambda r: r["part"])]).reshape(shape)


def times_covariance(fit: Fit, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of directions, in one pass."""
    return _summed(fit, lambda y: y.T @ (y @ block), block.shape) / fit.mean.n


def identity_error(fit: Fit, onto: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, in one pass."""
    k = onto.shape[1]

    def share(y: np.ndarray) -> np.ndarray:
        z = y @ onto
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = _summed(fit, share, (k + 1, k)) / fit.mean.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0.0))


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, one row per vector and component.

    A component ``c`` counts as ``x = floor(64 c) + 1000000``. Covariance, mean and ``n`` are those of
    the distinct vectors. Components are the unit eigenvectors of the covariance, numbered from 1 by
    falling eigenvalue, their largest entry positive; ``whitened`` is the centred vector's projection
    over the root of the eigenvalue, ``explained`` the eigenvalue's share of the trace,
    ``deviation`` the exact sum of ``(n x - S)^2``, null where it passes 64 bits, and
    ``identity_error`` how far the whitened covariance is from the identity.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those
    whose size is not the most frequent one (of equals the larger), for which there is no common space.
    Entries saturate at 2^50. Repeated rows count once in the fit, and come out as often as they stand;
    a null id stays null. Eigenvalues that are zero have no component, so a single distinct vector or an
    empty table gives an empty one. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    fit = fit_rows(rows)
    if fit is None:
        return rows.limit(0).mapInArrow(lambda batches: (b for b in ()), WHITENED)
    mean = fit.mean
    n, size = mean.n, len(mean.sums)
    trace = float(_summed(fit, lambda y: np.array([[np.einsum("ij,ij->", y, y)]]), (1, 1))[0, 0]) / n
    values, directions = leading_pairs(lambda block: times_covariance(fit, block), size, min(components, size)) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
    onto = directions / np.sqrt(values)
    error, k, explained = identity_error(fit, onto), len(values), values / trace if trace > 0 else values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part)
                apart = mean.from_mean(x)
                close = apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * size < 1 << 63
                if close:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    exact = (apart.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                white = mean.centred(x) @ onto
                each = np.repeat(np.arange(part.num_rows), k)
                at = pa.array(each)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(len(each), n)), deviation.take(at), pa.array(white.ravel()),
                        pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("x") == size).mapInArrow(run, WHITENED)
