"""Quality rules: fixed limits, and robust outliers by minimum covariance determinants.

Statistics of every whole text become a vector of transformed rates. For each language and source
the estimator looks for the three quarters of the vectors whose covariance has the least
determinant, by concentration steps over all rows: distances under the present estimate are counted
and summed up by their logarithm in fine bins, the bins nearest the centre that hold the share give
the next mean and covariance. A last step takes all vectors within the 97.5 % ellipsoid. Documents
beyond a far quantile of the squared Mahalanobis distance are rejected.

Each step is one aggregation of moments, combined before its shuffle, so a source that holds a
third of all rows costs no more than many small ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import BROADCAST_IDS, Words, mix, slices, text_bytes, written

#: Coordinates, with the least standard deviation each is taken to have.
FLOORS = {"length": 1.0, "word_length": 0.5, "symbols": 0.06, "upper": 0.08, "dup_lines": 0.15, "repeats": 0.15}
D = len(FLOORS)
#: Share of a group that an estimate rests on, concentration steps, and the quantile of rejection.
SHARE, STEPS, FAR = 0.75, 6, 0.997
#: A smaller group is estimated with the others of its language; a smaller language with the rest.
LEAST_GROUP = 60
#: Bins of distances for each doubling.
BINS = 8

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

STATISTICS = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint"
)


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, starts) if len(starts) else flags[:0]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs again."""
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[where] > 1


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(text_bytes(batch["text"]))
            buffer, begin = words.buffer, words.text_start[:-1]
            blank = (buffer == 0x20) | ((buffer >= 9) & (buffer <= 13))
            chars = ((buffer & 0xC0) != 0x80) & ~blank
            # Latin-1 capitals are the bytes 80-9E after C3, but for the sign 97
            wide = np.concatenate([[False], buffer[:-1] == 0xC3]) & (buffer >= 0x80) & (buffer <= 0x9E) & (buffer != 0x97)
            upper = ((buffer >= 65) & (buffer <= 90)) | wide
            n_words = np.diff(words.first)
            number = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)

            windows = mix(words.windows(5) + mix(number + np.uint64(1)))
            inside = np.arange(len(number)) + 5 <= words.first[1:][number.astype(np.int64)] if len(number) else np.zeros(0, bool)
            again = np.zeros(len(number), dtype=bool)
            again[inside] = _repeated(windows[inside])
            cover = np.zeros(len(number) + 6, dtype=np.int64)
            np.add.at(cover, np.flatnonzero(again), 1)
            np.add.at(cover, np.flatnonzero(again) + 5, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(number)] > 0)])

            ends = np.flatnonzero(buffer == 10)
            starts = np.concatenate([[0], ends[:-1] + 1])
            inked = np.concatenate([[0], np.cumsum(chars)])
            with_word = inked[ends] > inked[starts]
            starts, ends = starts[with_word], ends[with_word]
            line_of = np.searchsorted(begin, starts, side="right") - 1
            lines = mix(words.ranges(starts, ends) + mix(line_of.astype(np.uint64) + np.uint64(1)))
            _, first_line = np.unique(lines, return_index=True)
            n_lines = np.bincount(line_of, minlength=len(begin))
            n_distinct = np.bincount(line_of[first_line], minlength=len(begin))
            columns = [
                n_words,
                _sums(chars.astype(np.int64), begin),
                _sums(_SYMBOL[buffer], begin),
                n_lines - n_distinct,
                covered[words.first[1:]] - covered[words.first[:-1]],
                n_lines,
                _sums(upper.astype(np.int64), begin),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lang"], batch["source"], *[pa.array(c, pa.int64()) for c in columns]],
                [c.split()[0] for c in STATISTICS.split(", ")],
            )

    return docs.mapInArrow(run, STATISTICS)


def coordinates() -> Column:
    """The vector: rates on a root scale, drawn towards 0 where a text is too short to tell."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return F.array(
        F.log1p(n),
        (chars / F.greatest(n, F.lit(1.0)) - 5) * F.sqrt(n / (n + 100)),
        F.sqrt(F.col("n_symbols") / (chars + 200)),
        F.sqrt(F.col("n_upper") / (chars + 200)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 3)),
        F.sqrt(F.col("n_repeat_words") / (n + 50)),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# --- estimates -----------------------------------------------------------------------------------


def chi2_below(x: float, d: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def chi2_quantile(p: float, d: int = D) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, d) < p else (low, middle)
    return high


def _inverse(matrix: np.ndarray) -> np.ndarray:
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):  # positive definite, as the floors are added to the diagonal
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


ESTIMATE = "grp string, center array<double>, inverse array<double>"
_FLOOR = np.diag(np.square(list(FLOORS.values())))


def _estimate(group: str, center: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    inverse = _inverse(scatter + _FLOOR)
    return pd.DataFrame({"grp": [group], "center": [center.tolist()], "inverse": [inverse.ravel().tolist()]})


def moments() -> list[Column]:
    x = [F.col("x")[i] for i in range(D)]
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs],
    ]


def _from_moments(total: pd.Series, factor: float) -> tuple[np.ndarray, np.ndarray]:
    n = max(float(total["n"]), 1.0)
    center = np.array([total[f"s{i}"] for i in range(D)]) / n
    scatter = np.empty((D, D))
    for i in range(D):
        for j in range(i, D):
            scatter[i, j] = scatter[j, i] = total[f"q{i}_{j}"] / n - center[i] * center[j]
    return center, scatter * factor


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with ``d2``, the squared distance from the estimate of their group.

    The estimates, one row per group, go to every task while they are few, else both are shuffled.
    """
    few = estimates.count() <= BROADCAST_IDS // 100
    joined = rows.join(F.broadcast(estimates) if few else estimates, "grp")
    away = F.transform(F.arrays_zip("x", "center"), lambda p: p["x"] - p["center"])
    joined = joined.withColumn("_a", away)
    d2 = sum(
        F.col("_a")[i] * F.col("_a")[j] * F.col("inverse")[i * D + j] for i in range(D) for j in range(D)
    )
    return joined.withColumn("d2", F.greatest(d2, F.lit(0.0))).drop("_a", "center", "inverse")


def _first_estimates(rows: DataFrame) -> DataFrame:
    """Medians and their absolute deviations, from counts on a grid of hundredths."""
    cells = rows.select("grp", F.posexplode("x").alias("i", "v"))
    cells = cells.groupBy("grp", "i", F.floor(F.col("v") * 100).alias("cell")).agg(F.count(F.lit(1)).alias("n"))

    def median(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        center, spread = np.zeros(D), np.zeros(D)
        for i, part in group.groupby("i"):
            values, n = part["cell"].to_numpy(float) / 100, part["n"].to_numpy(float)
            center[i] = median(values, n)
            spread[i] = 1.4826 * median(np.abs(values - center[i]), n)
        return _estimate(group["grp"].iloc[0], center, np.diag(spread**2))

    return cells.groupBy("grp").applyInPandas(run, ESTIMATE)


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    near = chi2_quantile(SHARE)
    factor = SHARE / chi2_below(near, D + 2)
    bins = F.floor(F.log2(F.col("d2") + 1e-9) * BINS).cast("int").alias("bin")
    sums = with_distance(rows, estimates).groupBy("grp", bins).agg(*moments())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        wanted = SHARE * group["n"].sum()
        taken = group[(group["n"].cumsum() - group["n"]) < wanted].drop(columns=["grp", "bin"]).sum()
        return _estimate(group["grp"].iloc[0], *_from_moments(taken, factor))

    return sums.groupBy("grp").applyInPandas(run, ESTIMATE)


def _reweigh(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    near = chi2_quantile(0.975)
    factor = 0.975 / chi2_below(near, D + 2)
    weight = (F.col("d2") <= near).cast("int").alias("bin")
    sums = with_distance(rows, estimates).groupBy("grp", weight).agg(*moments())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        inner = group[group["bin"] == 1] if (group["bin"] == 1).any() else group
        return _estimate(group["grp"].iloc[0], *_from_moments(inner.drop(columns=["grp", "bin"]).sum(), factor))

    return sums.groupBy("grp").applyInPandas(run, ESTIMATE)


def estimates(rows: DataFrame) -> DataFrame:
    """One estimate per ``grp`` of ``rows`` (``grp``, ``x``); each step is written before the next."""
    now = written(_first_estimates(rows), "estimates")
    for _ in range(STEPS):
        now = written(_concentrate(rows, now), "estimates")
    return written(_reweigh(rows, now), "estimates")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Statistics of every row with ``base_failed``, ``distance`` (squared) and ``kept``.

    Null texts count as empty and fail the base rules, as do all texts under ten words. Null
    languages and sources are values of their own. Only rows that pass the base rules are estimated
    from; without any, nothing else is rejected. Repeated rows count each; an empty table gives an
    empty one. Groups of fewer than ``LEAST_GROUP`` such rows share an estimate with the other small
    groups of their language, and small languages with each other.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    found = statistics(texts).withColumn("base_failed", base_failed()).withColumn("x", coordinates())
    found = written(found, "statistics")
    passed = found.where(~F.col("base_failed"))
    by_source = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    big = F.col("n") >= LEAST_GROUP
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rest = by_source.where(~big).groupBy("lang").agg(F.sum("n").alias("rest"))
    same_lang = F.col("lang").eqNullSafe(F.col("_lang"))
    named = by_source.join(rest.withColumnRenamed("lang", "_lang"), same_lang, "left").select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.when(big, own)
        .when(F.col("rest") >= LEAST_GROUP, F.concat(F.lit("rest of "), F.coalesce("lang", F.lit(""))))
        .otherwise(F.lit("rest"))
        .alias("grp"),
    )
    named = written(named, "groups")
    few = named.count() <= BROADCAST_IDS // 100
    of_group = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = found.join(F.broadcast(named) if few else named, of_group, "left").drop("_lang", "_source")
    rows = written(rows, "vectors")
    usable = rows.where(~F.col("base_failed")).select("grp", "x")
    final = estimates(usable)
    judged = with_distance(rows.where(~F.col("base_failed")), final).withColumn("kept", F.col("d2") <= chi2_quantile(FAR))
    failed = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return judged.unionByName(failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("d2", 6).alias("distance"),
    )
