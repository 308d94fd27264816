"""Pack tokenized documents into sequences of fixed length by cutting-stock column generation.

A document longer than a sequence is cut into whole sequences and a rest. The lengths of all pieces
are counted in classes of ``width`` tokens, at most ``length / width`` numbers whatever the corpus
holds, and a linear program over those numbers finds which patterns of classes fill sequences with
the least of them: a knapsack program prices new patterns with the dual values until none pays.
Patterns are rounded down, the few pieces left are placed greedily, and the pieces, ranked within
their class, take the slots of the patterns in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import fresh, release, slices, worker_cache, written

#: Tokens of a length class. Pieces are placed as if they had the class's longest length.
WIDTH = 8
#: Hash buckets in which the pieces of one class are ranked side by side.
RANK_BUCKETS = 256
#: Signs that the pre-tokenizer takes apart from the word before them, whatever follows.
SIGNS = ",.!?;:%*#$&|"
#: Entries of a worker's tables of token ids by text run and by word, and the longest run kept.
CACHE_RUNS, CACHE_WORDS, CACHE_CHARS = 400_000, 600_000, 64
#: Runs whose ids are copied to their places at once.
GATHERED = 1 << 16
#: The program ends when its number of sequences is proven to be within this share of the least.
GAP = 2e-4
#: A bound on the steps of the linear program; a program cut short still gives a valid packing.
MOST_STEPS = 20_000


def _plain(word: str) -> bool:
    """Whether a word has letters alone, and only such as the normaliser lower-cases one by one."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Table:
    """Texts and their ids end to end, so that an entry takes its own bytes and few more, not some hundred as an object."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.texts = pa.array([], pa.string())
        self.ids, self.ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, -1 if it is not known."""
        found = pc.fill_null(pc.index_in(texts, value_set=self.texts), -1)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, texts: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.texts = pa.concat_arrays([self.texts, texts])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each has."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    return np.frombuffer(b"".join(ids), dtype="<u4"), sizes


class _Runs:
    """Little-endian 32-bit ids of texts, by the runs between their blanks.

    The vocabulary's normaliser and pre-tokenizer treat blanks as ends of everything, so a text's ids
    are those of its runs. The normaliser lower-cases character by character and the pre-tokenizer
    takes letters and signs apart, so a word with signs behind it has the word's ids, then theirs.
    Runs and words are remembered by the worker process.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs, self.words = _Table(), _Table()
        self.closes = self._closing()

    def _closing(self) -> np.ndarray | None:
        """For each id whether it ends a word; None if the vocabulary does not mark the ends of words."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        closes = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return closes

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, from one text: the last id of each, and no other, closes a word."""
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype="<u4")
        if self.closes is None or len(ids) and int(ids.max()) >= len(self.closes):
            return self._encode(words)
        ends = (np.flatnonzero(self.closes[ids]) * 4 + 4).tolist()
        if len(ends) != len(words):
            return self._encode(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of different words; those that were not known are remembered, unless they are long."""
        if len(self.words.texts) >= CACHE_WORDS:
            self.words.clear()
        place = self.words.find(pa.array(words, pa.string()))
        there = np.flatnonzero(place >= 0)
        first, past = self.words.ends[place[there]].tolist(), self.words.ends[place[there] + 1].tolist()
        known = {words[i]: self.words.ids[a:b].tobytes() for i, a, b in zip(there.tolist(), first, past, strict=True)}
        plain, other = [], []
        for word in (words[i] for i in np.flatnonzero(place < 0).tolist()):
            (plain if _plain(word) and word == word.lower() else other).append(word)
        for missing, encode in ((plain, self._encode_words), (other, self._encode)):
            for i in range(0, len(missing), 1024):
                known.update(zip(missing[i : i + 1024], encode(missing[i : i + 1024]), strict=True))
        short = [word for word in (*plain, *other) if len(word) <= CACHE_CHARS]
        self.words.add(pa.array(short, pa.string()), *_joined([known[word] for word in short]))
        return known

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of runs that are not remembered."""
        # all in one go: runs hold no line break, and lower-casing never shortens one
        text = "\n".join(new)
        lows = text.lower().split("\n")
        if sum(map(len, lows)) + len(lows) - 1 != len(text):
            lows = [low if len(low) == len(run) else "" for run, low in zip(new, lows, strict=True)]
        words = [word if _plain(word := low.rstrip(SIGNS)) else run for run, low in zip(new, lows, strict=True)]
        signs = [low[len(word) :] for low, word in zip(lows, words, strict=True)]
        known = self._of_words(list(set(words).union(signs)))
        return [known[w] + known[s] if s else known[w] for w, s in zip(words, signs, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null as empty. Each different run is looked up once, and its ids are copied to its places."""
        if len(self.runs.texts) >= CACHE_RUNS:
            self.runs.clear()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        places = split.flatten().dictionary_encode()
        at = self.runs.find(places.dictionary)
        missing = np.flatnonzero(at < 0)
        ids, ends = self.runs.ids, self.runs.ends
        if len(missing):
            new = places.dictionary.take(pa.array(missing))
            learnt, n = _joined(self._learn(new.to_pylist()))
            at[missing] = len(ends) - 1 + np.arange(len(missing))
            short = pc.less_equal(pc.utf8_length(new), CACHE_CHARS).to_numpy(zero_copy_only=False)
            self.runs.add(new.filter(pa.array(short)), learnt[np.repeat(short, n)], n[short])
            ids, ends = np.concatenate([ids, learnt]), np.concatenate([ends, ends[-1] + np.cumsum(n)])
        first, sizes = ends[at], ends[at + 1] - ends[at]
        place = places.indices.to_numpy()
        here = sizes[place]
        ends = np.concatenate([[0], np.cumsum(here)])
        data = np.empty(int(ends[-1]), dtype="<u4")
        for i in range(0, len(place), GATHERED):
            cut = ends[i : i + GATHERED + 1]
            shift = np.repeat(first[place[i : i + GATHERED]] - cut[:-1], here[i : i + GATHERED])
            data[cut[0] : cut[-1]] = ids[np.arange(cut[0], cut[-1]) + shift]
        cuts = split.offsets.to_numpy()
        cuts = ends[cuts - cuts[0]].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _encoder(path: str) -> Callable[[pa.Array], list[bytes]]:
    known = worker_cache("token runs")
    if path not in known:
        # what earlier stages have left would stand beside the tables for good
        fresh()
        known = worker_cache("token runs")
        known[path] = _Runs(path)
    return known[path].encode


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``length`` tokens; ``end_id`` closes each document.

    One row per piece: ``doc_id``, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` and, only ``with_ids``, the ids as little-endian 32-bit numbers.
    Null and empty texts give the end id alone. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "text", 3 << 20):
            out: list[tuple] = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values, type=kind)
                    for values, kind in zip(
                        zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True
                    )
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )
            # a worker's allocators would keep the most that any slice took
            out.clear()
            release()

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, PIECES)


# --- the linear program over the length histogram ------------------------------------------------


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes within ``capacity``: a knapsack by dynamic programming."""
    # best[room] stands at capacity + room; below it lies what no piece can leave over
    best = np.concatenate([np.full(capacity, -np.inf), np.zeros(capacity + 1)])
    chosen = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth = best[capacity + room - sizes] + values
        top = int(worth.argmax())
        if worth[top] > best[capacity + room - 1] + 1e-12:
            best[capacity + room], chosen[room] = worth[top], top
        else:
            best[capacity + room] = best[capacity + room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            pattern[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return float(best[-1]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    # not by the linear algebra library: its threads may hang in a process that has started a JVM
    return np.einsum("ij,j->i", matrix, vector.astype(np.float64))


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchange."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        top = i + int(np.abs(work[i:, i]).argmax())
        work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def generate_columns(counts: dict[int, int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (pieces of each size, in the order of sorted sizes) with their optimal amounts.

    Revised simplex method over patterns: minimise the number of sequences so that the patterns
    cover ``counts``; the knapsack finds the entering column.
    """
    sizes = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(s)] for s in sizes], dtype=np.float64)
    basis = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = _times(inverse, need)
    for step in range(MOST_STEPS):
        worth, pattern = _best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + GAP:
            break
        direction = _times(inverse, pattern)
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = pattern
        if step % 100 == 99:
            inverse = _inverse(basis)
        else:
            row = inverse[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
        amount = np.maximum(_times(inverse, need), 0)
    return [(basis[:, i].astype(np.int64), float(amount[i])) for i in range(len(sizes))]


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns with their amounts, which place every counted piece exactly once.

    The program's amounts are rounded down; what they leave goes into sequences one by one, the
    largest pieces first and then the largest that still fits.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if not left:
        return []
    sizes = sorted(left)
    plan: list[tuple[dict[int, int], int]] = []
    for pattern, amount in generate_columns(left, capacity):
        used = {s: int(n) for s, n in zip(sizes, pattern, strict=True) if n}
        whole = min([int(amount + 1e-6), *(left[s] // n for s, n in used.items())])
        if whole > 0:
            plan.append((used, whole))
            for s, n in used.items():
                left[s] -= n * whole
    while rest := [s for s in sizes if left[s] > 0]:
        room, used = capacity, {}
        for s in reversed(rest):
            if n := min(room // s, left[s]):
                used[s], room = n, room - n * s
        whole = min(left[s] // n for s, n in used.items())
        plan.append((used, whole))
        for s, n in used.items():
            left[s] -= n * whole
    return plan


SLOTS = "size_class bigint, first bigint, past bigint, copies bigint, sequence bigint, slot bigint"


def _slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """For each class of a pattern: which ranks it takes, and the sequences and slots they get."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, whole in plan:
        slot = 0
        for size in sorted(used, reverse=True):
            n, first = used[size], taken.get(size, 0)
            rows.append((size, first, first + n * whole, n, sequence, slot))
            taken[size] = first + n * whole
            slot += n
        sequence += whole
    return rows


def pack(cut: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces (see :func:`pieces`) with ``sequence_id`` and ``offset``, gapless from 0.

    Every piece lies in exactly one sequence and no sequence exceeds ``length``. Equal pieces are
    ranked by hash bucket, id and start; ties and repeated rows take neighbouring slots. An empty
    table gives an empty one. ``cut`` is read three times, so it should be a written table. Only
    the histogram, at most ``length / WIDTH`` numbers, and the slots of the patterns pass through
    the driver, and the slots are the only thing sent to all tasks.
    """
    classed = cut.withColumn("size_class", F.ceil(F.col("length") / WIDTH))
    counts = {r[0]: r[1] for r in classed.groupBy("size_class").count().collect()}
    slots = cut.sparkSession.createDataFrame(_slots(plan_patterns(counts, length // WIDTH)), SLOTS)

    bucketed = classed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_BUCKETS)))
    by_class = Window.partitionBy("size_class").orderBy("_bucket")
    before = (
        bucketed.groupBy("size_class", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(by_class) - F.col("_n"))
        .select("size_class", "_bucket", "_before")
    )
    in_bucket = Window.partitionBy("size_class", "_bucket").orderBy("doc_id", "start")
    ranked = (
        bucketed.withColumn("_row", F.row_number().over(in_bucket) - 1)
        .join(before, ["size_class", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_row"))
    )
    placed = ranked.join(
        F.broadcast(slots.withColumnRenamed("size_class", "_class")),
        (F.col("size_class") == F.col("_class")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("past")),
    )
    nth = F.col("_rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("copies"))).withColumn(
        "_slot", F.col("slot") + nth % F.col("copies")
    )
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        *cut.columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the ids of each sequence of pieces cut ``with_ids``."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(
            F.array_sort(F.collect_list(part)), F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])
        ).alias("ids"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """:func:`pieces` written once to the shared folder, then :func:`pack`."""
    cut = pieces(docs, tokenizer_path, length, end_id).drop("ids")
    return pack(written(cut, "pieces"), length)
