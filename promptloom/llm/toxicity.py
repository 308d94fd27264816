"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a word model.

A token that mixes letters with digits or signs, repeats a letter three times or more, or is spelt
out letter by letter, is a lattice: each sign stands for some letters, a run of one letter for one
or two of it, separators for nothing. The Viterbi algorithm finds the likeliest paths under a
character trigram model, counted from the words of all documents; a word of the lexicon among
them gets a prior. The lexicon (words that mark toxic texts) and the weights of its words come from
labelled rows, of which at most ``MAX_LABELLED`` are used, the first by hash of their id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import Words, crc32_text, fresh, keep_ids, mix, slices, text_bytes, written

#: The classifier is fitted on so many labelled rows at most.
MAX_LABELLED = 20_000
#: A word of the lexicon stands in so many different toxic texts, and that many standard deviations
#: more often than chance would have it.
LEXICON_TEXTS, LEXICON_SCORE = 4, 6.0
#: Letters that signs stand for in disguised words.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
ANY_LETTER = "abcdefghijklmnopqrstuvwxyz"
#: Costs in natural logarithms: a sign for a letter, a hidden letter, a run that loses letters.
SIGN_COST, HIDDEN_COST, RUN_COST = 1.0, 3.0, 0.5
#: The prior that a lexicon word has over other letter sequences, and the paths that are kept.
WORD_PRIOR, PATHS = 8.0, 4
#: Letters of a stem.
STEMS = (5, 6, 7)
#: No word is longer; longer tokens are no disguised words.
LONGEST_WORD = 40
CACHE_TOKENS = 200_000
#: Character classes: 0 ends words, 1-26 a-z, the rest other letters.
CLASSES = 64

#: Signs that stand for a letter each; a word hides so many at most.
HIDING, MOST_HIDDEN = "*#%&?", 2

_EDGE = ".,;:!?\"'()[]{}<>«»„“”…%&#=~^"
_LETTERS = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
_SPELT = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def char_class(c: str) -> int:
    i = ord(c)
    if 97 <= i <= 122:
        return i - 96
    return 27 + (i - 0xDF if 0xDF <= i <= 0xFF else 33 + i % 4)


# --- the character model -------------------------------------------------------------------------


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(word, n)`` of the lower-cased letter runs of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, column):
            counts: Counter[str] = Counter()
            for text in batch[column].to_pylist():
                if text:
                    counts.update(_LETTERS.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

    each = texts.select(F.col(column).cast("string").alias(column)).mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities of a character class after two others, from ``(word, n)``.

    The counts grow with the corpus; the table that reaches the driver has at most ``CLASSES ** 3``
    rows. Adding a tenth to every count keeps unseen ones possible.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            seen: Counter[int] = Counter()
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                a = b = 0
                for c in [*map(char_class, word), 0]:
                    seen[(a * CLASSES + b) * CLASSES + c] += n
                    a, b = b, c
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"]
            )

    rows = counts.mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    table = np.full(CLASSES**3, 0.1)
    for code, n in rows:
        table[code] += n
    table = table.reshape(CLASSES, CLASSES, CLASSES)
    return np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def features(word: str) -> list[str]:
    """A word and its stems: its first letters with a mark, for words that only differ in endings."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


# --- restoration ---------------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the letters it may stand for, with their costs."""
    places: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token):
        c, n = m[1], len(m[0])
        if c.isalpha():
            if n == 1:
                places.append([(c, 0.0)])
            else:
                places.append([(c, RUN_COST if n > 2 else 4 * RUN_COST), (c + c, RUN_COST if n > 2 else 0.0)])
        elif c in SIGNS:
            options = [(x, SIGN_COST) for x in SIGNS[c]]
            if n > 1:
                options += [(x + x, SIGN_COST) for x in SIGNS[c]]
            places.append(options)
        elif c in HIDING:
            places.extend([[(x, HIDDEN_COST) for x in ANY_LETTER]] * n)
    return places


def decode(token: str, model: np.ndarray) -> list[tuple[float, str]]:
    """The likeliest letter sequences of a token with their log probabilities, best first."""
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for options in [*lattice(token), [("", 0.0)]]:
        reached: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for letters, cost in options:
                x, y, gain = a, b, -cost
                for c in map(char_class, letters) if letters else (0,):
                    gain += float(model[x, y, c])
                    x, y = y, c
                reached.setdefault((x, y), []).extend((score + gain, path + letters) for score, path in paths)
        states = {s: sorted(paths, reverse=True)[:PATHS] for s, paths in reached.items()}
    return sorted((p for paths in states.values() for p in paths), reverse=True)[:PATHS]


def disguised(core: str) -> bool:
    """Whether a token may be a disguised word: it has letters, and something words do not have."""
    return (
        2 < len(core) <= LONGEST_WORD
        and any(c.isalpha() for c in core)
        and (not core.isalpha() or _THRICE.search(core) is not None)
        and sum(map(core.count, HIDING)) <= MOST_HIDDEN
    )


class Restorer:
    """Words and stems of a text, disguised words restored; with a lexicon, only its entries."""

    def __init__(self, model: np.ndarray, lexicon: Iterable[str] | None = None):
        self.model = model
        self.lexicon = None if lexicon is None else frozenset(lexicon)
        self.seen: dict[str, tuple[str, ...]] = {}

    def _best(self, token: str) -> str:
        paths = decode(token, self.model)
        if not paths:
            return ""
        known = self.lexicon or ()
        return max((score + WORD_PRIOR * any(f in known for f in features(word)), word) for score, word in paths)[1]

    def _words(self, token: str) -> tuple[str, ...]:
        words = set(_LETTERS.findall(token))
        plain = token.strip(_EDGE + "*$|-_/")
        ending = token.strip(_EDGE + "*|-_/")
        for core in {plain, ending if len(ending) - len(plain) <= 2 else plain}:
            if disguised(core):
                words.add(self._best(core))
        found = {f for w in words for f in features(w)}
        return tuple(found if self.lexicon is None else found & self.lexicon)

    def words(self, text: str) -> set[str]:
        text = text.lower()
        tokens = text.split()
        if len(self.seen) > CACHE_TOKENS:
            self.seen.clear()
        found: set[str] = set()
        for token in set(tokens):
            words = self.seen.get(token)
            if words is None:
                words = self.seen[token] = self._words(token)
            if words:
                found.update(words)
        if sum(1 for t in tokens if len(t) == 1) >= 3:
            for run in _SPELT.findall(text):
                letters = "".join(run.split())
                word = self._best(letters) if disguised(letters) else letters
                if self.lexicon is None:
                    found.update(features(word))
                else:
                    found.update(w for w in self.lexicon if w in features(word) or (len(w) > 4 and w in word))
        return found


# --- the classifier ------------------------------------------------------------------------------


@dataclass
class Model:
    """Character model, weights of lexicon words, bias."""

    characters: np.ndarray
    weights: dict[str, float]
    bias: float

    def score(self, text: Column) -> Column:
        """Probability between 0 and 1 that a text is toxic; null counts as empty."""
        characters, weights, bias = self.characters, self.weights, self.bias

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            fresh()
            restorer = Restorer(characters, weights)
            for part in parts:
                # some texts at a time, so that they do not all stand beside the batch as objects
                sums = np.array(
                    [
                        bias + sum(weights[w] for w in restorer.words(t)) if t else bias
                        for i in range(0, len(part), 256)
                        for t in part.slice(i, 256).to_pylist()
                    ],
                    dtype=np.float64,
                )
                yield pa.array(1 / (1 + np.exp(-sums)), pa.float64())

        run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(crc32_text(doc_id) % 5 == 0, F.lit(False))


def _fit_weights(rows: list[tuple[float, list[int]]], n: int) -> tuple[np.ndarray, float]:
    """Logistic regression on word presence by accelerated gradient steps, with a ridge."""
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    word = np.array([w for r in rows for w in r[1]], dtype=np.int64)
    weights, bias = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    ahead, ahead_bias, step = weights.copy(), bias, 4.0 / max(1, np.bincount(row, minlength=1).max() + 1)
    for i in range(1500):
        margin = ahead_bias + np.bincount(row, ahead[word], minlength=len(rows))
        error = 1 / (1 + np.exp(-margin)) - y
        slope = (np.bincount(word, error[row], minlength=n) + 0.02 * ahead) / len(rows)
        new, new_bias = ahead - step * slope * 20, ahead_bias - step * error.mean()
        ahead = new + i / (i + 3) * (new - weights)
        ahead_bias = new_bias + i / (i + 3) * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from all ``docs`` (``doc_id``, ``text``) and the ``labels`` (``doc_id``, ``toxic``).

    Only rows that are not :func:`held_out` are learned from; rows without label are left out, a
    document with several labels counts as toxic if one says so. Without any label every text gets
    the same score, 0.5 or the share of toxic labels.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    characters = character_model(word_counts(texts))
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        restorer = Restorer(characters)
        for batch in slices(batches, "text"):
            found = [sorted(restorer.words(t)) if t else [] for t in batch["text"].to_pylist()]
            words = Words(text_bytes(batch["text"]))
            starts = mix(words.windows(4))
            # texts that share their smallest window are taken for copies of each other
            kind = [int(starts[a:b].min() >> np.uint64(1)) if b > a else 0 for a, b in zip(words.first, words.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array(kind, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                ["toxic", "kind", "words"],
            )

    # the sample is bounded by max_labelled
    rows = texts.join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = written(rows.mapInArrow(run, "toxic int, kind bigint, words array<string>"), "labelled")
    # one row stands for the copies of a text
    kinds = rows.groupBy("kind").agg(F.max(F.struct("toxic", "words")).alias("row")).select("row.*")
    total, toxic = kinds.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = min(max(toxic / max(total, 1), 1e-6), 1 - 1e-6)
    hits = kinds.where("toxic = 1").select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("hits"))
    hits = written(hits.where(F.col("hits") >= LEXICON_TEXTS), "hits")
    clean = kinds.where("toxic = 0").select(F.explode("words").alias("word"))
    clean = keep_ids(clean, hits.select("word"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("clean"))
    by_word = hits.join(clean, "word", "left").withColumn("n", F.col("hits") + F.coalesce("clean", F.lit(0)))
    excess = (F.col("hits") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
    marked = by_word.where((excess >= LEXICON_SCORE) & (F.col("hits") > 0.5 * F.col("n")))
    words = sorted(r[0] for r in marked.where(F.length("word").between(2, LONGEST_WORD)).select("word").collect())
    place = {w: i for i, w in enumerate(words)}
    # at most one short list of numbers for each of the sampled rows
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    sampled = rows.select("toxic", F.array_intersect("words", known).alias("words")).collect()
    if not sampled:
        return Model(characters, {}, 0.0)
    weights, bias = _fit_weights([(float(t), [place[w] for w in ws]) for t, ws in sampled], len(words))
    return Model(characters, dict(zip(words, weights.tolist(), strict=True)), bias)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null and empty texts get the bias.

    Only the text is scored. Rows without id are not held out. Repeated rows are scored each.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        model.score(F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
