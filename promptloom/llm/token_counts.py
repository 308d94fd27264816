"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are counted without building them: the vocabulary is a
trie; where no edge goes on, a failure link leads to the node of what is left after the pieces that
can be decided have been taken off, and the number of these pieces is stored with the link. Every
byte moves the automaton forward once and links only take off pieces, so a word costs its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import slices, text_bytes, worker_cache

#: Entries of a worker's table of counts by word, and the longest word kept in it.
CACHE_WORDS, CACHE_BYTES = 800_000, 64


class Automaton:
    """Counts of greedy longest-match pieces; a word that pieces cannot make up counts as one."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                found = self.next[node].get(byte)
                if found is None:
                    found = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = found
            whole[node] = node > 0
        # failure link (-1: none) and the pieces taken off by following it, breadth first
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, taken = self.link[parent], self.popped[parent]
                    while at >= 0 and byte not in self.next[at]:
                        taken += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.next[at][byte], taken
            level = below

    def count(self, word: bytes) -> int:
        node = total = 0
        edges, link, popped = self.next, self.link, self.popped
        for byte in word:
            found = edges[node].get(byte)
            while found is None:
                if link[node] < 0:
                    return 1
                total += popped[node]
                node = link[node]
                found = edges[node].get(byte)
            node = found
        while node:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


def byte_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file, as bytes; special tokens left out.

    Such files write each byte as a printable character: printable bytes of Latin-1 as themselves,
    the others as the characters from code 256 on, in order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [bytes(byte_of[c] for c in t) for t in model["model"]["vocab"] if t not in special]


COUNTS = "doc_id bigint, n_words bigint, n_tokens bigint, longest_word bigint"


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens, longest_word)`` of every row.

    Words are runs without ASCII white space, each taken with a blank before it, so that pieces
    that start with a blank start words. ``longest_word`` is in tokens. Null and empty texts have
    no words and no tokens. Repeated rows are counted each; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("word pieces")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = Automaton(byte_pieces(tokenizer_path)), {}
        automaton, known = cache[tokenizer_path]

        def of(words: Sequence[bytes]) -> tuple[int, int]:
            if len(known) > CACHE_WORDS:
                known.clear()
            for word in set(words).difference(known):
                known[word] = automaton.count(b" " + word)
            counts = list(map(known.__getitem__, words))
            return sum(counts), max(counts, default=0)

        for batch in slices(batches, "text"):
            split = [t.split() for t in text_bytes(batch["text"])]
            totals = [of(words) for words in split]
            for words in split:
                for word in words:
                    if len(word) > CACHE_BYTES:
                        known.pop(word, None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(w) for w in split], pa.int64()),
                    pa.array([t for t, _ in totals], pa.int64()),
                    pa.array([m for _, m in totals], pa.int64()),
                ],
                ["doc_id", "n_words", "n_tokens", "longest_word"],
            )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, COUNTS)
