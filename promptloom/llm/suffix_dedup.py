"""Repeated substrings by suffix sorting with difference covers.

A byte goes when a string of ``span`` bytes that covers it also starts earlier. Comparing all
suffixes of a corpus in one order is out of reach, and needless: only strings of ``span`` bytes
matter. So the work is dealt out by content first. Of the ``GRAM``-byte pieces in a string the one of
the smallest hash is its anchor; it depends on the string alone, hence equal strings have equal
anchors and meet in one partition. Neighbouring strings with the same anchor form a stretch, which
is one small row until its bytes are needed:

1. stretches are grouped by anchor. Where the same stretch stood earlier, all its strings repeat.
2. stretches whose anchor occurs with other surroundings are read again with their bytes, the first
   of each kind only. Each task sorts the suffixes of its stretches by the difference cover modulo
   three: triples at positions 1 and 2 (modulo 3) are sorted and named, the names are sorted by the
   same method until they differ or cover ``span`` bytes, the other suffixes follow from their
   first byte and the next name, and both orders are merged. Neighbours in the order with a common
   prefix of ``span`` bytes are the same string, and all but the earliest repeat.
   An anchor inside a passage shorter than ``span`` may have as many surroundings as there are documents.
   Its stretches are cut by the distance of the strings from the anchor, and each part is dealt by the
   bytes that all its strings contain; what meets nothing else there is done. Where even such a part has
   too many kinds, its strings are compared by a digest of 128 bits each, one by one.
3. the repeated places of a document are put together and cut out of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import Words, keep_ids, mix, slices, text_bytes, written

#: Bytes of a repeated string, and of the pieces that anchors are chosen from.
SPAN, GRAM = 100, 32
#: Bytes of stretches that are sorted at a time; stretches of one anchor stay together.
MOST_BYTES = 1 << 20
#: A place is a start, how far its anchor is from there, and how many starts it stands for, in one number.
PLACE, COUNT = 1 << 14, 1 << 7
#: An anchor with more kinds of stretches is dealt out again, by strings of neighbouring distances from it.
MOST_KINDS, NEIGHBOURS = 2_000, 16


def stretches(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Stretches of strings with one anchor: (text, place, anchor hash, hash of the bytes)."""
    words = Words(texts)
    n = len(words.buffer)
    empty = np.zeros(0, dtype=np.int64)
    if n < span:
        return empty, empty, empty, empty
    pieces = words.ranges(np.arange(n - GRAM + 1), np.arange(n - GRAM + 1) + GRAM)
    # position of the smallest piece among the next `width`, the last of equal ones, by doubling
    width, size = span - GRAM + 1, 1
    at = np.arange(len(pieces))
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(pieces[right] <= pieces[left], right, left)
        size += step
    text = np.searchsorted(words.text_start, np.arange(len(at)), side="right") - 1
    inside = np.arange(len(at)) + span <= words.text_start[text + 1] - 1
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty, empty, empty, empty
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]])
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    whole = mix(words.ranges(first, first + count - 1 + span) + count.astype(np.uint64))
    start = first - words.text_start[text[first]]
    place = start * PLACE + (at[first] - first) * COUNT + count
    return text[first], place, pieces[at[first]].view(np.int64), whole.view(np.int64)


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 in the order of the keys, equal for equal keys, and how many there are."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = np.diff(keys[order]) != 0
    names = np.empty(len(keys), dtype=np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (whole numbers from 1) in their order.

    Difference cover modulo three: triples at positions 1 and 2 are sorted and named; while names
    repeat, the string of names is sorted by the same method; the suffixes at 0 follow from a
    symbol and the next rank; last, each of them is placed by how many sampled ones are smaller.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([symbols, np.zeros(3, dtype=np.int64)])
    top = int(symbols.max()) + 1
    # a position past the end keeps the two halves of the string of names apart
    sample = np.flatnonzero(np.arange(n + (n % 3 == 1)) % 3)
    pairs = padded[sample] * top + padded[sample + 1]
    if top**3 > 1 << 62:
        pairs = _names(pairs)[0]
    names, kinds = _names(pairs * top + padded[sample + 2])
    if kinds < len(sample):
        ones = sample % 3 == 1
        string = np.concatenate([names[ones], names[~ones]])
        order = suffix_array(string)
        ranks = np.empty(len(order), dtype=np.int64)
        ranks[order] = np.arange(1, len(order) + 1)
        names = np.empty(len(sample), dtype=np.int64)
        names[ones], names[~ones] = ranks[: int(ones.sum())], ranks[int(ones.sum()) :]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    by_rank = np.empty(len(sample), dtype=np.int64)
    by_rank[names - 1] = sample
    by_rank = by_rank[by_rank < n]
    wide = len(sample) + 1

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(padded[rest] * wide + rank[rest + 1], kind="stable")]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    smaller = np.searchsorted(padded[ones] * wide + rank[ones + 1], padded[rest] * wide + rank[rest + 1])
    couples = padded[:-1] * top + padded[1:]
    if top * top * wide > 1 << 62:
        couples = _names(couples)[0]
    smaller += np.searchsorted(couples[twos] * wide + rank[twos + 2], couples[rest] * wide + rank[rest + 2])
    result = np.empty(n, dtype=np.int64)
    place = smaller + np.arange(len(rest))
    result[place] = rest
    free = np.ones(n, dtype=bool)
    free[place] = False
    result[free] = by_rank
    return result


def repeated_strings(
    stretch_bytes: list[bytes], doc: np.ndarray, start: np.ndarray, span: int = SPAN
) -> list[tuple[int, int, int]]:
    """Runs ``(doc, start, strings)`` of strings of the stretches that also start earlier.

    A stretch of k strings has ``k + span - 1`` bytes and begins at ``start`` of ``doc``.
    """
    buffer = np.frombuffer(b"".join(b + b"\0" for b in stretch_bytes), dtype=np.uint8)
    sizes = np.array([len(b) + 1 for b in stretch_bytes], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    symbols = buffer.astype(np.int64) + 2
    symbols[begin[1:] - 1] = 1
    order = suffix_array(symbols)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # suffixes that begin a string: the others run over the end of their stretch
    order = order[order + span < begin[owner[order] + 1]]
    new = np.ones(len(order), dtype=bool)
    offsets = np.arange(span)
    for i in range(1, len(order), 16384):
        now, last = order[i : i + 16384], order[i - 1 : i - 1 + min(16384, len(order) - i)]
        new[i : i + 16384] = (buffer[now[:, None] + offsets] != buffer[last[:, None] + offsets]).any(axis=1)
    kind = np.cumsum(new)
    at = start[owner[order]] + order - begin[owner[order]]
    by_kind = np.lexsort((at, doc[owner[order]], kind))
    order, kind, at = order[by_kind], kind[by_kind], at[by_kind]
    first = np.flatnonzero(np.diff(kind, prepend=0))[kind - 1]
    docs = doc[owner[order]]
    later = (docs != docs[first]) | (at != at[first])
    gone = np.sort(order[later])
    if not len(gone):
        return []
    breaks = np.flatnonzero(np.diff(gone) != 1) + 1
    heads = gone[np.concatenate([[0], breaks])]
    counts = np.diff(np.concatenate([[0], breaks, [len(gone)]]))
    whose = owner[heads]
    return list(zip(doc[whose].tolist(), (start[whose] + heads - begin[whose]).tolist(), counts.tolist(), strict=True))


# --- the three steps -------------------------------------------------------------------------------

STRETCHES = "anchor bigint, whole bigint, doc_id bigint, place bigint"
PLACES = "doc_id bigint, place bigint, anchor bigint"


def _batch(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
    anchors = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), anchors], ["doc_id", "place", "anchor"])


def _all_stretches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids = batch["doc_id"].to_numpy()
            text, place, anchor, whole = stretches(text_bytes(batch["text"]))
            columns = [anchor, whole, ids[text], place]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "whole", "doc_id", "place"])

    return texts.mapInArrow(run, STRETCHES)


def _by_anchor(found: DataFrame) -> DataFrame:
    """Stretches that stood earlier (``anchor`` null), and first ones among several kinds of an anchor.

    Rows come by anchor, hash, document and place; from one batch to the next only the first rows of
    the present anchor and hash are held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), dtype=np.int64)
        told = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            old = held.shape[1]
            rows = np.concatenate([held, np.array([batch[c].to_numpy() for c in ("anchor", "whole", "doc_id", "place")])], axis=1)
            anchor, whole, doc, place = rows
            new_anchor = np.ones(len(anchor), dtype=bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_whole = new_anchor.copy()
            new_whole[1:] |= whole[1:] != whole[:-1]
            first = np.maximum.accumulate(np.where(new_whole, np.arange(len(anchor)), 0))
            is_old = np.arange(len(anchor)) < old
            repeats = ~new_whole & ~is_old & ((doc != doc[first]) | (place != place[first]))
            yield _batch(doc[repeats], place[repeats], None)
            number = np.cumsum(new_anchor) - 1
            several = np.bincount(number, new_whole)[number] > 1
            mixed = new_whole & several & ~(is_old & told)
            yield _batch(doc[mixed], place[mixed], anchor[mixed])
            last_anchor = int(np.flatnonzero(new_anchor)[-1])
            last_whole = int(first[-1])
            keep = [last_anchor] if last_anchor == last_whole else [last_anchor, last_whole]
            held, told = rows[:, keep], bool(several[-1])

    order = ["anchor", "whole", "doc_id", "place"]
    return found.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, PLACES)


def _read_back(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``(doc_id, text, wanted)``: the documents of places (``doc_id``, ``place``, ``anchor``) with their lists."""
    # a list for each document, no longer than the document
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    wanted = written(wanted, "wanted")
    ids = written(wanted.select("doc_id"), "ids")
    return keep_ids(texts, ids, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "wanted")


def finer_parts(anchor: int, place: int, text: bytes, neighbours: int) -> Iterator[tuple[int, int]]:
    """Parts ``(anchor, place)`` of a stretch: strings of ``neighbours`` distances from the anchor each.

    The new anchor is made of the old one, the distances, and the bytes that all strings of such
    distances contain.
    """
    start, distance, count = place // PLACE, place // COUNT % COUNT, place % COUNT
    at = start + distance
    for block in range((distance - count + 1) // neighbours, distance // neighbours + 1):
        far, near = min(distance, (block + 1) * neighbours - 1), max(distance - count + 1, block * neighbours)
        core = text[at - block * neighbours : at - (block + 1) * neighbours + 1 + SPAN]
        digest = hashlib.blake2b(core, digest_size=8, key=b"%d/%d" % (anchor, block)).digest()
        yield (
            int.from_bytes(digest, "little", signed=True),
            (at - far) * PLACE + far * COUNT + far - near + 1,
        )


def _finer(texts: DataFrame, places: DataFrame, neighbours: int) -> DataFrame:
    """Places cut by :func:`finer_parts`, those whose new anchor occurs more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for doc, text, wanted in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["wanted"].to_pylist(), strict=True):
                for w in wanted:
                    out += [(doc, place, anchor) for anchor, place in finer_parts(w["anchor"], w["place"], text, neighbours)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "place", "anchor"])

    parts = written(_read_back(texts, places).mapInArrow(run, PLACES), "parts")
    again = written(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    return parts.join(again, "anchor").select("doc_id", "place", "anchor", "n")


def _split_hot(places: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Places of anchors with few kinds, and those of anchors with many, if there are any."""
    hot = written(counts.where(F.col("n") > MOST_KINDS).select("anchor"), "hot")
    if hot.isEmpty():
        return places, None
    return keep_ids(places, hot, "anchor", "left_anti"), keep_ids(places, hot, "anchor")


def _equal_strings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Repeats among single strings, by digests of 128 bits; equal ones are combined before they meet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            for doc, text, wanted in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["wanted"].to_pylist(), strict=True):
                for w in wanted:
                    start = w["place"] // PLACE
                    for i in range(start, start + w["place"] % COUNT):
                        out.append((doc, i * PLACE + 1, hashlib.blake2b(text[i : i + SPAN], digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["doc_id", "place", "string"],
            )

    strings = written(_read_back(texts, places).mapInArrow(run, "doc_id bigint, place bigint, string binary"), "strings")
    firsts = strings.groupBy("string").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    later = strings.join(firsts, "string").where(F.struct("doc_id", "place") != F.col("first"))
    return later.select("doc_id", "place")


def _sorted_repeats(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """Repeated strings among first stretches that share an anchor, by suffix sorting."""
    counts = mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    mixed, hot = _split_hot(mixed, counts)
    if hot is None:
        return _suffix_sorted(texts, mixed)
    parts = _finer(texts, hot, NEIGHBOURS)
    parts, hot = _split_hot(parts.drop("n"), parts.select("anchor", "n").distinct())
    found = _suffix_sorted(texts, mixed.select("doc_id", "place", "anchor").union(parts.select("doc_id", "place", "anchor")))
    return found if hot is None else found.union(_equal_strings(texts, hot))


def _suffix_sorted(texts: DataFrame, places: DataFrame) -> DataFrame:
    read = _read_back(texts, places)

    def bytes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            for doc, text, wanted in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["wanted"].to_pylist(), strict=True):
                for w in wanted:
                    start, count = w["place"] // PLACE, w["place"] % COUNT
                    out.append((w["anchor"], doc, start, text[start : start + count - 1 + SPAN]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)],
                ["anchor", "doc_id", "start", "bytes"],
            )

    parts = read.mapInArrow(bytes_of, "anchor bigint, doc_id bigint, start bigint, bytes binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def sort(rows: pa.Table) -> pa.RecordBatch:
            found = repeated_strings(rows["bytes"].to_pylist(), rows["doc_id"].to_numpy(), rows["start"].to_numpy())
            docs = np.array([d for d, _, _ in found], dtype=np.int64)
            places = np.array([s * PLACE + n for _, s, n in found], dtype=np.int64)
            return _batch(docs, places, None)

        for batch in slices(batches, "bytes", MOST_BYTES // 2):
            held.append(batch)
            size += batch["bytes"].nbytes
            if size < MOST_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:  # what shares the last anchor waits for the rest of it
                yield sort(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b["bytes"].nbytes for b in held)
        if held:
            yield sort(pa.Table.from_batches(held))

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, PLACES).drop("anchor")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)`` of every row.

    Texts are UTF-8 bytes; each byte goes that a string of ``SPAN`` bytes covers which also starts
    earlier, in a document of smaller id or further ahead in its own; strings are judged on the
    input. ``spans`` are the removed runs as ``(start, end)``, ``kept`` the remaining bytes, which
    may end within a character. Null and empty texts have no bytes. Rows without id come before all
    others. Rows that repeat an id are one document: equal rows lose the same bytes, and do not make
    each other go. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("id", F.lit(-(1 << 63)).cast("bigint")))
    texts = rows.select("doc_id", "text")
    places = written(_by_anchor(_all_stretches(texts)), "places")
    mixed = places.where("anchor IS NOT NULL")
    repeats = written(_sorted_repeats(texts, mixed), "repeats")
    gone = places.where("anchor IS NULL").drop("anchor").union(repeats)
    # a list for each document, no longer than the document
    gone = gone.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    both = rows.join(gone, "doc_id", "left").select("id", "text", "places")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc, text, found in zip(batch["id"].to_pylist(), text_bytes(batch["text"]), batch["places"].to_pylist(), strict=True):
                place = np.array(found or [], dtype=np.int64)
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(edge, np.minimum(place // PLACE, len(text)), 1)
                np.add.at(edge, np.minimum(place // PLACE + place % COUNT - 1 + SPAN, len(text)), -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()
                turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                digest = hashlib.sha256(kept).hexdigest()
                spans = [{"start": a, "end": b} for a, b in turns.tolist()]
                out.append((doc, len(text), len(text) - len(kept), len(turns), digest, spans, kept))
            kinds = [
                *[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    result = (
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return both.mapInArrow(run, result)

