"""Line deduplication: runs of lines or sentences that stood in an earlier document, or earlier in its own, go.

Units are the lines of a text, or their sentences. They are normalised (lower case, blanks and punctuation
at word ends aside), digested, and grouped by digest over the whole corpus; the occurrence of the smallest
rank, (document id, unit number), stays. Every unit that has a word is compared, but a short line that
hundreds of documents share is no copied passage, so a repeated unit goes only when the run of consecutive
repeated units in which it stands has ``least_run`` words, or is the whole document. What goes is reported
with its place in the original text. Only digests are shuffled until the last join, and texts once; a
digest is grouped with map-side combination, and the join back to its occurrences is one that the engine
can split under a frequent line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import let, running_total, written

#: By default a line of fewer words is left alone; the registered query compares every line that has a word.
LEAST_WORDS = 8
#: Words of the shortest run of repeated units that the registered query removes: about a hundred characters.
LEAST_RUN = 18
#: Where a sentence of a line ends: after its mark and one blank.
SENTENCE_END = r"(?<=[.!?][\x20\x09\x0B-\x0D])"


def normalised(line: Column) -> Column:
    """The form in which lines are compared: lower case, one blank between words, no ,.;:!? at the ends of words."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D,.;:!?]*(?:[\x20\x09-\x0D]|$)[\x20\x09-\x0D]*", " "))


def n_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def parts_of(text: Column, separator: str, sentences: bool) -> Column:
    """The text cut into units, ``array<struct<line, text, width>>``: width is the unit's length and that of a separator after it."""
    lines = F.split(text, separator, -1)
    if not sentences:
        return F.transform(lines, lambda u, i: F.struct(i.alias("line"), u.alias("text"), (F.length(u) + len(separator)).alias("width")))

    def of_line(line: Column, i: Column) -> Column:
        def numbered(found: Column) -> Column:
            return F.transform(
                found,
                lambda u, j: F.struct(
                    i.alias("line"), u.alias("text"), (F.length(u) + F.when(j == F.size(found) - 1, len(separator)).otherwise(0)).alias("width")
                ),
            )

        # bound, as it would be split anew for each of its sentences
        return let(F.split(line, SENTENCE_END, -1), numbered)

    return F.flatten(F.transform(lines, of_line))


def units(docs: DataFrame, separator: str, sentences: bool, least_words: int) -> DataFrame:
    """``(doc_id, copy, pos, nth, words, of, one, two)``: place and two digests of each unit long enough to be compared.

    ``nth`` counts the document's units that are compared, of which there are ``of``.
    """

    def normed(u: Column, i: Column) -> Column:
        return let(normalised(u["text"]), lambda n: F.struct(i.alias("pos"), n.alias("norm"), n_words(n).alias("words")))

    def compared(found: Column) -> Column:
        kept = F.filter(F.transform(found, normed), lambda u: u["words"] >= least_words)
        return let(kept, lambda k: F.transform(k, lambda u: F.struct(u["pos"], u["norm"], u["words"], F.size(k).alias("of"))))

    # all inside the generator: a filter on a computed column would normalise every unit again
    found = let(parts_of(F.col("text"), separator, sentences), compared)
    texts = docs.select("doc_id", "copy", F.posexplode(found).alias("nth", "u"))
    return texts.select(
        "doc_id", "copy", "u.pos", "nth", "u.words", "u.of",
        F.xxhash64("u.norm").alias("one"), F.xxhash64(F.lit("second"), F.col("u.norm")).alias("two"),
    )


def runs(later: DataFrame, least_run: int) -> DataFrame:
    """``(doc_id, copy, gone, n_repeated)`` of documents with repeated units: the numbers of those that go, and how many there are."""
    # repeated rows of a document have the same units, which count once
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "copy").orderBy("nth"))
    found = later.withColumn("run", F.col("nth") - rank).groupBy("doc_id", "copy", "run").agg(
        F.collect_set(F.struct("pos", "words")).alias("units"), F.max("of").alias("of")
    )
    words = F.aggregate("units", F.lit(0).cast("bigint"), lambda n, u: n + u["words"])
    found = found.withColumn("at", F.col("units.pos"))
    goes = (words >= least_run) | (F.size("at") == F.col("of"))
    none = F.array().cast("array<int>")
    # one list for each document, no longer than the document
    return found.groupBy("doc_id", "copy").agg(
        F.flatten(F.collect_list(F.when(goes, F.col("at")).otherwise(none))).alias("gone"), F.sum(F.size("at")).alias("n_repeated")
    )


def dedup(
    docs: DataFrame,
    separator: str = "\n",
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: bool = False,
    least_run: int = 0,
) -> DataFrame:
    """``(doc_id, n_units, n_repeated, n_removed, spans, text)``: the text without its repeated units.

    ``separator`` is a pattern for a fixed string: ``\\n`` compares lines, ``\\n\\n`` paragraphs; with ``sentences`` the
    units are the sentences of each, which end after ``.!?`` and one blank. Units of fewer than ``least_words`` words are not
    compared and all stay; 1 compares all that have a word. ``n_repeated`` counts the units that stood before, and
    ``n_removed`` those of them that go: all whose run has ``least_run`` words or more, or is all of the
    document that is compared. A run is made of repeated units between which no other compared unit stands.
    ``spans`` lists the removed units as ``start:end`` in code points of the original text, end exclusive, without
    the separator; what is kept of each line stays a line, and lines are joined by the separator. Ids rank documents, null
    first; rows of the same id and text are one document, whose units are removed from each alike.
    Null and empty texts are empty, and have one empty unit. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("copy", F.xxhash64("text"))
    # places and digests alone are written, so that the texts are cut and normalised once
    found = written(units(rows, separator, sentences, least_words), "units")
    place = F.struct("doc_id", "copy", "pos")
    firsts = (
        found.groupBy("one", "two")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("one", "two", "first")
    )
    later = found.join(written(firsts, "firsts"), ["one", "two"]).where(
        ~place.eqNullSafe(F.col("first"))
    )
    gone = written(runs(later, least_run), "gone")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.array_sort("gone").alias("gone"), "n_repeated")
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")

    def cut(parts: Column) -> Column:
        starts = running_total(F.transform(parts, lambda u: u["width"].cast("bigint")))
        spans = let(
            starts,
            lambda s: F.transform(
                F.col("gone"), lambda p: F.concat_ws(":", F.get(s, p), F.get(s, p) + F.length(F.get(parts, p)["text"]))
            ),
        )
        # a sign for each unit up to the last that goes, made of the distances between those that go
        steps = F.transform(F.col("gone"), lambda p, i: F.when(i == 0, p).otherwise(p - F.get("gone", i - 1) - 1))
        signs = F.split(F.array_join(F.transform(steps, lambda n: F.concat(F.repeat(F.lit("+"), n), F.lit("-"))), ""), "")
        kept = let(signs, lambda s: F.filter(parts, lambda u, i: ~F.coalesce(F.get(s, i) == "-", F.lit(False))))
        joined = let(
            kept,
            lambda k: F.transform(
                k,
                lambda u, i: F.when((i == 0) | (F.get(k, i - 1)["line"] == u["line"]), u["text"]).otherwise(F.concat(F.lit(separator), u["text"])),
            ),
        )
        return F.struct(F.array_join(spans, ",").alias("spans"), F.array_join(joined, "").alias("kept"), F.size(parts).alias("n"))

    none = lambda parts: F.struct(F.lit("").alias("spans"), F.col("text").alias("kept"), F.size(parts).alias("n"))
    done = let(parts_of(F.col("text"), separator, sentences), lambda p: F.when(F.size("gone") > 0, cut(p)).otherwise(none(p)))
    zero = F.lit(0)
    return rows.withColumn("_cut", done).select(
        "doc_id",
        F.col("_cut.n").cast("bigint").alias("n_units"),
        F.coalesce("n_repeated", zero).cast("bigint").alias("n_repeated"),
        F.when(F.col("gone").isNull(), zero).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.col("_cut.spans").alias("spans"),
        F.col("_cut.kept").alias("text"),
    )
