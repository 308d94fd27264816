"""The corpus pipeline: toxicity, near duplicates, secrets, mixing and packing over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import mixing, ngram_join, packing, secret_scan, toxicity
from promptloom.llm.common import free_names, table, written
from promptloom.llm.queries import WEIGHTS, domain, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it is fitted on all documents it is given.

    Columns of any name are kept. An empty table gives an empty one.
    """
    (score,) = free_names(docs, "_score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(score, model.score(F.col("text"))).where(F.col(score) < 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id, then digest of the text, of each group of near duplicates; rows without id all stay.

    Near duplicates share 80 % of their five-word shingles, or are linked by such documents. Rows of
    the same id are compared by their texts like any others; of those equal in both the smallest row,
    by the columns in their order, stays. Columns of any name are kept. An empty table gives an empty one.
    """
    # a row goes by the digest of its id and text, so that ids that several texts share stay apart
    (row,) = free_names(docs, "_row")
    named = docs.where("doc_id IS NOT NULL").withColumn(row, F.xxhash64("doc_id", "text"))
    found = ngram_join.jaccard_components(named.select(F.col(row).alias("row"), "text"), width=5, percent=80, id_col="row")
    groups = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    places = named.select("doc_id", F.col(row).alias("row"), F.xxhash64(F.lit("second"), F.col("text")).alias("digest"))
    first = F.min(F.struct("doc_id", "digest", "row"))
    kept = places.join(groups, "row").groupBy("group").agg(first["row"].alias(row)).select(row)
    one = named.join(kept, row).groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("all"))
    return one.select("all.*").unionByName(docs.where("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; ``n_chars`` counts the new text. An empty table gives an empty one."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture to the target weights takes them. An empty table gives an empty one."""
    taken = mixing.copies(docs, WEIGHTS, most_epochs=2, share=0.8, seed=7, domain=domain())
    return mixing.mixed(docs, taken).select(docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. An empty table gives an empty one."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Restored texts, random test batteries and the linear program are beyond SQL; tests use brute force.
ORACLE_SQL: str | None = None
