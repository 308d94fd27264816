"""Structured Streaming versions of the operators.

Transformations take and return streaming DataFrames; :func:`run_to_table` drives one into a table of
batches, and :func:`latest_rows` reads the current value of every key back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from promptloom.functions import fixed_values as V
from promptloom.functions.tokens import Scorer
from promptloom.operators.compression import compress
from promptloom.operators.conversation import completion_aggregates, completion_flags, with_complete
from promptloom.operators.logs import call_usage, chunk_tokens, chunk_usage
from promptloom.operators.run_state import data_events


def compress_stream(
    prompts: DataFrame,
    text: str = "text",
    ratio: float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Compress arriving prompts; stateless, the same expressions as in batch.

    Name ``partitions`` only if a micro-batch arrives in fewer splits than there are cores.
    """
    arrived = prompts.repartition(partitions) if partitions else prompts
    return arrived.transform(compress(text, ratio, scorer))


def call_usage_stream(chunk_rows: DataFrame) -> DataFrame:
    """Running usage per call (update mode): two counters of state per call."""
    return call_usage(chunk_usage(chunk_rows))


def closed_call_usage_stream(
    chunk_rows: DataFrame, event_time: str, idle: str, late: str
) -> DataFrame:
    """Usage per call, once it has been idle (append mode); the state of closed calls is dropped.

    A chunk that arrives after the watermark (``late`` behind the newest event) has passed its call
    is left out, and one after a longer pause than ``idle`` counts as another call.
    """
    usage = chunk_usage(chunk_rows, event_time).withWatermark(event_time, late)
    closed = call_usage(usage, F.session_window(event_time, idle).alias("active"))
    return closed.select(
        "call_id",
        F.col("active.start").alias("started"),
        F.col("active.end").alias("closed"),
        "input_tokens",
        "output_tokens",
    )


def call_tokens_stream(chunk_rows: DataFrame, family: Column | str = "claude") -> DataFrame:
    """Tokens of arriving chunks (append mode), without state; fold what was written by ``call_text``.

    A call's text is then never written again as it grows, and reading it touches its tokens once.
    """
    return chunk_tokens(chunk_rows, family)


def run_events_stream(lines: DataFrame) -> DataFrame:
    """Latest event per run, kind and subtask (update mode); reduce with ``operators.run_state``."""
    last = F.max(F.struct("seq", "status", "payload")).alias("_l")
    return data_events(lines).groupBy("run_id", "event", "subtask_id").agg(last).select(
        "run_id", "event", "subtask_id", "_l.*"
    )


def phase_complete_stream(turns: DataFrame) -> DataFrame:
    """Running completion decision per conversation (update mode): three flags of state."""
    flags = completion_flags(turns)
    return with_complete(flags.groupBy("conv_id").agg(*completion_aggregates()))


#: State store of the stateful operators of :mod:`promptloom.streaming.keyed`.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update", keyed: bool = False
) -> StreamingQuery:
    """Start a stream that writes every micro-batch's changed rows below ``path``.

    A replayed batch overwrites its own folder, so results are exactly-once. ``keyed`` starts the query
    with the state store that the operators of ``streaming.keyed`` need; the session's own is left
    as it is, as a query keeps the settings it was started with.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    conf = stream.sparkSession.conf
    before = conf.get(_STORE, None)
    try:
        if keyed:
            conf.set(_STORE, _KEYED_STORE)
        return (
            stream.writeStream.foreachBatch(write)
            .outputMode(output_mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if keyed:
            conf.unset(_STORE) if before is None else conf.set(_STORE, before)


def latest_rows(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """Rows of the newest batch of every key; all rows when no keys are named."""
    with_batch = StructType([*schema.fields, StructField("batch_id", LongType())])
    written = spark.read.option("basePath", path).schema(with_batch).parquet(path)
    if not keys:
        return written.drop("batch_id")
    newest = written.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    same = [written[k].eqNullSafe(newest[k]) for k in [*keys, "batch_id"]]
    return written.join(newest, same, "left_semi").drop("batch_id")


def drain(
    stream: DataFrame, folder: str, keys: list[str], output_mode: str = "update", keyed: bool = False
) -> DataFrame:
    """Run a stream over everything that has arrived and return its current rows."""
    spark = stream.sparkSession
    query = run_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint", output_mode, keyed)
    query.awaitTermination()
    return latest_rows(spark, f"{folder}/rows", keys, stream.schema)
