"""Table, request, log and frame sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.functions.text import display_text, normalise_content

_REQUEST_SCHEMA = "struct<messages:array<struct<role:string,content:variant>>,phase:string>"
_PHASES = ("elicit", "generate")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Scan a table as it is: ``parquet``, ``json`` (an object a line) or ``text`` (the column ``value``).

    JSON is read by the ``schema`` it was written with; without one, Spark would read all of it once more to infer one.
    """
    if kind == "json" and schema is None:
        raise ValueError("name the schema of a JSON table")
    reader = spark.read.schema(schema) if schema and kind != "text" else spark.read
    return reader.format(kind).load(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Write a table; as ``text`` its one string column, in which line breaks have to be escaped."""
    if kind == "text" and len(rows.columns) != 1:
        raise ValueError("a text table has one column")
    options = {"ignoreNullFields": "false"} if kind == "json" else {}
    rows.write.format(kind).mode(mode).options(**options).save(path)


def spread(scan: DataFrame, partitions: int | None, *columns: str) -> DataFrame:
    """Spread a scan in front of heavy per-row work over ``partitions``; None leaves it as it is.

    Meant for tables in few files. Rows are hashed by ``columns`` (all when none is named), so long
    documents do not end up together by their length.
    """
    return scan.repartition(partitions, *[F.col(c) for c in columns or scan.columns]) if partitions else scan


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scan text files, one row ``(file, line)`` per line, in no particular order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scan text logs whose line order matters, as ``(file, seq, line)`` with ``seq`` from 0.

    Lines are numbered inside each split of a file, and the splits before it are counted; so one
    large file is read and numbered by many tasks.
    """
    split = ["file", "_start"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    in_split = F.row_number().over(Window.partitionBy(*split).orderBy("_id")).cast("bigint") - 1
    splits_before = (
        Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        lines.groupBy(*split)
        .count()
        .select(*split, F.coalesce(F.sum("count").over(splits_before), F.lit(0)).alias("_offset"))
    )
    return (
        lines.withColumn("_n", in_split)
        .join(offsets, split)
        .select("file", (F.col("_offset") + F.col("_n")).alias("seq"), "line")
    )


def request_messages(bodies: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """Message rows ``(key, phase, status, turn, role, text)`` of chat request bodies.

    ``messages`` defaults to none and ``phase`` to elicit; another phase has status
    ``unknown_phase``. A request without messages is one row without turn.
    """
    parsed = bodies.select(key, F.from_json(F.col(body), _REQUEST_SCHEMA).alias("_b")).select(
        key, F.coalesce(F.col("_b.phase"), F.lit("elicit")).alias("phase"), F.col("_b.messages").alias("_m")
    )
    return parsed.select(key, "phase", F.posexplode_outer("_m").alias("turn", "_t")).select(
        key,
        "phase",
        F.when(F.col("phase").isin(*_PHASES), "ok").otherwise(F.lit("unknown_phase")).alias("status"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("_t.role").alias("role"),
        F.when(F.col("turn").isNotNull(), normalise_content("_t.content")).alias("text"),
    )


def read_chat_requests(spark: SparkSession, path: str) -> DataFrame:
    """Message rows of request files, one JSON body per line, by ``(file, seq)`` of the line.

    The key stays the same however the files are split, so answers of an earlier run can be joined.
    """
    lines = read_numbered_lines(spark, path).select(
        F.struct("file", "seq").alias("request_id"), F.col("line").alias("body")
    )
    return request_messages(lines).select("request_id.*", "phase", "status", "turn", "role", "text")


def write_frames(frames: DataFrame, path: str, order: str = "seq", line: str = "line") -> None:
    """Hand over frame lines as text, one folder per run, in order inside its file.

    A folder per run suits the runs that a reader asked for; keep a whole corpus as a table.
    """
    frames.repartition("run_id").sortWithinPartitions("run_id", order).select(
        "run_id", F.col(line).alias("line")
    ).write.partitionBy("run_id").text(path)


def display_rows(turns: DataFrame) -> DataFrame:
    """Turns as shown to a reader: first marker removed, empty ones dropped."""
    return turns.select("conv_id", "turn", "role", display_text("text").alias("display")).filter(
        F.col("display").isNotNull()
    )
