"""Model response logs and framed run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import let, rows_where
from promptloom.functions.responses import cloud_fields, finish_frame, frame_kind, frame_values, local_fields
from promptloom.functions.text import chunks
from promptloom.operators.grouping import key_values, ordered_text


def local_usage(responses: DataFrame, body: str = "body") -> DataFrame:
    """Text and token counts of complete local responses."""
    others = [c for c in responses.columns if c != body]
    return responses.select(*others, local_fields(body).alias("_r")).select(
        *others, "_r.text", "_r.input_tokens", "_r.output_tokens"
    )


def local_stream_tokens(lines: DataFrame) -> DataFrame:
    """Non-empty tokens ``(call_id, seq, token)`` of streamed lines, up to the first done line.

    Blank and malformed lines are skipped; the done line's own token counts. The log is read twice, as
    a call's first done line has to be known before its tokens can be told apart; each pass parses a
    line once, and only calls with a done line are in the small table that is joined.
    """
    fields = local_fields("line")
    done = rows_where(lines, fields["done"], lambda d: d, "_done", "call_id", "seq")
    first_done = key_values(done, ["call_id"], {"first_done": (F.col("seq"), F.min)})
    tokens = rows_where(lines, fields["text"], lambda t: t != "", "token", "call_id", "seq")
    ends = first_done.withColumnRenamed("call_id", "_call")
    return (
        tokens.join(ends, F.col("call_id").eqNullSafe(F.col("_call")), "left")
        .filter(F.col("first_done").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("first_done")))
        .select("call_id", "seq", "token")
    )


def _token_of(fields: Column, family: Column | str) -> Column:
    """Token of parsed chunk fields; ``family`` is ``claude`` or ``mistral``, or a column of these."""
    if isinstance(family, str):
        return fields[f"{family}_token"]
    return F.when(family == "mistral", fields["mistral_token"]).otherwise(fields["claude_token"])


def chunk_usage(chunk_rows: DataFrame, *more: str) -> DataFrame:
    """Usage reported by each cloud stream chunk; nulls where it reports none."""
    usage = cloud_fields("chunk")["usage"].alias("_u")
    return chunk_rows.select("call_id", "seq", *more, usage).select(
        "call_id", "seq", *more, "_u.input_tokens", "_u.output_tokens"
    )


def chunk_tokens(chunk_rows: DataFrame, family: Column | str = "claude") -> DataFrame:
    """Non-empty tokens ``(call_id, seq, token)`` of cloud stream chunks."""
    token = let(cloud_fields("chunk"), lambda f: _token_of(f, family))
    return rows_where(chunk_rows, token, lambda t: t != "", "token", "call_id", "seq")


def call_usage(usage: DataFrame, *more_keys: Column) -> DataFrame:
    """Largest input and output count reported in a call, each on its own; 0 when none is."""
    return usage.groupBy("call_id", *more_keys).agg(
        F.greatest(F.coalesce(F.max("input_tokens"), F.lit(0)), F.lit(0)).alias("input_tokens"),
        F.greatest(F.coalesce(F.max("output_tokens"), F.lit(0)), F.lit(0)).alias("output_tokens"),
    )


def call_text(tokens: DataFrame) -> DataFrame:
    """Tokens of a call joined in order, as ``(call_id, text)``."""
    return ordered_text(tokens, ["call_id"], "seq", F.col("token"), "text")


def call_fold(chunk_rows: DataFrame, family: Column | str = "claude") -> DataFrame:
    """One row per call: its text, its usage and how many chunks had a token.

    Each chunk is parsed once, and text and counts are folded by the same aggregation.
    """
    parsed = let(
        cloud_fields("chunk"),
        lambda f: F.struct(F.nullif(_token_of(f, family), F.lit("")).alias("token"), f["usage"].alias("usage")),
    )
    chunk = chunk_rows.select("call_id", "seq", parsed.alias("_c")).select(
        "call_id", "seq", "_c.token", "_c.usage.input_tokens", "_c.usage.output_tokens"
    )
    folded = ordered_text(
        chunk,
        ["call_id"],
        "seq",
        F.col("token"),
        "text",
        input_tokens=(F.col("input_tokens"), F.max),
        output_tokens=(F.col("output_tokens"), F.max),
        n_tokens=(F.col("token").isNotNull().cast("bigint"), F.sum),
    )
    none = F.lit(0).cast("bigint")
    return folded.select(
        "call_id",
        "text",
        F.greatest(F.coalesce("input_tokens", none), none).alias("input_tokens"),
        F.greatest(F.coalesce("output_tokens", none), none).alias("output_tokens"),
        "n_tokens",
    )


def finish_lines(folded: DataFrame) -> DataFrame:
    """Closing frame line ``(call_id, line)`` of each folded call, with its count of token chunks."""
    return folded.select("call_id", finish_frame("stop", F.col("n_tokens")).alias("line"))


def decode_frames(lines: DataFrame, *more: str) -> DataFrame:
    """Text and data frames ``(run_id, seq, kind, text, payload)``; other lines are ignored. ``more`` columns are kept."""
    decoded = lines.select(
        "run_id", "seq", *more, frame_kind("line").alias("kind"), F.explode(frame_values("line")).alias("value")
    )
    return decoded.select(
        "run_id",
        "seq",
        *more,
        "kind",
        F.when(F.col("kind") == "text", F.col("value")).alias("text"),
        F.when(F.col("kind") == "data", F.col("value")).alias("payload"),
    )


def run_text(lines: DataFrame) -> DataFrame:
    """Text deltas of a run's frames joined in order, as ``(run_id, text)``."""
    deltas = decode_frames(lines.filter(frame_kind("line") == "text"))
    return ordered_text(deltas, ["run_id"], "seq", F.col("text"), "text")


def split_chunks(rows: DataFrame, text: str = "text", width: int = V.CHUNK_WIDTH) -> DataFrame:
    """One row per fixed-width slice of a text column: ``chunk_no, chunk``."""
    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.posexplode(chunks(text, width)).alias("chunk_no", "chunk"))
