"""Fields of model responses and framed run events held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.columns import as_column, let

_LOCAL_SCHEMA = (
    "struct<message:struct<content:string>,done:boolean,prompt_eval_count:bigint,eval_count:bigint>"
)
_CLOUD_SCHEMA = (
    "struct<type:string,delta:struct<text:string>,outputs:array<struct<text:string>>,"
    "usage:map<string,string>,`amazon-bedrock-invocationMetrics`:map<string,string>>"
)


def json_elements(text: Column | str) -> Column:
    """The one JSON value in ``text`` as an array of raw strings; null unless it is valid JSON.

    Wrapping the text in brackets makes the parser check it whole, trailing characters included.
    """
    wrapped = F.from_json(F.concat(F.lit("["), as_column(text), F.lit("]")), "array<string>")
    return let(wrapped, lambda values: F.when(F.size(values) == 1, values))


def parse_local(body: Column | str) -> Column:
    """Struct of a local model's response body or stream line; nulls when malformed."""
    return F.from_json(as_column(body), _LOCAL_SCHEMA)


def local_fields(body: Column | str) -> Column:
    """``struct<text, done, input_tokens, output_tokens>`` with defaults."""
    return let(
        parse_local(body),
        lambda r: F.struct(
            F.coalesce(r["message"]["content"], F.lit("")).alias("text"),
            F.coalesce(r["done"], F.lit(False)).alias("done"),
            F.coalesce(r["prompt_eval_count"], F.lit(0)).cast("bigint").alias("input_tokens"),
            F.coalesce(r["eval_count"], F.lit(0)).cast("bigint").alias("output_tokens"),
        ),
    )


def _count(values: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(key)).try_cast("double"), F.lit(0)).cast("bigint")


def cloud_fields(chunk: Column | str) -> Column:
    """``struct<claude_token, mistral_token, usage struct<input_tokens, output_tokens>>`` of a chunk.

    Tokens default to empty text. Usage is null when the chunk reports none: the invocation metrics
    win when present and non-empty, else the top-level usage counts if it has either side.
    """

    def read(c: Column) -> Column:
        metrics, usage = c["amazon-bedrock-invocationMetrics"], c["usage"]
        has_usage = F.map_contains_key(usage, "input_tokens") | F.map_contains_key(
            usage, "output_tokens"
        )
        claude = F.when(c["type"] == "content_block_delta", c["delta"]["text"])
        return F.struct(
            F.coalesce(claude, F.lit("")).alias("claude_token"),
            F.coalesce(F.get(c["outputs"], F.lit(0))["text"], F.lit("")).alias("mistral_token"),
            F.when(
                F.size(metrics) > 0,
                F.struct(
                    _count(metrics, "inputTokenCount").alias("input_tokens"),
                    _count(metrics, "outputTokenCount").alias("output_tokens"),
                ),
            )
            .when(
                has_usage,
                F.struct(
                    _count(usage, "input_tokens").alias("input_tokens"),
                    _count(usage, "output_tokens").alias("output_tokens"),
                ),
            )
            .alias("usage"),
        )

    return let(F.from_json(as_column(chunk), _CLOUD_SCHEMA), read)


def frame_kind(line: Column | str) -> Column:
    """``text`` or ``data`` by the prefix of a frame line; null for other lines."""
    line = as_column(line)
    return F.when(F.startswith(line, F.lit("0:")), "text").when(F.startswith(line, F.lit("2:")), "data")


def frame_values(line: Column | str) -> Column:
    """The value of a text or data frame as a one-element array of strings.

    A text delta's text, or the first element of a data frame as JSON text. Null or empty for other
    and malformed lines.
    """
    line = as_column(line)
    body = F.substr(line, F.lit(3))
    text = F.transform(json_elements(body), lambda t: F.coalesce(t, F.lit("null")))
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<array<string>>")
    first = let(
        wrapped,
        lambda v: F.when(F.size(v) == 1, F.array_compact(F.slice(F.get(v, F.lit(0)), 1, 1))),
    )
    kind = frame_kind(line)
    return F.when(kind == "text", text).when(kind == "data", first)


def text_frame(text: Column | str) -> Column:
    """Encode a text delta."""
    as_json = F.to_json(F.array(as_column(text)))
    return F.concat(F.lit("0:"), F.substr(as_json, F.lit(2), F.length(as_json) - 2))


def data_frame(payload: Column | str) -> Column:
    """Encode a data annotation from a struct, or from an object already written as JSON text."""
    if isinstance(payload, str):
        return F.concat(F.lit("2:["), F.col(payload), F.lit("]"))
    return F.concat(F.lit("2:["), F.to_json(payload), F.lit("]"))


def finish_frame(reason: Column | str = "stop", completion_tokens: Column | None = None) -> Column:
    """Encode the finish frame; usage is written only when given."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    usage = (
        F.lit(None).cast("struct<completionTokens:bigint>")
        if completion_tokens is None
        else F.when(
            completion_tokens.isNotNull(),
            F.struct(completion_tokens.cast("bigint").alias("completionTokens")),
        )
    )
    return F.concat(
        F.lit("d:"), F.to_json(F.struct(reason.alias("finishReason"), usage.alias("usage")))
    )
