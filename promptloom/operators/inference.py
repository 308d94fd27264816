"""Batch inference: request payloads out, a caller's model function over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column
from promptloom.functions.intent import intent_question, strong_intent
from promptloom.functions.models import Pricing, is_local_provider, resolve_provider
from promptloom.functions.text import generation_prompt

#: (system, messages_json, model, max_tokens) -> (text, input_tokens, output_tokens)
ModelCall = Callable[[str, str, str, int], tuple[str, int, int]]


def local_payload(
    messages: Column | str, model: Column | str, max_tokens: Column | int, stream: bool = False
) -> Column:
    """JSON request body of a local chat call; ``messages`` is ``array<struct<role, content>>``."""
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return F.to_json(
        F.struct(
            as_column(model).alias("model"),
            as_column(messages).alias("messages"),
            F.lit(stream).alias("stream"),
            F.struct(limit.alias("num_predict")).alias("options"),
        )
    )


def cloud_payload(messages: Column | str, system: Column | str | None, max_tokens: Column | int) -> Column:
    """JSON request body of a cloud messages call; no system field when ``system`` is None."""
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    fields = [F.lit(V.CLOUD_API_VERSION).alias("anthropic_version"), limit.alias("max_tokens")]
    if system is not None:
        fields.append(as_column(system).alias("system"))
    return F.to_json(F.struct(*fields, as_column(messages).alias("messages")))


def single_prompt_payload(prompt: Column | str, model: Column | str, max_tokens: int) -> Column:
    """JSON body of a one-prompt cloud call: instruct format for mistral models, else one user turn."""
    prompt = as_column(prompt)
    instruct = F.struct(
        F.concat(F.lit("<s>[INST]"), prompt, F.lit("[/INST]")).alias("prompt"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(V.MISTRAL_TEMPERATURE).alias("temperature"),
        F.lit(V.MISTRAL_TOP_P).alias("top_p"),
    )
    user_turn = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.when(
        F.contains(F.lower(as_column(model)), F.lit("mistral")), F.to_json(instruct)
    ).otherwise(cloud_payload(user_turn, None, max_tokens))


def request_table(
    prompts: DataFrame,
    provider: Column | str = "provider",
    model: Column | str = "model",
    system: str = "",
    max_tokens: int = V.PERFORM_MAX_TOKENS,
    prompt: str = "prompt",
) -> DataFrame:
    """Prompts with their resolved provider, model and request body.

    A null model becomes the provider's default.
    """
    resolved = resolve_provider(provider)
    is_local = resolved != V.CLOUD_PROVIDER
    default_model = F.when(is_local, V.LOCAL_HEAVY_MODEL).otherwise(F.lit(V.CLOUD_LIGHT_MODEL))
    user_turn = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    leading = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    rows = prompts.withColumn("provider", resolved).withColumn(
        "model", F.coalesce(F.nullif(as_column(model), F.lit("")), default_model)
    )
    return rows.withColumn(
        "request",
        F.when(
            F.col("provider") != V.CLOUD_PROVIDER,
            local_payload(F.array(*leading, user_turn), "model", max_tokens),
        ).otherwise(cloud_payload(F.array(user_turn), F.lit(system), max_tokens)),
    )


def chat_requests(
    messages: DataFrame,
    provider: str = "local",
    model: str | None = None,
    system: str = "",
    max_tokens: int = V.CHAT_MAX_TOKENS,
) -> DataFrame:
    """Chat request bodies ``(conv_id, request)`` of message rows, one per conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    as_message = lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))
    listed = (
        messages.groupBy("conv_id")
        .agg(turns.alias("_turns"))
        .withColumn("_messages", F.transform("_turns", as_message))
    )
    every = F.col("_messages")
    if is_local_provider(provider):
        if system:
            leading = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
            every = F.concat(F.array(leading), every)
        request = local_payload(every, F.lit(model or V.LOCAL_HEAVY_MODEL), max_tokens, stream=True)
    else:
        request = cloud_payload(every, F.lit(system), max_tokens)
    return listed.select("conv_id", request.alias("request"))


# --- requests of the stages of a run -------------------------------------------------------------------


def _stage_requests(rows: DataFrame, keys: list[str], prompt: Column, limit: int, provider: str, model: Column | str | None, system: str) -> DataFrame:
    """Request bodies ``(keys, provider, model, request)`` of one user turn each, under a stage's limit of tokens."""
    named = rows.select(*keys, F.lit(provider).alias("provider"), (F.lit(None).cast("string") if model is None else as_column(model)).alias("model"), prompt.alias("prompt"))
    return request_table(named, system=system, max_tokens=limit).drop("prompt")


def intent_requests(requests: DataFrame, provider: str = "local", system: str = "", key: str = "request_id", text: str = "text") -> DataFrame:
    """Questions to the model for requests that no strong keyword decides: the start of the text, and a word for an answer."""
    asked = requests.where(strong_intent(text).isNull())
    return _stage_requests(asked, [key], intent_question(text), V.INTENT_MAX_TOKENS, provider, None, system)


def decompose_requests(requests: DataFrame, pricing: Pricing, system: str = "") -> DataFrame:
    """Calls for the plan of each build run of ``plans.generate.generate_requests``, to the light model."""
    builds = requests.where(F.col("intent") == "build")
    return _stage_requests(builds, ["request_id"], F.col("prompt"), V.DECOMPOSER_MAX_TOKENS, pricing.provider, F.lit(pricing.light.model), system)


def subtask_requests(routed: DataFrame, provider: str, system: str = "") -> DataFrame:
    """Calls of routed subtasks, each to its assigned model; subtasks without one have no call."""
    ready = routed.where(F.col("assigned_model").isNotNull())
    return _stage_requests(ready, ["run_id", "position"], F.col("prompt"), V.SUBTASK_MAX_TOKENS, provider, "assigned_model", system)


def single_prompt_requests(requests: DataFrame, model: Column | str, key: str = "request_id") -> DataFrame:
    """One-prompt cloud calls ``(key, model, request)`` of the build prompts of ``plans.generate.generate_requests``."""
    prompts = requests.select(key, as_column(model).alias("model"), generation_prompt("summary", "compressed").alias("_prompt"))
    body = single_prompt_payload("_prompt", "model", V.SINGLE_PROMPT_MAX_TOKENS)
    return prompts.select(key, "model", body.alias("request"))


_RESULT = "text string, input_tokens bigint, output_tokens bigint, error string"


def infer_table(
    requests: DataFrame,
    calls: dict[str, ModelCall],
    keys: list[str],
    max_tokens: int | str,
    concurrency: int = 1,
) -> DataFrame:
    """Call a model for every request row and return ``keys, text, usage, error``.

    ``requests`` has ``provider, model, system, messages`` (JSON text); ``calls`` maps a provider to
    the function that serves it. ``max_tokens`` is a limit for all rows or the name of a column of
    limits. A task has up to ``concurrency`` calls under way at a time, which then have to be
    thread-safe. A failed call gives its error text and no usage.
    """
    limits = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    columns = [*keys, "provider", "model", "system", "messages", limits.cast("int").alias("_limit")]
    key_fields = [requests.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields] + [_RESULT])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(row: tuple) -> tuple:
            provider, model, system, messages, limit = row
            try:
                return (*calls[provider](system, messages, model, limit), None)
            except Exception as e:
                return None, 0, 0, str(e)

        fields = ["provider", "model", "system", "messages", "_limit"]
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                results = list(pool.map(answer, batch[fields].itertuples(index=False, name=None)))
                answers = pd.DataFrame(
                    results, columns=["text", "input_tokens", "output_tokens", "error"], index=batch.index
                )
                yield pd.concat([batch[keys], answers], axis=1)

    return requests.select(*columns).mapInPandas(run, schema)
