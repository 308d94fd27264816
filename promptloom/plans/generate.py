"""Composed runs: from conversations to compressed prompts, and from plans to a run report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import round_exact
from promptloom.functions.intent import strong_intent, weak_intent
from promptloom.functions.models import Pricing, short_model
from promptloom.functions.text import decompose_prompt, perform_prompt
from promptloom.functions.tokens import compress_struct
from promptloom.operators import ledger
from promptloom.operators.conversation import extract_requirements
from promptloom.operators.intent import resolve_intent
from promptloom.operators.ledger import run_totals
from promptloom.operators.planning import route, subtask_outcome


def generate_requests(
    turns: DataFrame,
    answers: DataFrame,
    ratio: float = V.DEFAULT_PRESERVE_RATIO,
    detailed: bool = False,
) -> DataFrame:
    """Conversations to next model requests, ``(request_id, ...)``, one for each.

    Summary, compressed summary with statistics, intent, and the prompt that the intent calls for.
    ``answers`` is ``(request_id, answer)`` with ``request_id`` the conversation.
    """
    summaries = extract_requirements(
        turns, answers.select(F.col("request_id").alias("conv_id"), "answer")
    ).withColumnRenamed("conv_id", "request_id")
    keys = ["request_id", "summary"]
    voted = summaries.select(
        *keys,
        "answer",
        compress_struct("summary", ratio, detailed=detailed).alias("_c"),
        strong_intent("summary").alias("_strong"),
        weak_intent("summary").alias("_weak"),
    )
    intent = resolve_intent(F.col("_strong"), F.col("answer"), F.col("_weak"))
    return voted.select(*keys, "_c.*", intent.alias("intent")).withColumn(
        "prompt",
        F.when(F.col("intent") == "perform", perform_prompt("summary", "compressed")).otherwise(
            decompose_prompt("compressed")
        ),
    )


def request_events(requests: DataFrame) -> DataFrame:
    """Compression and mode events of detailed :func:`generate_requests` rows.

    ``(request_id, stage, event, payload)``, in stage order.
    """
    events = [
        _named_event(
            0,
            "compression_stats",
            originalTokens=F.col("original_tokens"),
            compressedTokens=F.col("compressed_tokens"),
            ratio=F.col("ratio"),
            multiplier=F.col("multiplier"),
            compressedPrompt=F.col("compressed"),
        ),
        _named_event(
            1,
            "compression_diff",
            original=F.col("summary"),
            tokens=F.col("tokens"),
            multiplier=F.col("multiplier"),
        ),
        _named_event(2, "task_mode", mode=F.col("intent")),
    ]
    return requests.select("request_id", F.explode(F.array(*events)).alias("e")).select("request_id", "e.*")


def perform_events(usage: DataFrame) -> DataFrame:
    """Usage event per directly answered run of ``ledger.usage_perform``, as ``(run_id, event, payload)``."""
    no_subtasks = F.array().cast("array<struct<id:bigint>>")
    event = _named_event(
        3,
        "real_usage",
        realInputTokens=F.col("real_input_tokens"),
        realOutputTokens=F.col("real_output_tokens"),
        realTotalTokens=F.col("real_total_tokens"),
        realCostUnits=F.col("real_cost_units").cast("bigint"),
        realInputCostUsd=F.col("real_input_cost_usd"),
        realOutputCostUsd=F.col("real_output_cost_usd"),
        realTotalCostUsd=F.col("real_total_cost_usd"),
        perSubtask=no_subtasks,
    )
    return usage.select("run_id", event.alias("e")).select("run_id", "e.*")


def phase_events(flags: DataFrame) -> DataFrame:
    """Event per conversation whose scoping is complete, as ``(conv_id, event, payload)``."""
    event = _named_event(0, "phase_complete", nextPhase=F.lit("generate"))
    return flags.filter("complete").select("conv_id", event.alias("e")).select("conv_id", "e.*")


def _named_event(stage: int, name: str, **fields: Column) -> Column:
    payload = F.struct(F.lit(name).alias("event"), *[c.alias(n) for n, c in fields.items()])
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(name).alias("event"), F.to_json(payload).alias("payload")
    )


@dataclass(frozen=True)
class RunTables:
    """The tables of a set of build runs, each a lazy DataFrame."""

    pricing: Pricing
    routed: DataFrame
    outcomes: DataFrame
    totals: DataFrame
    decomposition: DataFrame


def run_tables(
    tasks: DataFrame,
    responses: DataFrame,
    decomposition: DataFrame,
    pricing: Pricing,
    limit: int = V.ROUTING_TOKEN_LIMIT,
) -> RunTables:
    """Route subtasks, fold in their responses and total every run.

    ``tasks``: ``(run_id, position, id, title, prompt, estimated_tokens)``; ``decomposition``:
    ``(run_id, input_tokens, output_tokens, uncompressed_tokens)``, one row per run.
    """
    routed = route(tasks, pricing, limit)
    outcomes = subtask_outcome(routed, responses)
    return RunTables(pricing, routed, outcomes, run_totals(outcomes, decomposition, pricing), decomposition)


def run_report(tables: RunTables) -> DataFrame:
    """One row per run: plan totals, real usage and savings."""
    return ledger.run_report(tables.totals, tables.pricing)


def _event(stage: int, position: Column, name: str, **fields: Column) -> Column:
    payload = F.struct(F.lit(name).alias("event"), *[c.alias(n) for n, c in fields.items()])
    return F.struct(
        F.lit(stage).alias("stage"),
        position.cast("bigint").alias("position"),
        F.lit(name).alias("event"),
        F.to_json(payload).alias("payload"),
    )


def _status(stage: int, name: str, message: Column) -> Column:
    payload = F.struct(
        F.lit("router_status").alias("event"), F.lit(name).alias("stage"), message.alias("message")
    )
    return F.struct(
        F.lit(stage).alias("stage"),
        F.lit(0).cast("bigint").alias("position"),
        F.lit("router_status").alias("event"),
        F.to_json(payload).alias("payload"),
    )


def run_events(tables: RunTables) -> DataFrame:
    """The events of build runs as ``(run_id, stage, position, event, payload)`` in (stage, position) order.

    ``position`` tells the updates of one stage apart and is that of the subtask; it is 0 elsewhere.
    A subtask that has no response yet is running and gets no result. Every outcome is read once: it becomes
    its updates, and its share of the run's totals and lists, which one aggregation adds up.
    """
    pricing, outcomes = tables.pricing, tables.outcomes
    in_price, out_price = pricing.usd_columns("assigned_model")
    i, o = F.col("real_input_tokens"), F.col("real_output_tokens")
    event_type = "struct<stage:int,position:bigint,event:string,payload:string>"

    def update(stage: int, status: Column) -> Column:
        return _event(
            stage, F.col("position"), "subtask_update", id=F.col("id"), title=F.col("title"), status=status, model=short_model("assigned_model")
        )

    listed = F.struct(
        F.col("position"),
        F.col("id"),
        F.col("title"),
        F.col("estimated_tokens").alias("estimatedTokens"),
        short_model("assigned_model").alias("model"),
        F.lit("pending").alias("status"),
        i.alias("inputTokens"),
        o.alias("outputTokens"),
        round_exact(i * in_price + o * out_price, 6).alias("costUsd"),
    )
    running, ended = update(3, F.lit("running")), update(4, F.col("status"))
    own = F.when(F.col("status") == "pending", F.array(running)).otherwise(F.array(running, ended)).cast(f"array<{event_type}>")
    share = F.struct(*[F.col(c) for c in ledger.TOTALS], listed.alias("task"))
    rows = ledger.call_rows(outcomes, pricing, "position", "id", "title", "assigned_model", "status", "real_input_tokens", "real_output_tokens")
    share_type = rows.select(share.alias("s")).schema["s"].dataType
    none = F.lit(None).cast(share_type)
    both = F.concat(
        F.array(F.struct(F.lit(None).cast(event_type).alias("e"), share.alias("s"))),
        F.transform(own, lambda e: F.struct(e.alias("e"), none.alias("s"))),
    )
    exploded = rows.select("run_id", F.explode(both).alias("x")).select("run_id", "x.e.*", "x.s.*")
    planning = ledger.planning_rows(tables.decomposition)
    grouped = exploded.unionByName(planning, allowMissingColumns=True).groupBy("run_id", "stage", "position").agg(
        F.max("event").alias("event"),
        F.max("payload").alias("payload"),
        *[F.sum(n).alias(n) for n in ledger.TOTALS],
        F.array_sort(F.collect_list("task")).alias("tasks"),
    )
    report = ledger.run_report(grouped, pricing, "stage", "position", "event", "payload", "tasks")
    whole = F.array(*_whole_run_events()).cast(f"array<{event_type}>")
    events = F.when(F.col("stage").isNull(), whole).otherwise(F.array(F.struct("stage", "position", "event", "payload")))
    return report.select("run_id", F.explode(events).alias("e")).select("run_id", "e.*")


def _whole_run_events() -> list[Column]:
    """The events of a run as a whole, of its report and the list ``tasks`` of its subtasks."""
    count = F.col("subtask_count")
    before, _, after = V.STATUS_EXECUTING.partition("{count}")

    def fields(*names: str) -> Column:
        return F.transform("tasks", lambda t: F.struct(*[t[n].alias(n) for n in names]))

    return [
        _status(0, "decomposing", F.lit(V.STATUS_DECOMPOSING)),
        _event(
            1,
            F.lit(0),
            "router_plan",
            subtasks=fields("id", "title", "estimatedTokens", "model", "status"),
            totalEstimatedTokens=F.col("total_estimated_tokens"),
            savingsVsSingleCall=F.col("savings_token_equiv"),
            savingsVsSingleCallPct=F.col("plan_savings_pct"),
        ),
        _status(2, "executing", F.concat(F.lit(before), count.cast("string"), F.lit(after))),
        _status(5, "assembling", F.lit(V.STATUS_ASSEMBLING)),
        _event(
            6,
            F.lit(0),
            "real_usage",
            realInputTokens=F.col("real_input_tokens"),
            realOutputTokens=F.col("real_output_tokens"),
            realTotalTokens=F.col("real_total_tokens"),
            realCostUnits=F.col("real_cost_units"),
            realInputCostUsd=F.col("real_input_cost_usd"),
            realOutputCostUsd=F.col("real_output_cost_usd"),
            realTotalCostUsd=F.col("real_total_cost_usd"),
            perSubtask=fields("id", "title", "model", "inputTokens", "outputTokens", "costUsd"),
        ),
        _event(
            7,
            F.lit(0),
            "savings_breakdown",
            provider=F.col("provider"),
            baselineCostUsd=F.col("baseline_cost_usd"),
            actualCostUsd=F.col("actual_cost_usd"),
            totalSavingUsd=F.col("total_saving_usd"),
            savingsPct=F.col("savings_pct"),
            compressionSavingUsd=F.col("compression_saving_usd"),
            routingSavingUsd=F.col("routing_saving_usd"),
            baselineModel=F.col("baseline_model"),
        ),
        _event(8, F.lit(0), "router_done", subtaskCount=count),
    ]
