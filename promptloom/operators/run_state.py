"""Reduction of a run's event stream to its final state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import rows_where
from promptloom.functions.responses import frame_kind
from promptloom.operators.logs import decode_frames

#: Events that set a part of the run state; the last one of each kind wins.
STATE_EVENTS = (
    "phase_complete",
    "compression_stats",
    "compression_diff",
    "router_plan",
    "router_status",
    "real_usage",
    "task_mode",
    "savings_breakdown",
)


def data_events(lines: DataFrame, *more: str) -> DataFrame:
    """Events ``(run_id, seq, event, subtask_id, status, payload)`` of a run's frame lines; ``more`` columns are kept."""
    decoded = decode_frames(lines.filter(frame_kind("line") == "data"), *more)
    head = F.from_json("payload", "struct<event:string,id:string,status:string>")
    events = rows_where(
        decoded,
        head,
        lambda h: h["event"].isin(*STATE_EVENTS, "subtask_update"),
        "_h",
        "run_id",
        "seq",
        "payload",
        *more,
    )
    is_update = F.col("_h.event") == "subtask_update"
    return events.select(
        "run_id",
        "seq",
        F.col("_h.event").alias("event"),
        F.when(is_update, F.col("_h.id")).alias("subtask_id"),
        F.when(is_update, F.col("_h.status")).alias("status"),
        "payload",
        *more,
    )


def latest_events(events: DataFrame) -> DataFrame:
    """The last event per run, kind and (for updates) subtask; payload only where it is state.

    One pass over the log: the last row of a group is found before the shuffle in each task.
    """
    payload = F.when(F.col("event") != "subtask_update", F.col("payload")).alias("payload")
    last = F.max(F.struct("seq", "status", payload)).alias("_l")
    return events.groupBy("run_id", "event", "subtask_id").agg(last).select("run_id", "event", "subtask_id", "_l.*")


def _payload(event: str) -> Column:
    return F.max(F.when(F.col("event") == event, F.col("payload")))


def run_report(latest: DataFrame) -> DataFrame:
    """One row of scalar state per run from its latest events (at most one row per kind)."""
    states = (
        latest.filter(F.col("event").isin(*STATE_EVENTS))
        .groupBy("run_id")
        .agg(*[_payload(e).alias(e) for e in STATE_EVENTS])
    )
    usage = "realInputTokens:bigint,realOutputTokens:bigint,realTotalTokens:bigint,realCostUnits:double"
    costs = "realInputCostUsd:double,realOutputCostUsd:double,realTotalCostUsd:double"
    parsed = states.select(
        "run_id",
        F.col("phase_complete").isNotNull().alias("can_generate"),
        F.col("task_mode").isNotNull().alias("_has_mode"),
        F.col("compression_diff").isNotNull().alias("has_diff"),
        F.from_json(
            "compression_stats",
            "struct<originalTokens:bigint,compressedTokens:bigint,ratio:double,multiplier:double,"
            "compressedPrompt:string>",
        ).alias("c"),
        F.from_json("compression_diff", "struct<original:string,multiplier:double>").alias("d"),
        F.from_json(
            "router_plan",
            "struct<totalEstimatedTokens:bigint,savingsVsSingleCall:bigint,"
            "savingsVsSingleCallPct:double>",
        ).alias("p"),
        F.from_json("router_status", "struct<message:string>").alias("s"),
        F.from_json("real_usage", f"struct<{usage},{costs}>").alias("u"),
        F.from_json("task_mode", "struct<mode:string>").alias("m"),
        F.from_json(
            "savings_breakdown",
            "struct<provider:string,baselineCostUsd:double,actualCostUsd:double,"
            "totalSavingUsd:double,savingsPct:double,compressionSavingUsd:double,"
            "routingSavingUsd:double,baselineModel:string>",
        ).alias("b"),
    )

    def default(struct: str, field: str, value: float) -> Column:
        return F.when(F.col(struct).isNotNull(), F.coalesce(F.col(f"{struct}.{field}"), F.lit(value)))

    return parsed.select(
        "run_id",
        "can_generate",
        F.col("c.originalTokens").alias("original_tokens"),
        F.col("c.compressedTokens").alias("compressed_tokens"),
        F.col("c.ratio").alias("ratio"),
        default("c", "multiplier", 1.0).alias("multiplier"),
        F.col("c.compressedPrompt").alias("compressed_prompt"),
        F.col("d.original").alias("original_prompt"),
        default("d", "multiplier", 1.0).alias("diff_multiplier"),
        F.col("p.totalEstimatedTokens").alias("total_estimated_tokens"),
        F.col("p.savingsVsSingleCall").alias("savings_token_equiv"),
        default("p", "savingsVsSingleCallPct", 0.0).alias("plan_savings_pct"),
        F.coalesce(F.col("s.message"), F.lit("")).alias("router_status"),
        F.when(F.col("_has_mode"), F.when(F.col("m.mode") == "perform", "perform").otherwise("build")).alias(
            "task_mode"
        ),
        F.col("u.realInputTokens").alias("real_input_tokens"),
        F.col("u.realOutputTokens").alias("real_output_tokens"),
        F.col("u.realTotalTokens").alias("real_total_tokens"),
        F.col("u.realCostUnits").alias("real_cost_units"),
        default("u", "realInputCostUsd", 0.0).alias("real_input_cost_usd"),
        default("u", "realOutputCostUsd", 0.0).alias("real_output_cost_usd"),
        default("u", "realTotalCostUsd", 0.0).alias("real_total_cost_usd"),
        F.col("b.provider").alias("provider"),
        F.col("b.baselineCostUsd").alias("baseline_cost_usd"),
        F.col("b.actualCostUsd").alias("actual_cost_usd"),
        F.col("b.totalSavingUsd").alias("total_saving_usd"),
        F.col("b.savingsPct").alias("savings_pct"),
        F.col("b.compressionSavingUsd").alias("compression_saving_usd"),
        F.col("b.routingSavingUsd").alias("routing_saving_usd"),
        F.col("b.baselineModel").alias("baseline_model"),
    )


def run_subtasks(latest: DataFrame) -> DataFrame:
    """Subtasks of a run: the plan's rows with patched status, and every status ever reported.

    An update changes the plan only if it came after it; ``reported_status`` keeps it either way.
    Subtasks that were updated but never planned have ``planned`` false.
    """
    plan = (
        latest.filter(F.col("event") == "router_plan")
        .select(
            "run_id",
            F.col("seq").alias("plan_seq"),
            F.explode(
                F.from_json(
                    "payload",
                    "struct<subtasks:array<struct<id:string,title:string,estimatedTokens:bigint,"
                    "model:string,status:string>>>",
                )["subtasks"]
            ).alias("t"),
        )
        .select(
            "run_id",
            F.col("t.id").alias("subtask_id"),
            "plan_seq",
            F.col("t.title").alias("title"),
            F.col("t.estimatedTokens").alias("estimated_tokens"),
            F.col("t.model").alias("model"),
            F.col("t.status").alias("plan_status"),
        )
    )
    updates = latest.filter(F.col("event") == "subtask_update").select(
        "run_id", "subtask_id", F.col("seq").alias("update_seq"), F.col("status").alias("reported_status")
    )
    planned = F.col("plan_seq").isNotNull()
    return plan.join(updates, ["run_id", "subtask_id"], "full").select(
        "run_id",
        "subtask_id",
        planned.alias("planned"),
        "title",
        "estimated_tokens",
        "model",
        F.when(planned & (F.col("update_seq") > F.col("plan_seq")), F.col("reported_status"))
        .otherwise(F.col("plan_status"))
        .alias("status"),
        "reported_status",
    )


def run_diff(latest: DataFrame) -> DataFrame:
    """Tokens of each run's last compression diff: ``(run_id, position, token, kept, score)``."""
    diff = F.from_json("payload", "struct<tokens:array<struct<text:string,kept:boolean,score:double>>>")["tokens"]
    rows = latest.filter(F.col("event") == "compression_diff").select(
        "run_id", F.posexplode(diff).alias("position", "_t")
    )
    return rows.select(
        "run_id", "position", F.col("_t.text").alias("token"), F.col("_t.kept").alias("kept"), F.col("_t.score").alias("score")
    )


def run_usage(latest: DataFrame) -> DataFrame:
    """Real usage of each run's subtasks, from its last usage event; missing costs are 0."""
    item = "id:string,title:string,model:string,inputTokens:bigint,outputTokens:bigint,costUsd:double"
    used = F.from_json("payload", f"struct<perSubtask:array<struct<{item}>>>")["perSubtask"]
    rows = latest.filter(F.col("event") == "real_usage").select("run_id", F.posexplode(used).alias("position", "_t"))
    return rows.select(
        "run_id",
        "position",
        F.col("_t.id").alias("subtask_id"),
        F.col("_t.title").alias("title"),
        F.col("_t.model").alias("model"),
        F.col("_t.inputTokens").alias("input_tokens"),
        F.col("_t.outputTokens").alias("output_tokens"),
        F.coalesce("_t.costUsd", F.lit(0.0)).alias("cost_usd"),
    )
