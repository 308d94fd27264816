"""The whole run in one plan: turns, first replies and subtask responses in, run rows and events out.

A run is a conversation whose requirements are summarised, compressed and classified, and then either
answered directly or planned, routed, executed and assembled. :func:`run_log` reads each of its
tables once. Every row of its plan becomes the events that it settles alone (a subtask's updates) and
its share of what the run as a whole has to know; one aggregation by run and event number then passes
the events on as they are and adds up the shares. No run's subtasks stand in one row, but for the two
events and the output that list them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import round_exact
from promptloom.functions.models import Pricing, short_model
from promptloom.functions.responses import data_frame, finish_frame, text_frame
from promptloom.functions.text import chunks
from promptloom.operators import ledger
from promptloom.operators.planning import plan_struct, route, section, subtask_outcome
from promptloom.plans.generate import generate_requests

#: Number of the first event after those of compression, mode, decomposition, plan and execution.
FIRST_UPDATE = 6

_EVENT = "struct<seq:bigint,event:string,payload:string>"
_SUMS = (
    "estimated_tokens", "heavy_estimated_tokens", "input_tokens", "output_tokens", "heavy_input_tokens",
    "heavy_output_tokens", "subtask_count", "uncompressed_tokens", "pending",
)


def _event(seq: Column | int, name: str, **fields: Column) -> Column:
    payload = F.struct(F.lit(name).alias("event"), *[c.alias(n) for n, c in fields.items()])
    number = F.lit(seq) if isinstance(seq, int) else seq
    return F.struct(
        number.cast("bigint").alias("seq"), F.lit(name).alias("event"), F.to_json(payload).alias("payload")
    )


def _status(seq: Column | int, stage: str, message: Column) -> Column:
    return _event(seq, "router_status", stage=F.lit(stage), message=message)


def _request_events() -> list[Column]:
    return [
        _event(
            0,
            "compression_stats",
            originalTokens=F.col("original_tokens"),
            compressedTokens=F.col("compressed_tokens"),
            ratio=F.col("ratio"),
            multiplier=F.col("multiplier"),
            compressedPrompt=F.col("compressed"),
        ),
        _event(
            1,
            "compression_diff",
            original=F.col("summary"),
            tokens=F.col("tokens"),
            multiplier=F.col("multiplier"),
        ),
        _event(2, "task_mode", mode=F.col("intent")),
    ]


def _planned(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per subtask, and one (position -1) for the request itself with its ``head``."""
    answered = requests.join(
        replies.select(
            F.col("run_id"),
            F.col("text").alias("_reply"),
            F.col("error").alias("_error"),
            F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("_in"),
            F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("_out"),
            F.lit(True).alias("_replied"),
        ),
        "run_id",
        "left",
    )
    is_build = F.col("intent") == "build"
    usable = F.col("_replied").isNotNull() & F.col("_error").isNull()
    planned = answered.withColumn("_plan", F.when(is_build & usable, plan_struct(F.coalesce("_reply", F.lit("")), "compressed")))
    status = (
        F.when(F.col("_replied").isNull(), "waiting")
        .when(F.col("_error").isNotNull(), "failed")
        .when(F.col("_plan.status") == "error", "plan_error")
        .otherwise(F.lit("done"))
    )
    head = F.struct(
        F.col("intent").alias("mode"),
        status.alias("status"),
        F.when(~is_build & usable, F.coalesce("_reply", F.lit(""))).alias("answer"),
        F.when(usable, F.col("_in")).alias("input_tokens"),
        F.when(usable, F.col("_out")).alias("output_tokens"),
        F.col("original_tokens").cast("bigint").alias("uncompressed_tokens"),
        F.array(*_request_events()).alias("events"),
    )
    subtasks = F.coalesce(F.col("_plan.subtasks"), F.array().cast("array<struct<id:string,title:string,prompt:string,estimated_tokens:bigint>>"))
    count = F.size(subtasks).cast("bigint")
    whole = F.struct(
        F.lit(-1).cast("bigint").alias("position"),
        F.lit(0).cast("bigint").alias("planned"),
        head.alias("head"),
        F.lit(None).cast("struct<id:string,title:string,prompt:string,estimated_tokens:bigint>").alias("task"),
    )
    head_type = planned.select(whole.alias("w")).schema["w"].dataType["head"].dataType
    each = F.transform(
        subtasks,
        lambda t, i: F.struct(
            i.cast("bigint").alias("position"), count.alias("planned"), F.lit(None).cast(head_type).alias("head"), t.alias("task")
        ),
    )
    rows = planned.select("run_id", F.explode(F.concat(F.array(whole), each)).alias("r"))
    return rows.select(
        "run_id", "r.position", "r.planned", "r.head", "r.task.id", "r.task.title", "r.task.prompt", "r.task.estimated_tokens"
    )


def _shares(outcomes: DataFrame, pricing: Pricing) -> DataFrame:
    """Events that a row settles alone, and its share of the run's totals (``seq`` null)."""
    is_task = F.col("head").isNull()
    heavy = is_task & pricing.is_heavy("assigned_model")
    answered = F.col("status") != "pending"
    in_price, out_price = pricing.usd_columns("assigned_model")
    i, o = F.col("real_input_tokens"), F.col("real_output_tokens")
    none = F.lit(0).cast("bigint")

    def update(seq: Column, status: Column) -> Column:
        return _event(seq, "subtask_update", id=F.col("id"), title=F.col("title"), status=status, model=short_model("assigned_model"))

    running = update(F.col("position") + FIRST_UPDATE, F.lit("running"))
    ended = update(F.col("position") + F.col("planned") + FIRST_UPDATE, F.col("status"))
    own = F.when(~is_task, F.col("head.events")).when(answered, F.array(running, ended)).otherwise(F.array(running))
    share = {
        "estimated_tokens": F.when(is_task, F.col("estimated_tokens")),
        "heavy_estimated_tokens": F.when(heavy, F.col("estimated_tokens")),
        "input_tokens": F.when(is_task, i).otherwise(F.col("head.input_tokens")),
        "output_tokens": F.when(is_task, o).otherwise(F.col("head.output_tokens")),
        "heavy_input_tokens": F.when(heavy, i),
        "heavy_output_tokens": F.when(heavy, o),
        "subtask_count": is_task.cast("bigint"),
        "uncompressed_tokens": F.col("head.uncompressed_tokens"),
        "pending": (is_task & ~answered).cast("bigint"),
    }
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
    text = F.struct(F.col("position").alias("o"), section(outcomes).alias("t"))
    total = F.struct(
        *[F.coalesce(c, none).cast("bigint").alias(n) for n, c in share.items()],
        F.when(is_task, listed).alias("task"),
        F.when(is_task & answered, text).alias("section"),
        F.col("head.mode").alias("mode"),
        F.col("head.status").alias("run_status"),
        F.col("head.answer").alias("answer"),
    )
    row = lambda event, sums: F.struct(event.alias("e"), sums.alias("s"))
    whole_type = outcomes.select(total.alias("t")).schema["t"].dataType
    events = F.transform(own.cast(f"array<{_EVENT}>"), lambda e: row(e, F.lit(None).cast(whole_type)))
    both = F.concat(F.array(row(F.lit(None).cast(_EVENT), total)), events)
    return outcomes.select("run_id", F.explode(both).alias("x")).select("run_id", "x.e.*", "x.s.*")


def _closing_events(tasks: Column) -> Column:
    """The events that a finished run as a whole gives, as an array."""

    def fields(*names: str) -> Column:
        return F.transform(tasks, lambda t: F.struct(*[t[n].alias(n) for n in names]))

    count = F.col("subtask_count")
    after = count * 2 + FIRST_UPDATE
    before_text, _, after_text = V.STATUS_EXECUTING.partition("{count}")
    opening = [
        _status(3, "decomposing", F.lit(V.STATUS_DECOMPOSING)),
        _event(
            4,
            "router_plan",
            subtasks=fields("id", "title", "estimatedTokens", "model", "status"),
            totalEstimatedTokens=F.col("total_estimated_tokens"),
            savingsVsSingleCall=F.col("savings_token_equiv"),
            savingsVsSingleCallPct=F.col("plan_savings_pct"),
        ),
        _status(5, "executing", F.concat(F.lit(before_text), count.cast("string"), F.lit(after_text))),
    ]
    used = {
        "realInputTokens": "real_input_tokens",
        "realOutputTokens": "real_output_tokens",
        "realTotalTokens": "real_total_tokens",
        "realCostUnits": "real_cost_units",
        "realInputCostUsd": "real_input_cost_usd",
        "realOutputCostUsd": "real_output_cost_usd",
        "realTotalCostUsd": "real_total_cost_usd",
    }
    saved = {
        "provider": "provider",
        "baselineCostUsd": "baseline_cost_usd",
        "actualCostUsd": "actual_cost_usd",
        "totalSavingUsd": "total_saving_usd",
        "savingsPct": "savings_pct",
        "compressionSavingUsd": "compression_saving_usd",
        "routingSavingUsd": "routing_saving_usd",
        "baselineModel": "baseline_model",
    }
    per_subtask = fields("id", "title", "model", "inputTokens", "outputTokens", "costUsd")
    closing = [
        _status(after, "assembling", F.lit(V.STATUS_ASSEMBLING)),
        _event(after + 1, "real_usage", **{n: F.col(c) for n, c in used.items()}, perSubtask=per_subtask),
        _event(after + 2, "savings_breakdown", **{n: F.col(c) for n, c in saved.items()}),
        _event(after + 3, "router_done", subtaskCount=count),
    ]
    total = F.col("real_total_tokens")
    answered = _event(
        _n_chunks("answer") + 3,
        "real_usage",
        realInputTokens=F.col("real_input_tokens"),
        realOutputTokens=F.col("real_output_tokens"),
        realTotalTokens=total,
        realCostUnits=total,
        **{n: F.lit(0.0) for n in ("realInputCostUsd", "realOutputCostUsd", "realTotalCostUsd")},
        perSubtask=fields("id"),
    )
    plan_runs = F.col("run_status").isin("done", "running")
    built = F.col("mode") == "build"
    as_events = lambda listed: F.array(*listed).cast(f"array<{_EVENT}>")
    return (
        F.when(built & (F.col("run_status") == "done"), as_events([*opening, *closing]))
        .when(built & plan_runs, as_events(opening))
        .when(~built & (F.col("run_status") == "done"), as_events([answered]))
        .otherwise(F.array().cast(f"array<{_EVENT}>"))
    )


def _n_chunks(text: str) -> Column:
    return F.ceil(F.length(text) / V.CHUNK_WIDTH)


_REPORT = (
    "subtask_count", "total_estimated_tokens", "savings_token_equiv", "plan_savings_pct", "real_input_tokens",
    "real_output_tokens", "real_total_tokens", "real_cost_units", "real_input_cost_usd", "real_output_cost_usd",
    "real_total_cost_usd", "provider", "baseline_cost_usd", "actual_cost_usd", "total_saving_usd", "savings_pct",
    "compression_saving_usd", "routing_saving_usd", "baseline_model",
)


def run_log(
    turns: DataFrame,
    answers: DataFrame,
    replies: DataFrame,
    responses: DataFrame,
    pricing: Pricing,
    ratio: float = V.DEFAULT_PRESERVE_RATIO,
    limit: int = V.ROUTING_TOKEN_LIMIT,
) -> DataFrame:
    """Every run's events and its closing row: ``(run_id, seq, event, payload, run)``.

    ``turns`` are conversations, which are the runs; ``answers`` holds a model's word on the intent,
    ``(request_id, answer)``; ``replies`` the response to a run's first request, ``(run_id, text,
    error, input_tokens, output_tokens)`` with one row per run: a raw plan, or the finished task;
    ``responses`` those to its subtasks, ``(run_id, position, text, error, input_tokens, output_tokens)``.

    Event rows have a ``seq`` that ascends in each run and no ``run``; it leaves out numbers of subtasks
    that have no response yet. Each run has one row with ``run`` and without ``seq`` (see :func:`run_rows`).
    """
    requests = generate_requests(turns, answers, ratio, detailed=True).withColumnRenamed("request_id", "run_id")
    outcomes = subtask_outcome(route(_planned(requests, replies), pricing, limit), responses)
    shares = _shares(outcomes, pricing)
    grouped = shares.groupBy("run_id", "seq").agg(
        *[F.max(c).alias(c) for c in ("event", "payload", "mode", "run_status", "answer")],
        *[F.sum(c).alias(c) for c in _SUMS],
        F.array_sort(F.collect_list("task")).alias("tasks"),
        F.array_sort(F.collect_list("section")).alias("sections"),
    )
    kept = ["seq", "event", "payload", "mode", "run_status", "answer", "pending", "tasks", "sections"]
    report = ledger.run_report(grouped, pricing, *kept).withColumn(
        "run_status",
        F.when((F.col("run_status") == "done") & (F.col("pending") > 0), "running").otherwise(F.col("run_status")),
    )
    done, built = F.col("run_status") == "done", F.col("mode") == "build"
    output = F.when(done & built, F.array_join(F.transform("sections", lambda s: s["t"]), "\n")).when(done, F.col("answer"))

    def shown(name: str) -> Column:
        """A build's figures as they are, a direct answer's tokens with a unit each and no cost."""
        if name.startswith("real_"):
            direct = F.col("real_total_tokens") if name == "real_cost_units" else F.lit(0.0) if name.endswith("_usd") else F.col(name)
            value = F.when(built, F.col(name)).when(done, direct)
            return F.when(F.col("run_status").isin("done", "running"), value)
        return F.when(built & F.col("run_status").isin("done", "running"), F.col(name))

    run = F.struct(
        F.col("mode"), F.col("run_status").alias("status"), output.alias("output"), *[shown(n).alias(n) for n in _REPORT]
    )
    event_row = lambda e, r: F.struct(e["seq"].alias("seq"), e["event"].alias("event"), e["payload"].alias("payload"), r.alias("run"))
    run_type = report.select(run.alias("r")).schema["r"].dataType
    no_run, no_event = F.lit(None).cast(run_type), F.lit(None).cast(_EVENT)
    own = F.array(F.struct("seq", "event", "payload"))
    closing = F.when(F.col("seq").isNotNull(), own).otherwise(_closing_events(F.col("tasks")))
    rows = F.transform(closing.cast(f"array<{_EVENT}>"), lambda e: event_row(e, no_run))
    rows = F.when(F.col("seq").isNotNull(), rows).otherwise(F.concat(F.array(event_row(no_event, run)), rows))
    return report.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")


def run_rows(log: DataFrame) -> DataFrame:
    """One row per run: ``mode``, ``status``, ``output`` and the figures of its report.

    ``status`` is ``waiting`` without a reply, ``failed`` where that call failed, ``plan_error`` where the
    reply is JSON but no plan, ``running`` while a subtask has no response, else ``done``. There is
    an output only then, and figures from ``running`` on.
    """
    return log.where(F.col("run").isNotNull()).select("run_id", "run.*")


def event_rows(log: DataFrame) -> DataFrame:
    """Events of all runs, ``(run_id, seq, event, payload)``."""
    return log.where(F.col("run").isNull()).select("run_id", "seq", "event", "payload")


def run_frames(log: DataFrame) -> DataFrame:
    """The lines that a reader of a run receives, ``(run_id, seq, line)``: events, output in slices, the closing line."""
    run = F.col("run")
    is_build = run["mode"] == "build"
    first = F.when(is_build, run["subtask_count"] * 2 + FIRST_UPDATE + 4).otherwise(F.lit(3).cast("bigint"))
    pieces = chunks(run["output"], V.CHUNK_WIDTH)
    texts = F.transform(pieces, lambda t, i: F.struct((first + i).alias("seq"), text_frame(t).alias("line")))
    # a direct answer's usage follows its text, and takes a number
    end = first + F.size(pieces) + F.when(is_build, 0).otherwise(F.lit(1))
    last = F.array(F.struct(end.alias("seq"), finish_frame("stop").alias("line")))
    lines = F.when(run.isNull(), F.array(F.struct(F.col("seq"), data_frame("payload").alias("line")))).when(
        run["status"] == "done", F.concat(texts, last)
    )
    return log.select("run_id", F.explode(lines).alias("l")).select("run_id", "l.*")
