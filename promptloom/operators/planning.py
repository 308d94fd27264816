"""Plan parsing, routing, outcomes and assembly of subtasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column, let, strip
from promptloom.functions.models import Pricing, short_model
from promptloom.functions.responses import json_elements
from promptloom.operators.grouping import ordered_text

_ITEMS = "array<variant>"


def strip_fences(raw: Column | str) -> Column:
    """Model text without a surrounding Markdown code fence."""
    opened = F.regexp_replace(strip(raw), r"^```[a-z]*\n?", "")
    return strip(F.regexp_replace(strip(opened), r"\n?```\z", ""))


def _is_object(item: Column) -> Column:
    return F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _unusable_number(item: Column, name: str) -> Column:
    return _field(item, name, "string").isNotNull() & _field(item, name, "bigint").isNull()


_SUBTASKS = "array<struct<id:string,title:string,prompt:string,estimated_tokens:bigint>>"


def plan_struct(raw: Column | str, requirements: Column | str) -> Column:
    """``struct<status, subtasks>`` of a plan text; see :func:`parse_plan` for both."""
    whole = as_column(requirements)

    def parsed(text: Column) -> Column:
        return let(
            F.try_parse_json(text),
            lambda v: F.struct(
                F.get(json_elements(text), F.lit(0)).isNotNull().alias("valid"),
                F.when(
                    F.startswith(F.schema_of_variant(v), F.lit("ARRAY")),
                    F.try_variant_get(v, "$", _ITEMS),
                ).alias("items"),
            ),
        )

    def unusable(item: Column) -> Column:
        return F.coalesce(~_is_object(item) | _unusable_number(item, "estimated_tokens"), F.lit(True))

    def subtask(item: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        estimate = F.coalesce(_field(item, "estimated_tokens", "bigint"), F.lit(V.DEFAULT_ESTIMATED_TOKENS))
        return F.struct(
            F.coalesce(_field(item, "id", "string"), number).alias("id"),
            F.coalesce(_field(item, "title", "string"), F.concat(F.lit("Subtask "), number)).alias("title"),
            F.coalesce(_field(item, "prompt", "string"), whole).alias("prompt"),
            estimate.cast("bigint").alias("estimated_tokens"),
        )

    fallback = F.struct(
        F.lit("1").alias("id"),
        F.lit(V.FALLBACK_TITLE).alias("title"),
        whole.alias("prompt"),
        F.lit(V.FALLBACK_ESTIMATED_TOKENS).cast("bigint").alias("estimated_tokens"),
    )

    def read(p: Column) -> Column:
        bad = p["items"].isNull() | F.exists(p["items"], unusable)
        return F.struct(
            F.when(~p["valid"], "fallback").when(bad, "error").otherwise(F.lit("ok")).alias("status"),
            F.when(~p["valid"], F.array(fallback).cast(_SUBTASKS))
            .when(~bad, F.transform(p["items"], subtask).cast(_SUBTASKS))
            .alias("subtasks"),
        )

    return let(strip_fences(raw), lambda text: let(parsed(text), read))


def parse_plan(plans: DataFrame, raw: str = "raw", requirements: str = "requirements") -> DataFrame:
    """Subtask rows ``(run_id, plan_status, id, title, prompt, estimated_tokens)`` of plan texts.

    ``ok``: a JSON array of objects, absent fields (or null ones) filled with defaults; an empty
    array gives no rows. ``fallback``: not JSON, one subtask for everything. ``error``: JSON of
    another shape, or an estimate that is no number; one row without subtask fields. Ids are text,
    since a model may write them as either.
    """
    no_fields = F.array(F.lit(None)).cast(_SUBTASKS)
    subtasks = F.coalesce("_p.subtasks", no_fields)
    return (
        plans.select("run_id", plan_struct(raw, requirements).alias("_p"))
        .select("run_id", F.col("_p.status").alias("plan_status"), F.posexplode(subtasks).alias("position", "_s"))
        .select("run_id", "plan_status", "position", "_s.*")
    )


def planned_tasks(parsed: DataFrame) -> DataFrame:
    """Subtasks of the plans that can run; a plan that failed has none."""
    return parsed.filter(F.col("plan_status") != "error").drop("plan_status")


def assigned_model(
    estimated_tokens: Column | str, pricing: Pricing, limit: int = V.ROUTING_TOKEN_LIMIT
) -> Column:
    """Light model up to the limit, heavy model above it; without an estimate none."""
    estimate = as_column(estimated_tokens)
    return F.when(estimate <= limit, pricing.light.model).when(estimate > limit, pricing.heavy.model)


def route(tasks: DataFrame, pricing: Pricing, limit: int = V.ROUTING_TOKEN_LIMIT) -> DataFrame:
    """Subtasks with their ``assigned_model``."""
    return tasks.withColumn("assigned_model", assigned_model("estimated_tokens", pricing, limit))


def subtask_outcome(routed: DataFrame, responses: DataFrame) -> DataFrame:
    """Subtasks with the result of their model call.

    ``responses``: ``(run_id, position, text, error, input_tokens, output_tokens)``, one row per
    subtask; ids come from a model's plan and may repeat, positions do not. An error gives an error
    text and no usage; no response leaves the subtask pending.
    """
    answers = responses.select(
        "run_id",
        "position",
        F.col("text").alias("_text"),
        F.col("error").alias("_error"),
        F.col("input_tokens").alias("_in"),
        F.col("output_tokens").alias("_out"),
        F.lit(True).alias("_answered"),
    )
    failed = F.col("_error").isNotNull()
    message = F.concat(
        F.lit("// Error in subtask '"), F.col("title"), F.lit("': "), F.col("_error"), F.lit("\n")
    )

    def usage(column: str) -> Column:
        return F.when(failed, 0).otherwise(F.coalesce(F.col(column), F.lit(0))).cast("bigint")

    return routed.join(answers, ["run_id", "position"], "left").select(
        *routed.columns,
        F.when(failed, message).otherwise(F.coalesce(F.col("_text"), F.lit(""))).alias("output"),
        F.when(F.col("_answered").isNull(), "pending")
        .when(failed, "error")
        .otherwise(F.lit("done"))
        .alias("status"),
        usage("_in").alias("real_input_tokens"),
        usage("_out").alias("real_output_tokens"),
    )


def section(tasks: DataFrame) -> Column:
    """Header and output of one subtask."""
    rule = F.lit("=" * V.SECTION_RULE_WIDTH + "\n")
    return F.concat(
        F.lit("\n"),
        rule,
        F.lit("## "),
        tasks["id"].cast("string"),
        F.lit(". "),
        tasks["title"],
        F.lit("  ["),
        F.substring_index(tasks["assigned_model"], ".", -1),
        F.lit("]\n"),
        rule,
        tasks["output"],
    )


def assemble(tasks: DataFrame, order: str = "position") -> DataFrame:
    """Sections of a run joined in list order, as ``(run_id, code)``."""
    return ordered_text(tasks, ["run_id"], order, section(tasks), "code", separator="\n")


def labelled(tasks: DataFrame) -> DataFrame:
    """Subtasks with the short label of their model."""
    return tasks.withColumn("model", short_model("assigned_model"))
