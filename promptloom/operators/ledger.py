"""Token and cost accounting per run.

Token counts are summed as integers per tier and priced once per run, so a result does not depend on
the order in which partitions are added up. Everything known about a run comes out of one aggregation
(:func:`run_totals`); plan saving, ledger and saving breakdown are projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import round_exact
from promptloom.functions.models import Pricing, short_model

_PLAN_SUMS = ("estimated_tokens", "heavy_estimated_tokens")
_USAGE_SUMS = ("input_tokens", "output_tokens", "heavy_input_tokens", "heavy_output_tokens")


def _heavy_only(column: str, pricing: Pricing) -> Column:
    return F.when(pricing.is_heavy("assigned_model"), F.col(column)).otherwise(0).cast("bigint")


def _plan_rows(routed: DataFrame, pricing: Pricing) -> list[Column]:
    return [
        F.col("estimated_tokens").cast("bigint").alias("estimated_tokens"),
        _heavy_only("estimated_tokens", pricing).alias("heavy_estimated_tokens"),
    ]


def _usage_rows(pricing: Pricing) -> list[Column]:
    return [
        F.col("real_input_tokens").alias("input_tokens"),
        F.col("real_output_tokens").alias("output_tokens"),
        _heavy_only("real_input_tokens", pricing).alias("heavy_input_tokens"),
        _heavy_only("real_output_tokens", pricing).alias("heavy_output_tokens"),
    ]


def _total(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.groupBy("run_id").agg(*[F.sum(n).alias(n) for n in names])


def _decomposition_rows(decomposition: DataFrame, zeros: tuple[str, ...]) -> DataFrame:
    """The planning call of each run as one more call on the light model."""
    zero = F.lit(0).cast("bigint")
    return decomposition.select(
        "run_id",
        F.coalesce("input_tokens", zero).cast("bigint").alias("input_tokens"),
        F.coalesce("output_tokens", zero).cast("bigint").alias("output_tokens"),
        F.coalesce("uncompressed_tokens", zero).cast("bigint").alias("uncompressed_tokens"),
        *[zero.alias(z) for z in zeros],
    )


#: Integer totals of a run, over its subtask calls and its planning call.
TOTALS = (*_PLAN_SUMS, *_USAGE_SUMS, "subtask_count", "uncompressed_tokens")


def call_rows(outcomes: DataFrame, pricing: Pricing, *keep: str) -> DataFrame:
    """What each subtask adds to the totals of its run; ``keep`` names further columns."""
    return outcomes.select(
        "run_id",
        *keep,
        *_plan_rows(outcomes, pricing),
        *_usage_rows(pricing),
        F.lit(1).cast("bigint").alias("subtask_count"),
        F.lit(0).cast("bigint").alias("uncompressed_tokens"),
    )


def planning_rows(decomposition: DataFrame) -> DataFrame:
    """What the planning call adds to the totals of its run."""
    return _decomposition_rows(decomposition, (*_PLAN_SUMS, "heavy_input_tokens", "heavy_output_tokens", "subtask_count"))


def run_totals(outcomes: DataFrame, decomposition: DataFrame, pricing: Pricing) -> DataFrame:
    """Integer totals of each run: planned, used (both also for the heavy model) and uncompressed.

    ``decomposition``: ``(run_id, input_tokens, output_tokens, uncompressed_tokens)``, one row per
    run. Runs without subtasks are kept.
    """
    return _total(call_rows(outcomes, pricing).unionByName(planning_rows(decomposition)), TOTALS)


def _saving_fields(pricing: Pricing) -> list[Column]:
    total, heavy_total = F.col("estimated_tokens"), F.col("heavy_estimated_tokens")
    heavy = pricing.heavy.weight
    baseline = total * heavy
    routed = (total - heavy_total) * pricing.light.weight + heavy_total * heavy
    equivalent = F.bround((baseline - routed) / heavy, 0) if heavy else F.lit(0)
    return [
        total.alias("total_estimated_tokens"),
        baseline.alias("baseline_cost"),
        routed.alias("routed_cost"),
        equivalent.cast("bigint").alias("savings_token_equiv"),
        F.when(baseline != 0, round_exact((baseline - routed) / baseline, 4))
        .otherwise(F.lit(0.0))
        .alias("savings_pct"),
    ]


def plan_savings(routed: DataFrame, pricing: Pricing) -> DataFrame:
    """Estimated saving of routing, per run, against one run on the heavy model."""
    rows = routed.select(
        "run_id", *_plan_rows(routed, pricing), F.lit(1).cast("bigint").alias("subtask_count")
    )
    totals = _total(rows, (*_PLAN_SUMS, "subtask_count"))
    return totals.select("run_id", "subtask_count", *_saving_fields(pricing))


def _cost_fields(pricing: Pricing) -> list[Column]:
    """Unrounded cost units, input cost and output cost of a run."""
    i, o, hi, ho = (F.col(n) for n in _USAGE_SUMS)
    light_in, light_out = pricing.paid_usd(pricing.light)
    heavy_in, heavy_out = pricing.paid_usd(pricing.heavy)
    return [
        ((i - hi + o - ho) * pricing.light.weight + (hi + ho) * pricing.heavy.weight).alias("_units"),
        ((i - hi) * light_in + hi * heavy_in).alias("_in_usd"),
        ((o - ho) * light_out + ho * heavy_out).alias("_out_usd"),
    ]


def usage_fields() -> list[Column]:
    """Rounded usage of ``input_tokens``, ``output_tokens``, ``_units``, ``_in_usd`` and ``_out_usd``."""
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return [
        i.alias("real_input_tokens"),
        o.alias("real_output_tokens"),
        (i + o).alias("real_total_tokens"),
        round_exact("_units", 1).alias("real_cost_units"),
        round_exact("_in_usd", 6).alias("real_input_cost_usd"),
        round_exact("_out_usd", 6).alias("real_output_cost_usd"),
        round_exact(F.col("_in_usd") + F.col("_out_usd"), 6).alias("real_total_cost_usd"),
    ]


def _breakdown_fields(pricing: Pricing) -> list[Column]:
    price_in, price_out = pricing.cloud_usd(pricing.heavy)
    real_in, real_out = F.col("input_tokens"), F.col("output_tokens")
    paid = F.col("_in_usd") + F.col("_out_usd")
    before = F.greatest(F.col("uncompressed_tokens"), real_in)
    baseline = before * price_in + real_out * price_out
    same_tokens = real_in * price_in + real_out * price_out
    return [
        F.lit(pricing.provider).alias("provider"),
        round_exact(baseline, 6).alias("baseline_cost_usd"),
        round_exact(paid, 6).alias("actual_cost_usd"),
        round_exact(baseline - paid, 6).alias("total_saving_usd"),
        F.when(baseline != 0, round_exact((baseline - paid) / baseline, 4))
        .otherwise(F.lit(0.0))
        .alias("savings_pct"),
        round_exact((before - real_in) * price_in, 6).alias("compression_saving_usd"),
        round_exact(same_tokens - paid, 6).alias("routing_saving_usd"),
        short_model(F.lit(pricing.heavy.model)).alias("baseline_model"),
    ]


def _priced(totals: DataFrame, pricing: Pricing) -> DataFrame:
    return totals.select("*", *_cost_fields(pricing))


def usage_ledger(totals: DataFrame, pricing: Pricing) -> DataFrame:
    """Real usage and cost per run: the planning call (light model) plus every subtask."""
    return _priced(totals, pricing).select("run_id", "subtask_count", *usage_fields())


def savings_breakdown(totals: DataFrame, pricing: Pricing) -> DataFrame:
    """Saving per run against one uncompressed call to the heavy cloud model, by lever."""
    return _priced(totals, pricing).select("run_id", *_breakdown_fields(pricing))


def run_report(totals: DataFrame, pricing: Pricing, *keep: str) -> DataFrame:
    """One row per run: plan totals, real usage and savings, in one projection; ``keep`` names further columns."""
    plan = {"total_estimated_tokens": None, "savings_token_equiv": None, "savings_pct": "plan_savings_pct"}
    priced = _priced(totals, pricing).withColumn("_plan", F.struct(*_saving_fields(pricing)))
    return priced.select(
        "run_id",
        *keep,
        "subtask_count",
        *[F.col(f"_plan.{n}").alias(alias or n) for n, alias in plan.items()],
        *usage_fields(),
        *_breakdown_fields(pricing),
    )


def usage_per_subtask(outcomes: DataFrame, pricing: Pricing) -> DataFrame:
    """Usage and cost of every subtask."""
    in_price, out_price = pricing.usd_columns("assigned_model")
    i, o = F.col("real_input_tokens"), F.col("real_output_tokens")
    return outcomes.select(
        "run_id",
        "id",
        "title",
        short_model("assigned_model").alias("model"),
        i.alias("input_tokens"),
        o.alias("output_tokens"),
        round_exact(i * in_price + o * out_price, 6).alias("cost_usd"),
    )


def usage_perform(responses: DataFrame) -> DataFrame:
    """Usage of runs answered directly: one unit per token and no cost."""
    i = F.coalesce(F.col("input_tokens"), F.lit(0)).cast("bigint")
    o = F.coalesce(F.col("output_tokens"), F.lit(0)).cast("bigint")
    return responses.select(
        "run_id",
        i.alias("real_input_tokens"),
        o.alias("real_output_tokens"),
        (i + o).alias("real_total_tokens"),
        (i + o).cast("double").alias("real_cost_units"),
        *[
            F.lit(0.0).alias(name)
            for name in ("real_input_cost_usd", "real_output_cost_usd", "real_total_cost_usd")
        ],
    )


def usage_shares(ledger: DataFrame) -> DataFrame:
    """Input and output share of each run's cost, in percent (of 1 when it cost nothing)."""
    cost = F.col("real_total_cost_usd")
    total = F.when(cost != 0, cost).otherwise(F.lit(1.0))
    return ledger.select(
        "run_id",
        (F.col("real_input_cost_usd") / total * 100).alias("input_pct"),
        (F.col("real_output_cost_usd") / total * 100).alias("output_pct"),
    )


def savings_shares(savings: DataFrame) -> DataFrame:
    """Share of each lever in the saving, in percent, and the headline percentage."""
    saving = F.col("total_saving_usd")
    total = F.when(saving > 0, saving).otherwise(F.lit(1.0))
    local = F.coalesce(F.col("provider") != "bedrock", F.lit(True))
    return savings.select(
        "run_id",
        (F.col("compression_saving_usd") / total * 100).alias("compression_pct"),
        (F.col("routing_saving_usd") / total * 100).alias("routing_pct"),
        F.when(local, F.lit(100.0)).otherwise(round_exact(F.col("savings_pct") * 100, 0, ties_up=True)).alias("headline_pct"),
    )
