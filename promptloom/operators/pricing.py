"""Tiers and prices that are tables: routing to any number of tiers, and prices as of a date.

Both are look-ups in sorted bounds. The bounds of a provider, or the prices of a model in the order of the
date from which they hold, are one row with an array; rows meet it by an equi-join, which Spark broadcasts
where the table is small enough and shuffles otherwise, and find their place by halving. There is no join on
a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import as_column, let, round_exact
from promptloom.functions.models import PER_MILLION, Pricing
from promptloom.operators.ledger import usage_fields


def count_below(bounds: Column, value: Column, inclusive: bool = False) -> Column:
    """How many of the ascending ``bounds`` are below ``value`` (or equal to it, if ``inclusive``), by halving."""

    def found(b: Column) -> Column:
        steps = F.ceil(F.log2(F.size(b) + F.lit(1.0))).cast("int") + 1
        start = F.struct(F.lit(0).alias("low"), F.size(b).alias("high"))

        def halve(at: Column, _: Column) -> Column:
            middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
            below = F.get(b, middle) <= value if inclusive else F.get(b, middle) < value
            return F.when(at["low"] >= at["high"], at).otherwise(
                F.struct(
                    F.when(below, middle + 1).otherwise(at["low"]).alias("low"),
                    F.when(below, at["high"]).otherwise(middle).alias("high"),
                )
            )

        return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda at: at["low"])

    return let(bounds, found)


# --- tiers -------------------------------------------------------------------------------------------


def route_tiers(tasks: DataFrame, tiers: DataFrame, *by: str, estimate: str = "estimated_tokens") -> DataFrame:
    """Subtasks with the ``assigned_model`` of the tier that their estimate falls in.

    ``tiers`` is ``(by..., model, up_to)``: a tier holds estimates up to ``up_to``, included, from the tier below
    on; null is the tier without an upper bound. ``by`` are columns, such as a provider, that have tiers of their own.
    Without an estimate, or above all tiers, the model is null.
    """
    # null, which has no bound, comes last
    order = F.struct(F.col("up_to").isNull().alias("open"), F.col("up_to").cast("bigint").alias("up_to"), F.col("model"))
    listed = tiers.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("_tiers"))
    # tiers for all are one value, which is no join at all
    joined = tasks.join(listed, list(by), "left") if by else tasks.withColumn("_tiers", listed.scalar())
    bounds = F.transform(F.filter("_tiers", lambda t: ~t["open"]), lambda t: t["up_to"])
    at = count_below(bounds, F.col(estimate).cast("bigint"))
    model = F.when(F.col(estimate).isNotNull(), F.get(F.col("_tiers"), at)["model"])
    return joined.select(*tasks.columns, model.alias("assigned_model"))


# --- prices ------------------------------------------------------------------------------------------


PRICE_FIELDS = ("weight", "usd_per_1m_input", "usd_per_1m_output")


def price_table(spark, *pricings: Pricing, valid_from: str = "1970-01-01") -> DataFrame:
    """The two tiers of each provider as a price table: any model that is not the heavy one has the light price."""
    rows = [
        (p.provider, model, tier.weight, *(0.0 if p.is_local else x for x in (tier.usd_per_1m_input, tier.usd_per_1m_output)))
        for p in pricings
        for model, tier in ((None, p.light), (p.heavy.model, p.heavy))
    ]
    schema = "provider string, model string, " + ", ".join(f"{f} double" for f in PRICE_FIELDS)
    return spark.createDataFrame(rows, schema).withColumn("valid_from", F.lit(valid_from).cast("date"))


def with_prices(
    calls: DataFrame, prices: DataFrame, at: Column | str, provider: str = "provider", model: str = "assigned_model"
) -> DataFrame:
    """Calls with the ``price`` that held for their model at the date ``at``: a struct of :data:`PRICE_FIELDS`.

    ``prices`` is ``(provider, model, valid_from, weight, usd_per_1m_input, usd_per_1m_output)``. A row without
    model is the provider's default, for models that have no row of that date or before. Of rows of one date the
    highest counts. Where not even a default holds, the price is null.
    """
    entry = F.struct("valid_from", *PRICE_FIELDS)
    history = prices.groupBy("provider", "model").agg(F.array_sort(F.collect_list(entry)).alias("_h"))
    own = history.where("model IS NOT NULL").select(
        F.col("provider").alias("_op"), F.col("model").alias("_om"), F.col("_h").alias("_own")
    )
    default = history.where("model IS NULL").select(F.col("provider").alias("_dp"), F.col("_h").alias("_default"))
    day = as_column(at).cast("date")

    def as_of(listed: Column) -> Column:
        n = count_below(F.transform(listed, lambda e: e["valid_from"]), day, inclusive=True)
        return let(n, lambda k: F.when(k > 0, F.get(listed, k - 1)))

    price = F.coalesce(as_of(F.col("_own")), as_of(F.col("_default")))
    joined = calls.join(own, (calls[provider] == F.col("_op")) & (calls[model] == F.col("_om")), "left")
    joined = joined.join(default, calls[provider] == F.col("_dp"), "left")
    fields = let(price, lambda p: F.when(p.isNotNull(), F.struct(*[p[f].alias(f) for f in PRICE_FIELDS])))
    return joined.select(*[calls[c] for c in calls.columns], fields.alias("price"))


def priced_ledger(calls: DataFrame) -> DataFrame:
    """Real usage and cost per run of :func:`with_prices` calls ``(run_id, input_tokens, output_tokens, price)``.

    The columns of ``ledger.usage_ledger``, ``subtask_count`` aside, and ``unpriced``, the calls that have no price.
    Tokens are added as integers by price, and the prices of a run in their order, so a result does
    not depend on the order of the rows.
    """
    none = F.lit(0).cast("bigint")
    by_price = calls.groupBy("run_id", "price").agg(
        F.sum(F.coalesce("input_tokens", none)).alias("i"), F.sum(F.coalesce("output_tokens", none)).alias("o"), F.count(F.lit(1)).alias("n")
    )
    listed = F.array_sort(F.collect_list(F.struct("price", "i", "o")))
    rows = by_price.groupBy("run_id").agg(
        listed.alias("_p"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"),
        F.sum(F.when(F.col("price").isNull(), F.col("n")).otherwise(none)).alias("unpriced"),
    )

    def total(amount) -> Column:
        return F.aggregate("_p", F.lit(0.0), lambda sum_, e: sum_ + F.coalesce(amount(e, e["price"]), F.lit(0.0)))

    costs = rows.select(
        "*",
        total(lambda e, p: (e["i"] + e["o"]) * p["weight"]).alias("_units"),
        total(lambda e, p: e["i"] * (p["usd_per_1m_input"] / PER_MILLION)).alias("_in_usd"),
        total(lambda e, p: e["o"] * (p["usd_per_1m_output"] / PER_MILLION)).alias("_out_usd"),
    )
    return costs.select("run_id", *usage_fields(), "unpriced")


def priced_calls(outcomes: DataFrame, decomposition: DataFrame, provider: str, light_model: str) -> DataFrame:
    """Subtask calls and the planning call of each run as rows ``(run_id, provider, assigned_model, input_tokens, output_tokens)``."""
    tasks = outcomes.select(
        "run_id", F.lit(provider).alias("provider"), "assigned_model", F.col("real_input_tokens").alias("input_tokens"), F.col("real_output_tokens").alias("output_tokens")
    )
    plans = decomposition.select("run_id", F.lit(provider).alias("provider"), F.lit(light_model).alias("assigned_model"), "input_tokens", "output_tokens")
    return tasks.unionByName(plans)


def cost_per_call(calls: DataFrame) -> DataFrame:
    """Calls with what each costs in USD, rounded to six digits."""
    i, o = F.col("input_tokens"), F.col("output_tokens")
    price = F.col("price")
    usd = i * (price["usd_per_1m_input"] / PER_MILLION) + o * (price["usd_per_1m_output"] / PER_MILLION)
    return calls.withColumn("cost_usd", round_exact(usd, 6))
