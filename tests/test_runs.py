import json

import pytest
from pyspark.sql import functions as F

from checks.fixtures import decomposition, fixture
from promptloom.functions.models import Pricing, Tier, default_pricing, resolve_provider, short_model
from promptloom.operators import inference as I
from promptloom.operators import ledger as L
from promptloom.operators import planning as P
from promptloom.plans.generate import run_events, run_report, run_tables

LOCAL, CLOUD = default_pricing(), default_pricing(" Bedrock ")
TASK = "run_id bigint, position bigint, id bigint, title string, prompt string, estimated_tokens bigint"
RESPONSE = "run_id bigint, position bigint, text string, error string, input_tokens bigint, output_tokens bigint"


def plan_rows(spark, *raws):
    df = spark.createDataFrame([(i, r, "req") for i, r in enumerate(raws)], "run_id bigint, raw string, requirements string")
    rows = P.parse_plan(df).orderBy("run_id", "position").collect()
    return [(r.run_id, r.plan_status, r.id, r.title, r.prompt, r.estimated_tokens) for r in rows]


def test_parse_plan(spark):
    got = plan_rows(
        spark,
        '```json\n[{"id": 3, "title": "t", "prompt": "p", "estimated_tokens": "70"}, {}]\n```',
        "not json",
        " [] ",
        '{"id": 1}',
        "[1, 2]",
        '[{"estimated_tokens": 12.7, "title": null}]',
        '[{"estimated_tokens": "x"}]',
        '[{"id": 1}] trailing',
        "```\n[{\"title\": \"a\"}]```",
        '[{"id": 1}, 2]',
        '[{"id": "a"}]',
    )
    assert got == [
        (0, "ok", "3", "t", "p", 70), (0, "ok", "2", "Subtask 2", "req", 500),
        (1, "fallback", "1", "Full implementation", "req", 800),
        (3, "error", None, None, None, None), (4, "error", None, None, None, None),
        (5, "ok", "1", "Subtask 1", "req", 12), (6, "error", None, None, None, None),
        (7, "fallback", "1", "Full implementation", "req", 800),
        (8, "ok", "1", "a", "req", 500), (9, "error", None, None, None, None),
        (10, "ok", "a", "Subtask 1", "req", 500),
    ]


def test_models(spark):
    df = spark.createDataFrame(
        [("llama3.2:3b",), ("us.anthropic.claude-haiku-4-5-20251001-v1:0",), ("",), (None,), ("a.b",), ("plain",)], "m string"
    )
    assert [r[0] for r in df.select(short_model("m")).collect()] == [
        "llama3.2:3b", "claude-haiku-4-5-20251001-v1:0", "", "", "b", "plain",
    ]
    names = spark.createDataFrame([(" Bedrock ",), ("aws",), (None,)], "p string")
    assert [r[0] for r in names.select(resolve_provider("p")).collect()] == ["bedrock", "local", "local"]
    assert LOCAL.is_local and not CLOUD.is_local


def test_price_lookup(spark):
    df = spark.createDataFrame([(CLOUD.heavy.model,), ("any other",), (None,)], "m string")
    paid = df.select(*CLOUD.usd_columns("m"), CLOUD.weight("m")).collect()
    assert [tuple(r) for r in paid] == [(3e-6, 1.5e-5, 3.0), (1e-6, 5e-6, 1.0), (1e-6, 5e-6, 1.0)]
    assert {tuple(r) for r in df.select(*LOCAL.usd_columns("m")).collect()} == {(0.0, 0.0)}


def small_run(spark):
    tasks = spark.createDataFrame(
        [(1, 0, 1, "a", "p", 600), (1, 1, 2, "b", "p", 601), (1, 2, 3, "c", "p", 100), (1, 3, 4, "d", "p", 10)], TASK
    )
    responses = spark.createDataFrame(
        [(1, 0, "out", None, 100, 50), (1, 1, "big", None, 200, None), (1, 2, None, "boom", 9, 9)], RESPONSE
    )
    calls = spark.createDataFrame(
        [(1, 40, 10, 1000), (2, 7, 3, 0)], "run_id bigint, input_tokens bigint, output_tokens bigint, uncompressed_tokens bigint"
    )
    return tasks, responses, calls


def test_route_and_savings(spark):
    tasks, *_ = small_run(spark)
    routed = P.route(tasks, LOCAL)
    assert [r.assigned_model for r in routed.orderBy("id").collect()] == [
        "llama3.2:3b", "qwen2.5-coder:7b", "llama3.2:3b", "llama3.2:3b",
    ]
    row = L.plan_savings(routed, LOCAL).first()
    # 1311 tokens, of which 710 light: saved 710 * 2 of 3933 cost units.
    assert (row.total_estimated_tokens, row.baseline_cost, row.routed_cost) == (1311, 3933.0, 2513.0)
    assert (row.savings_token_equiv, row.savings_pct) == (473, 0.361)


def test_free_heavy_tier_has_no_equivalent(spark):
    free = Pricing("local", Tier("l", 0.0, 0, 0), Tier("h", 0.0, 0, 0))
    row = L.plan_savings(P.route(small_run(spark)[0], free), free).first()
    assert (row.savings_token_equiv, row.savings_pct) == (0, 0.0)


def test_outcomes_and_assembly(spark):
    tasks, responses, _ = small_run(spark)
    outcomes = P.subtask_outcome(P.route(tasks, LOCAL), responses)
    got = [(r.status, r.output, r.real_input_tokens, r.real_output_tokens) for r in outcomes.orderBy("id").collect()]
    assert got == [
        ("done", "out", 100, 50), ("done", "big", 200, 0),
        ("error", "// Error in subtask 'c': boom\n", 0, 0), ("pending", "", 0, 0),
    ]
    code = P.assemble(outcomes).collect()
    rule = "=" * 60
    assert len(code) == 1 and code[0].code.startswith(f"\n{rule}\n## 1. a  [2:3b]\n{rule}\nout\n\n{rule}\n## 2. b  [5-coder:7b]\n{rule}\nbig\n")


@pytest.mark.parametrize("pricing", [LOCAL, CLOUD])
def test_ledger_and_breakdown(spark, pricing):
    tables = run_tables(*small_run(spark), pricing)
    one, two = L.usage_ledger(tables.totals, pricing).orderBy("run_id").collect()
    paid_in, paid_out = (0.0, 0.0) if pricing.is_local else (round(140e-6 + 200 * 3e-6, 6), round(60 * 5e-6, 6))
    assert (one.real_input_tokens, one.real_output_tokens, one.subtask_count) == (340, 60, 4)
    assert one.real_cost_units == 50 + 150 + 200 * 3
    assert (one.real_input_cost_usd, one.real_output_cost_usd) == (paid_in, paid_out)
    assert (two.subtask_count, two.real_total_tokens) == (0, 10)
    row = L.savings_breakdown(tables.totals, pricing).orderBy("run_id").first()
    assert row.baseline_cost_usd == round(1000 * 3e-6 + 60 * 1.5e-5, 6)
    assert row.compression_saving_usd == round(660 * 3e-6, 6)
    assert row.total_saving_usd == pytest.approx(row.compression_saving_usd + row.routing_saving_usd, abs=1e-9)
    assert row.baseline_model == short_name(pricing)


def short_name(pricing):
    return pricing.heavy.model if pricing.is_local else "claude-sonnet-4-5-20250929-v1:0"


def test_identities_on_whole_tables(spark, sf_dir):
    tables = run_tables(fixture(spark, sf_dir, "tasks"), fixture(spark, sf_dir, "responses"), decomposition(spark, sf_dir), CLOUD)
    report = run_report(tables)
    parts = L.usage_per_subtask(tables.outcomes, CLOUD).groupBy("run_id").agg(
        F.sum("input_tokens").alias("i"), F.sum("cost_usd").alias("cost")
    )
    calls = decomposition(spark, sf_dir).withColumnRenamed("input_tokens", "d").select("run_id", "d", "output_tokens")
    for r in report.join(parts, "run_id").join(calls, "run_id").collect():
        assert r.real_input_tokens == r.i + r.d
        assert r.total_saving_usd == pytest.approx(r.compression_saving_usd + r.routing_saving_usd, abs=2e-6)
        assert r.real_total_cost_usd == pytest.approx(r.cost + r.d * 1e-6 + r.output_tokens * 5e-6, abs=5e-6)


def test_report_is_one_aggregation(spark):
    plan = run_report(run_tables(*small_run(spark), CLOUD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id") <= 3 and "Python" not in plan


def test_events(spark):
    events = run_events(run_tables(*small_run(spark), LOCAL)).orderBy("run_id", "stage", "position").collect()
    first = [e for e in events if e.run_id == 1]
    assert [e.event for e in first] == (
        ["router_status", "router_plan", "router_status"] + ["subtask_update"] * 7
        + ["router_status", "real_usage", "savings_breakdown", "router_done"]
    )
    bodies = [json.loads(e.payload) for e in first]
    assert all(b["event"] == e.event for b, e in zip(bodies, first, strict=True))
    assert [s["title"] for s in bodies[1]["subtasks"]] == ["a", "b", "c", "d"]
    assert bodies[2]["message"] == "Running 4 subtasks in parallel…"
    assert [b["status"] for b in bodies[3:10]] == ["running"] * 4 + ["done", "done", "error"]
    assert [s["inputTokens"] for s in bodies[11]["perSubtask"]] == [100, 200, 0, 0]
    empty = {e.event: json.loads(e.payload) for e in events if e.run_id == 2}
    assert empty["router_plan"]["subtasks"] == [] and empty["router_plan"]["totalEstimatedTokens"] == 0
    assert empty["router_done"] == {"event": "router_done", "subtaskCount": 0}


def test_failed_plan_has_no_tasks_and_no_model(spark):
    df = spark.createDataFrame([(1, '{"id": 1}', "r"), (2, "[{}]", "r")], "run_id bigint, raw string, requirements string")
    parsed = P.parse_plan(df)
    assert [r.run_id for r in P.planned_tasks(parsed).collect()] == [2]
    assert {r.run_id: r.assigned_model is None for r in P.route(parsed, LOCAL).collect()} == {1: True, 2: False}


def test_run_with_many_subtasks_is_one_plan(spark):
    n = 2 * 4096 + 5
    tasks = spark.range(n).selectExpr(
        "1L AS run_id", "id AS position", "id + 1 AS id", "concat('t', id) AS title", "'p' AS prompt", "10L AS estimated_tokens"
    )
    responses = spark.createDataFrame([], RESPONSE)
    calls = spark.createDataFrame([(1, 0, 0, 0)], "run_id bigint, input_tokens bigint, output_tokens bigint, uncompressed_tokens bigint")
    tables = run_tables(tasks, responses, calls, LOCAL)
    (plan,) = [json.loads(r.payload) for r in run_events(tables).filter("event = 'router_plan'").collect()]
    assert len(plan["subtasks"]) == n and plan["totalEstimatedTokens"] == 10 * n
    assert P.assemble(tables.outcomes).count() == 1


def test_shares(spark):
    ledger = spark.createDataFrame(
        [(1, 1.0, 3.0, 4.0), (2, 0.0, 0.0, 0.0)],
        "run_id bigint, real_input_cost_usd double, real_output_cost_usd double, real_total_cost_usd double",
    )
    assert [tuple(r)[1:] for r in L.usage_shares(ledger).orderBy("run_id").collect()] == [(25.0, 75.0), (0.0, 0.0)]
    savings = spark.createDataFrame(
        [(1, "bedrock", 4.0, 1.0, 3.0, 0.305), (2, "local", 0.0, 0.0, 0.0, 0.0), (3, None, -2.0, 1.0, -3.0, -0.5)],
        "run_id bigint, provider string, total_saving_usd double, compression_saving_usd double, "
        "routing_saving_usd double, savings_pct double",
    )
    assert [tuple(r)[1:] for r in L.savings_shares(savings).orderBy("run_id").collect()] == [
        (25.0, 75.0, 31.0), (0.0, 0.0, 100.0), (100.0, -300.0, 100.0),
    ]


def test_payloads(spark):
    df = spark.createDataFrame([("p", "bedrock", None), ("p", "", "m")], "prompt string, provider string, model string")
    cloud, local = (json.loads(r.request) for r in I.request_table(df, system="s", max_tokens=9).collect())
    assert cloud == {
        "anthropic_version": "bedrock-2023-05-31", "max_tokens": 9, "system": "s",
        "messages": [{"role": "user", "content": "p"}],
    }
    assert local == {
        "model": "m", "stream": False, "options": {"num_predict": 9},
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}],
    }
    single = spark.createDataFrame([("x.Mistral",), ("claude",)], "m string")
    mistral, claude = (json.loads(r[0]) for r in single.select(I.single_prompt_payload(F.lit("p"), "m", 5)).collect())
    assert mistral == {"prompt": "<s>[INST]p[/INST]", "max_tokens": 5, "temperature": 0.7, "top_p": 0.9}
    assert claude == {
        "anthropic_version": "bedrock-2023-05-31", "max_tokens": 5, "messages": [{"role": "user", "content": "p"}],
    }


def test_infer_table(spark):
    requests = spark.createDataFrame(
        [(1, "local", "m", "s", "hi"), (2, "bedrock", "m", "s", "hi"), (3, "none", "m", "s", "x")],
        "id bigint, provider string, model string, system string, messages string",
    )

    def fails(*_):
        raise RuntimeError("down")

    calls = {"local": lambda s, m, model, n: (m.upper(), len(m), n), "bedrock": fails}
    got = {r.id: (r.text, r.input_tokens, r.output_tokens, r.error) for r in I.infer_table(requests, calls, ["id"], 7).collect()}
    assert got == {1: ("HI", 2, 7, None), 2: (None, 0, 0, "down"), 3: (None, 0, 0, "'none'")}
    own = requests.withColumn("limit", F.col("id").cast("int") * 10)
    many = I.infer_table(own, calls, ["id"], "limit", concurrency=3).collect()
    assert {r.id: r.output_tokens for r in many} == {1: 10, 2: 0, 3: 0}
