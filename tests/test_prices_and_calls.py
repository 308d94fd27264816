"""Tiers and prices as tables, calls that are not repeated, stage requests, table formats."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from checks.fixtures import decomposition, fixture
from promptloom.functions.models import default_pricing
from promptloom.operators import answers as A
from promptloom.operators import inference as I
from promptloom.operators import ledger as L
from promptloom.operators import planning as P
from promptloom.operators import pricing as R
from promptloom.sources.tables import read_table, write_table

LOCAL, CLOUD = default_pricing(), default_pricing("bedrock")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# --- tiers ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bounds", [[], [5], [1, 2, 3], [0, 0, 4, 9, 9, 12], list(range(0, 300, 7))])
def test_halving_finds_the_place(spark, bounds):
    array = F.array(*[F.lit(b) for b in bounds]).cast("array<int>")
    found = spark.range(-2, 310).select("id", R.count_below(array, F.col("id")).alias("n"), R.count_below(array, F.col("id"), True).alias("m")).collect()
    assert [(r.n, r.m) for r in found] == [(sum(b < r.id for b in bounds), sum(b <= r.id for b in bounds)) for r in found]


def test_two_tiers_route_as_the_limit_does(spark, sf_dir):
    tasks = fixture(spark, sf_dir, "tasks").select("run_id", "position", "estimated_tokens")
    tasks = tasks.union(spark.sql("SELECT 1L, 99L, 600L UNION ALL SELECT 1L, 98L, 601L UNION ALL SELECT 1L, 97L, NULL"))
    tiers = spark.createDataFrame([(CLOUD.heavy.model, None), (CLOUD.light.model, 600)], "model string, up_to int")
    routed = R.route_tiers(tasks, tiers)
    assert rows(routed) == rows(P.route(tasks, CLOUD))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_tiers_by_provider(spark):
    tiers = spark.createDataFrame(
        [("a", "small", 10), ("a", "mid", 100), ("a", "large", 1000), ("b", "only", None)], "provider string, model string, up_to bigint"
    )
    tasks = spark.createDataFrame(
        [(p, e) for p in ("a", "b", "c") for e in (-1, 10, 11, 100, 1000, 1001, None)], "provider string, estimated_tokens bigint"
    )
    found = {(r.provider, r.estimated_tokens): r.assigned_model for r in R.route_tiers(tasks, tiers, "provider").collect()}
    expected = {-1: "small", 10: "small", 11: "mid", 100: "mid", 1000: "large", 1001: None, None: None}
    assert found == {("a", e): m for e, m in expected.items()} | {("b", e): "only" if e is not None else None for e in expected} | {("c", e): None for e in expected}


# --- prices ---------------------------------------------------------------------------------------------


def test_todays_prices_are_those_of_the_tiers(spark, sf_dir):
    prices = R.price_table(spark, LOCAL, CLOUD)
    tasks, responses = fixture(spark, sf_dir, "tasks"), fixture(spark, sf_dir, "responses")
    for pricing in (LOCAL, CLOUD):
        outcomes = P.subtask_outcome(P.route(tasks, pricing), responses)
        spent = decomposition(spark, sf_dir)
        calls = R.priced_calls(outcomes, spent, pricing.provider, pricing.light.model)
        got = R.priced_ledger(R.with_prices(calls, prices, F.current_date()))
        expected = L.usage_ledger(L.run_totals(outcomes, spent, pricing), pricing).drop("subtask_count")
        assert rows(got.drop("unpriced")) == rows(expected)
        assert got.agg(F.sum("unpriced")).first()[0] == 0


def test_prices_as_of_a_date(spark):
    schema = "provider string, model string, valid_from string, weight double, usd_per_1m_input double, usd_per_1m_output double"
    prices = spark.createDataFrame(
        [
            ("p", "m", "2024-01-01", 1.0, 1.0, 2.0), ("p", "m", "2024-06-01", 1.0, 3.0, 4.0), ("p", None, "2023-01-01", 5.0, 9.0, 9.0),
            ("p", None, "2024-03-01", 5.0, 8.0, 8.0), ("q", "m", "2024-01-01", 1.0, 7.0, 7.0),
        ],
        schema,
    ).withColumn("valid_from", F.col("valid_from").cast("date"))
    calls = spark.createDataFrame(
        [
            ("p", "m", "2023-12-31", 9.0), ("p", "m", "2024-01-01", 1.0), ("p", "m", "2024-05-31", 1.0), ("p", "m", "2024-06-01", 3.0), ("p", "other", "2024-03-01", 8.0),
            ("p", None, "2024-02-01", 9.0), ("p", "m", "2022-01-01", None), ("q", "x", "2025-01-01", None), ("r", "m", "2025-01-01", None), ("p", "m", None, None),
        ],
        "provider string, assigned_model string, day string, expected double",
    )
    found = R.with_prices(calls, prices, "day").collect()
    assert len(found) == calls.count()
    assert all((r.price and r.price.usd_per_1m_input) == r.expected for r in found)
    cost = R.cost_per_call(R.with_prices(calls, prices, "day").withColumn("input_tokens", F.lit(1000)).withColumn("output_tokens", F.lit(500)))
    assert {r.cost_usd for r in cost.where("expected = 1.0").collect()} == {0.002}


# --- calls ----------------------------------------------------------------------------------------------


def request(i, limit=8):
    return (f"{i % 4:02x}{i:06d}", "local", "m", "", f"q{i}", limit)


def test_a_task_killed_midway_answers_nothing_twice(tmp_path):
    store, made, lock = str(tmp_path), [], threading.Lock()

    def model(system, messages, name, limit):
        with lock:
            made.append(messages)
        return messages.upper(), 1, 2

    todo = sorted(request(i) for i in range(40)) + [request(39)]
    running = A.call_once(iter(todo), {"local": model}, store, concurrency=3, tries=1, wait=0)
    for _ in range(4):
        next(running)
    running.close()  # the task is lost here
    assert 0 < len(made) < 40
    before = len(made)
    assert sum(A.call_once(iter(todo), {"local": model}, store, 3, 1, 0)) == 40 - before
    assert sorted(made) == sorted(f"q{i}" for i in range(40))
    assert list(A.call_once(iter(todo), {"local": model}, store, 3, 1, 0)) == [] and len(made) == 40


def test_failed_calls_wait_and_are_made_again(spark, tmp_path):
    store, waits, state = str(tmp_path), [], {"up": False}

    def model(system, messages, name, limit):
        if messages == "q1" and not state["up"]:
            raise ValueError("busy")
        return messages, 1, 1

    some = [request(i) for i in range(3)]
    list(A.call_once(iter(some), {"local": model}, store, 1, 3, 0.5, waits.append))
    assert waits == [0.5, 1.0]
    first = {r.digest: (r.text, r.error) for r in A.stored_answers(spark, store).collect()}
    assert first == {some[0][0]: ("q0", None), some[1][0]: (None, "busy"), some[2][0]: ("q2", None)}
    state["up"] = True
    assert list(A.call_once(iter(some), {"local": model}, store, 1, 3, 0.5, waits.append)) == [1]
    assert {r.digest: (r.text, r.error) for r in A.stored_answers(spark, store).collect()}[some[1][0]] == ("q1", None)


def test_a_job_that_is_started_again(spark, tmp_path):
    store, log, marker = str(tmp_path / "store"), str(tmp_path / "calls"), str(tmp_path / "died")
    os.makedirs(log)

    def model(system, messages, name, limit):
        import pathlib
        import uuid

        if messages == "q7" and not os.path.exists(marker):
            pathlib.Path(marker).touch()
            os._exit(1)  # the executor's worker is lost
        pathlib.Path(log, f"{messages}-{uuid.uuid4().hex}").touch()
        return f"{name}:{messages}", len(messages), limit

    requests = spark.range(30).selectExpr("id", "'local' provider", "'m' model", "'' system", "concat('q', id % 20) messages")
    with pytest.raises(Exception):
        A.infer_once(requests, {"local": model}, ["id"], 5, store, tasks=2)
    out = A.infer_once(requests, {"local": model}, ["id"], 5, store, tasks=2)
    assert rows(out) == sorted(((None, i, len(f"q{i % 20}"), 5, f"m:q{i % 20}") for i in range(30)), key=repr)
    # equal requests are one call, and none was made twice but what the lost worker had under way
    assert sorted(f.split("-")[0] for f in os.listdir(log)) == sorted(f"q{i}" for i in range(20))
    other = A.infer_once(requests, {"local": model}, ["id"], 6, store)
    assert {r.output_tokens for r in other.collect()} == {6}  # another limit is another request


# --- requests of the stages, tables -----------------------------------------------------------------------


def test_stage_limits(spark):
    requests = spark.createDataFrame([(1, "hm " * 2000), (2, "build a web app")], "request_id bigint, text string")
    asked = I.intent_requests(requests, "bedrock", "S").collect()
    assert [(r.request_id, json.loads(r.request)["max_tokens"], len(json.loads(r.request)["messages"][0]["content"])) for r in asked] == [(1, 4, 2000)]
    generated = spark.createDataFrame([(1, "s", "c", "build", "plan it"), (2, "s", "c", "perform", "do it")], "request_id bigint, summary string, compressed string, intent string, prompt string")
    plan = [json.loads(r.request) for r in I.decompose_requests(generated, LOCAL, "S").collect()]
    assert [(p["options"]["num_predict"], p["model"], p["messages"][1]["content"]) for p in plan] == [(1024, LOCAL.light.model, "plan it")]
    routed = spark.createDataFrame([(1, 0, "p", CLOUD.heavy.model), (1, 1, "q", None)], "run_id bigint, position bigint, prompt string, assigned_model string")
    tasks = I.subtask_requests(routed, "bedrock").collect()
    assert [(r.position, r.model, json.loads(r.request)["max_tokens"]) for r in tasks] == [(0, CLOUD.heavy.model, 8192)]
    single = {r.request_id: json.loads(r.request) for r in I.single_prompt_requests(generated, F.when(F.col("request_id") == 1, "a.mistral").otherwise("claude")).collect()}
    assert single[1]["prompt"].startswith("<s>[INST]") and single[2]["messages"][0]["role"] == "user" and {s["max_tokens"] for s in single.values()} == {4096}


def test_tables_of_every_format(spark, tmp_path):
    table = spark.createDataFrame([(1, "a\nb", None), (2, None, 0.5), (None, "ü \"q\"", 1e300)], "id bigint, text string, x double")
    schema = "id bigint, text string, x double"
    for kind in ("parquet", "json"):
        write_table(table, f"{tmp_path}/{kind}", kind)
        assert rows(read_table(spark, f"{tmp_path}/{kind}", kind, schema)) == rows(table)
    write_table(table.select(F.to_json(F.struct("*")).alias("value")), f"{tmp_path}/text", "text")
    back = read_table(spark, f"{tmp_path}/text", "text").select(F.from_json("value", schema).alias("r")).select("r.*")
    assert rows(back) == rows(table)
    with pytest.raises(ValueError):
        read_table(spark, f"{tmp_path}/json", "json")
    with pytest.raises(ValueError):
        write_table(table, f"{tmp_path}/other", "text")
