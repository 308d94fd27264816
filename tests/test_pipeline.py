"""The composed run: every status, the order of events, one read of each table, frames and back."""

import json

import pytest

from checks.fixtures import fixture
from promptloom.functions.models import default_pricing
from promptloom.operators import logs, run_state
from promptloom.plans import pipeline as L

LOCAL, CLOUD = default_pricing(), default_pricing("bedrock")
TURN = "conv_id bigint, turn bigint, role string, text string"
REPLY = "run_id bigint, text string, error string, input_tokens bigint, output_tokens bigint"
RESPONSE = "run_id bigint, position bigint, text string, error string, input_tokens bigint, output_tokens bigint"
PLAN = json.dumps([{"id": "a", "title": "One", "prompt": "p", "estimated_tokens": 100}, {"title": "Two", "estimated_tokens": 900}])


@pytest.fixture(scope="module")
def log(spark):
    asks = {i: "build a web app" for i in range(1, 7)} | {7: "explain the theory to me", 8: ""}
    turns = spark.createDataFrame([(i, 0, "user", t) for i, t in asks.items()], TURN)
    answers = spark.createDataFrame([], "request_id bigint, answer string")
    replies = spark.createDataFrame(
        [
            (1, PLAN, None, 10, 20), (2, PLAN, None, 1, None), (3, '{"id": 1}', None, 5, 5), (4, None, "down", 9, 9),
            (6, "[]", None, 3, 4), (7, "The answer is forty-two.", None, 30, 6), (8, "no json", None, None, None), (99, PLAN, None, 1, 1),
        ],
        REPLY,
    )
    responses = spark.createDataFrame(
        [(1, 0, "code 1", None, 100, 200), (1, 1, None, "boom", 7, 7), (2, 1, "late", None, 1, 2), (8, 0, "all", None, 4, 5), (3, 0, "x", None, 1, 1)],
        RESPONSE,
    )
    return L.run_log(turns, answers, replies, responses, CLOUD)


def test_status_and_figures_of_every_kind_of_run(log):
    rows = {r.run_id: r for r in L.run_rows(log).collect()}
    assert {i: (r.mode, r.status) for i, r in rows.items()} == {
        1: ("build", "done"), 2: ("build", "running"), 3: ("build", "plan_error"), 4: ("build", "failed"), 5: ("build", "waiting"),
        6: ("build", "done"), 7: ("perform", "done"), 8: ("build", "done"),
    }
    one = rows[1]
    assert (one.subtask_count, one.total_estimated_tokens, one.real_input_tokens, one.real_output_tokens) == (2, 1000, 110, 220)
    assert one.output.index("## a. One") < one.output.index("## 2. Two") and "// Error in subtask 'Two': boom" in one.output
    assert rows[2].output is None and (rows[2].real_input_tokens, rows[2].real_output_tokens) == (2, 2)
    assert rows[6].output == "" and rows[6].subtask_count == 0 and rows[6].real_total_tokens == 7
    assert (rows[7].output, rows[7].real_cost_units, rows[7].real_total_cost_usd, rows[7].provider) == ("The answer is forty-two.", 36.0, 0.0, None)
    for i in (3, 4, 5):
        assert rows[i].output is None and rows[i].real_total_tokens is None and rows[i].subtask_count is None
    # nothing was asked for, so the one subtask of the fallback is about nothing
    assert rows[8].subtask_count == 1 and rows[8].real_total_tokens == 9


def test_events_ascend_and_stop_where_a_run_stopped(log):
    events = {}
    for r in L.event_rows(log).orderBy("run_id", "seq").collect():
        events.setdefault(r.run_id, []).append((r.seq, r.event, json.loads(r.payload)))
    kinds = lambda i: [e for _, e, _ in events[i]]
    start = ["compression_stats", "compression_diff", "task_mode"]
    planned = ["router_status", "router_plan", "router_status"]
    end = ["router_status", "real_usage", "savings_breakdown", "router_done"]
    assert kinds(1) == start + planned + ["subtask_update"] * 4 + end
    assert [(p["id"], p["status"]) for _, e, p in events[1] if e == "subtask_update"] == [
        ("a", "running"), ("2", "running"), ("a", "done"), ("2", "error"),
    ]
    assert kinds(2) == start + planned + ["subtask_update"] * 3
    assert kinds(3) == kinds(4) == kinds(5) == start
    assert kinds(6) == start + planned + end
    assert kinds(7) == start + ["real_usage"]
    for listed in events.values():
        numbers = [n for n, _, _ in listed]
        assert numbers == sorted(set(numbers))
    usage = next(p for _, e, p in events[1] if e == "real_usage")
    assert [(t["id"], t["inputTokens"], t["outputTokens"]) for t in usage["perSubtask"]] == [("a", 100, 200), ("2", 0, 0)]


def test_frames_read_back_give_the_run(log, spark):
    frames = L.run_frames(log)
    numbered = [(r.run_id, r.seq) for r in frames.collect()]
    assert len(numbered) == len(set(numbered))
    texts = {r.run_id: r.text for r in logs.run_text(frames).collect()}
    rows = {r.run_id: r for r in L.run_rows(log).collect()}
    assert texts == {i: r.output for i, r in rows.items() if r.output}
    latest = run_state.latest_events(run_state.data_events(frames))
    state = {r.run_id: r for r in run_state.run_report(latest).collect()}
    for i, r in rows.items():
        assert state[i].task_mode == r.mode
        assert state[i].real_total_tokens == (r.real_total_tokens if r.status == "done" else None)
        assert state[i].total_estimated_tokens == r.total_estimated_tokens
    closing = [r.line for r in frames.where("line LIKE 'd:%'").collect()]
    assert len(closing) == sum(r.status == "done" for r in rows.values())


def test_each_table_is_read_once(spark, sf_dir, tmp_path):
    for name in ("replies", "task_responses"):
        fixture(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    turns = fixture(spark, sf_dir, "turns")
    answers = spark.createDataFrame([], "request_id bigint, answer string")
    whole = L.run_log(turns, answers, read("replies"), read("task_responses"), LOCAL)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    relations = [x for x in plan.splitlines() if "Relation" in x]
    assert sum("error" in x and "position" not in x for x in relations) == 1
    assert sum("error" in x and "position" in x for x in relations) == 1
    assert len(relations) == 4  # conversations once for the latest marker and once for the turns it chooses


def test_no_runs(spark):
    none = L.run_log(
        spark.createDataFrame([], TURN), spark.createDataFrame([], "request_id bigint, answer string"),
        spark.createDataFrame([], REPLY), spark.createDataFrame([], RESPONSE), LOCAL,
    )
    assert none.count() == 0 and L.run_frames(none).count() == 0
