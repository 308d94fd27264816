import json

import pytest
from pyspark.sql import functions as F

from promptloom.functions.responses import data_frame, finish_frame, text_frame
from promptloom.operators import logs, run_state
from promptloom.sources.tables import read_numbered_lines, write_frames



def lines(spark, *rows, key="run_id", value="line"):
    return spark.createDataFrame(list(rows), f"{key} bigint, seq bigint, {value} string")


def test_local_usage(spark):
    rows = lines(
        spark, (1, 0, '{"message":{"content":"a"},"prompt_eval_count":3,"eval_count":2}'), (1, 1, "{}"), (1, 2, "{bad"), (1, 3, None)
    )
    got = [(r.text, r.input_tokens, r.output_tokens) for r in logs.local_usage(rows, "line").orderBy("seq").collect()]
    assert got == [("a", 3, 2), ("", 0, 0), ("", 0, 0), ("", 0, 0)]


def test_local_stream(spark):
    rows = lines(
        spark,
        (1, 0, '{"message":{"content":"a"}}'), (1, 1, " "), (1, 2, '{"message":{"content":"cut"'), (1, 3, '{"message":{"content":""}}'),
        (1, 4, '{"message":{"content":"end"},"done":true}'), (1, 5, '{"message":{"content":"after"}}'),
        (2, 0, '{"message":{"content":"x"},"done":false}'),
        key="call_id",
    )
    got = sorted((r.call_id, r.seq, r.token) for r in logs.local_stream_tokens(rows).collect())
    assert got == [(1, 0, "a"), (1, 4, "end"), (2, 0, "x")]


def test_done_line_in_another_span(spark):
    many = spark.range(3 * 65536).selectExpr("1L AS call_id", "id AS seq", """concat('{"message":{"content":"t"},"done":', id >= 70000, '}') AS line""")
    assert logs.local_stream_tokens(many).agg(F.count("*"), F.max("seq")).first() == (70001, 70000)


CHUNKS = [
    '{"type":"message_start","message":{"usage":{"input_tokens":50}}}',
    '{"type":"content_block_delta","delta":{"text":"He"}}',
    '{"type":"content_block_delta","delta":{}}',
    '{"type":"content_block_delta","delta":{"text":"llo"}}',
    '{"type":"message_delta","usage":{"output_tokens":7}}',
    '{"type":"message_stop","amazon-bedrock-invocationMetrics":{"inputTokenCount":15,"outputTokenCount":3},"usage":{"input_tokens":99}}',
    '{"type":"x","amazon-bedrock-invocationMetrics":{},"usage":{"input_tokens":4}}',
    '{"type":"x","amazon-bedrock-invocationMetrics":{"latency":4}}',
    '{"usage":{"other":1}}',
    "{bad",
    '{"outputs":[{"text":"M"},{"text":"no"}]}',
    '{"outputs":[]}',
]


def test_usage_extract(spark):
    rows = lines(spark, *[(1, i, c) for i, c in enumerate(CHUNKS)], key="call_id", value="chunk")
    got = [(r.input_tokens, r.output_tokens) for r in logs.chunk_usage(rows).orderBy("seq").collect()]
    none = (None, None)
    assert got == [none, none, none, none, (0, 7), (15, 3), (4, 0), (0, 0), none, none, none, none]


@pytest.mark.parametrize("family, text", [("claude", "Hello"), ("mistral", "M")])
def test_call_fold(spark, family, text):
    rows = [(1, i, c) for i, c in enumerate(CHUNKS)] + [(2, 0, "{}")]
    got = sorted(tuple(r) for r in logs.call_fold(lines(spark, *rows, key="call_id", value="chunk"), family).collect())
    assert [r[:4] for r in got] == [(1, text, 15, 7), (2, "", 0, 0)] and got[1][4] == 0


def test_family_column(spark):
    rows = lines(spark, (1, 0, CHUNKS[1]), (2, 0, CHUNKS[10]), key="call_id", value="chunk")
    family = F.when(F.col("call_id") == 2, "mistral").otherwise("claude")
    assert sorted((r.call_id, r.token) for r in logs.chunk_tokens(rows, family).collect()) == [(1, "He"), (2, "M")]


@pytest.mark.parametrize("first, step", [(0, 1), (4_090, 1), (65_530, 1), (1_700_000_000_000_000, 1_000_003)])
def test_call_is_one_row_whatever_its_numbers(spark, first, step):
    n = 20_000
    rows = spark.range(n).selectExpr("1L AS call_id", f"{first}L + id * {step} AS seq", """concat('{"type":"content_block_delta","delta":{"text":"', id, ' "}}') AS chunk""")
    (call,) = logs.call_fold(rows.repartition(8)).collect()
    assert call.text == "".join(f"{i} " for i in range(n)) and call.n_tokens == n


def test_calls_without_key_are_kept(spark):
    rows = lines(spark, (None, 0, '{"message":{"content":"a"}}'), (None, 1, '{"message":{"content":"b"},"done":true}'),
                 (None, 2, '{"message":{"content":"c"}}'), (3, None, '{"message":{"content":"d"}}'), key="call_id", value="line")
    got = [(r.call_id, r.token) for r in logs.local_stream_tokens(rows).collect()]
    assert sorted(got, key=str) == [(3, "d"), (None, "a"), (None, "b")]


def test_log_is_parsed_once_for_the_fold(spark, sf_dir):
    from checks.queries import call_fold

    plan = call_fold(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_frames(spark):
    rows = lines(
        spark,
        (1, 0, '0:"a\\n"'), (1, 1, "0:5"), (1, 2, '0:"cut'), (1, 3, '0:"a","b"'), (1, 4, '2:[{"event":"x"},{"event":"y"}]'),
        (1, 5, '2:[{"event"'), (1, 6, "2:[]"), (1, 7, 'd:{"finishReason":"stop"}'), (1, 8, ""), (1, 9, "x:1"), (1, 10, "0:null"),
        (1, 11, '2:[{"a":1}] tail'), (1, 12, "0:"), (1, 13, "2:{}"),
    )
    got = [(r.seq, r.kind, r.text, r.payload) for r in logs.decode_frames(rows).orderBy("seq").collect()]
    assert got == [
        (0, "text", "a\n", None), (1, "text", "5", None), (4, "data", None, '{"event":"x"}'), (10, "text", "null", None),
    ]
    assert logs.run_text(rows).first().text == "a\n5null"


def test_encode(spark):
    df = spark.createDataFrame([('é"\n',)], "t string")
    text, data, stop, used = df.select(
        text_frame("t"), data_frame(F.struct(F.lit("e").alias("event"), F.col("t").alias("v"))), finish_frame(),
        finish_frame("length", F.lit(3)),
    ).first()
    assert text.startswith("0:") and json.loads(text[2:]) == 'é"\n'
    assert data.startswith("2:") and json.loads(data[2:]) == [{"event": "e", "v": 'é"\n'}]
    assert json.loads(stop[2:]) == {"finishReason": "stop"}
    assert json.loads(used[2:]) == {"finishReason": "length", "usage": {"completionTokens": 3}}


def test_frames_through_files(spark, tmp_path):
    frames = lines(spark, *[(run, i, f'0:"{run}.{i} "') for run in (1, 2) for i in range(50)])
    write_frames(frames, str(tmp_path / "out"))
    back = read_numbered_lines(spark, str(tmp_path / "out" / "run_id=2"))
    decoded = logs.run_text(back.withColumn("run_id", F.lit(2).cast("bigint")))
    assert decoded.first().text == "".join(f"2.{i} " for i in range(50))


def test_numbered_lines_over_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 7)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 5007
    assert all(r.line == f"{r.file.rsplit('/', 1)[1]} line {r.seq}" for r in rows)


def event(**fields):
    return "2:[" + json.dumps(fields) + "]"


def test_run_state(spark):
    plan = event(
        event="router_plan", totalEstimatedTokens=9, savingsVsSingleCall=1,
        subtasks=[{"id": 1, "title": "a", "estimatedTokens": 4, "model": "m", "status": "pending"},
                  {"id": 2, "title": "b", "estimatedTokens": 5, "model": "m", "status": "pending"}],
    )
    rows = lines(
        spark,
        (1, 0, event(event="subtask_update", id=1, status="running")),
        (1, 1, event(event="subtask_update", id=9, status="running")),
        (1, 2, plan),
        (1, 3, event(event="subtask_update", id=2, status="running")),
        (1, 4, event(event="subtask_update", id=2, status="done")),
        (1, 5, event(event="task_mode", mode="perform")),
        (1, 6, event(event="task_mode", mode="Perform")),
        (1, 7, event(event="router_status", message="first")),
        (1, 8, event(event="router_status", message="last")),
        (1, 9, event(event="compression_stats", originalTokens=5, compressedTokens=2, ratio=0.6, compressedPrompt="x")),
        (1, 10, event(event="real_usage", realInputTokens=1, realOutputTokens=2, realTotalTokens=3, realCostUnits=3)),
        (2, 0, event(event="phase_complete", nextPhase="generate")),
        (3, 0, event(event="router_done")),
    )
    latest = run_state.latest_events(run_state.data_events(rows))
    one, two = run_state.run_report(latest).orderBy("run_id").collect()
    assert (one.task_mode, one.router_status, one.multiplier, one.can_generate) == ("build", "last", 1.0, False)
    assert (one.total_estimated_tokens, one.plan_savings_pct, one.real_total_cost_usd) == (9, 0.0, 0.0)
    assert (one.original_tokens, one.compressed_prompt, one.real_cost_units, one.baseline_cost_usd) == (5, "x", 3.0, None)
    assert (two.run_id, two.can_generate, two.task_mode, two.router_status, two.multiplier) == (2, True, None, "", None)
    tasks = run_state.run_subtasks(latest).orderBy("subtask_id").collect()
    assert [(t.subtask_id, t.planned, t.status, t.reported_status) for t in tasks] == [
        ("1", True, "pending", "running"), ("2", True, "done", "done"), ("9", False, None, "running"),
    ]
