"""Streams give the batch result after everything has arrived, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture, fixture_stream
from promptloom.operators import conversation, logs, run_state
from promptloom.operators.compression import compress
from promptloom.session import new_folder, shared_folder
from promptloom.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def arriving(spark, sf_dir):
    """A stream over a fixture that arrives as several files, one micro-batch each."""

    def make(name, key):
        table = fixture(spark, sf_dir, name)
        path = new_folder(spark, "arriving")
        table.repartition(5, F.hash(key, F.lit(3))).write.parquet(path)
        return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_compress(spark, arriving):
    table, stream = arriving("prompts", "id")
    out = jobs.drain(jobs.compress_stream(stream), new_folder(spark, "s"), [], "append")
    assert rows(out) == rows(table.transform(compress("text")))


@pytest.mark.parametrize("name", ["prompts", "turns"])
def test_tables_in_folders(spark, tmp_path, name):
    """A table may be one file or a folder of files; the stream reads all of either."""
    turns = [(c, t, "user", f"turn {t} of {c}") for c in range(6) for t in range(3)]
    conversations = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    documents = spark.createDataFrame([(i, f"document {i}") for i in range(9)], "doc_id bigint, text string")
    conversations.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    documents.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = jobs.drain(fixture_stream(spark, str(tmp_path), name), new_folder(spark, "s"), [], "append")
    table = fixture(spark, str(tmp_path), name)
    assert rows(out) == rows(table) and out.count() == table.count() > 0


def test_call_fold(spark, arriving):
    table, stream = arriving("chunks", "seq")
    usage = jobs.drain(jobs.call_usage_stream(stream), new_folder(spark, "s"), ["call_id"])
    assert rows(usage) == rows(logs.call_usage(logs.chunk_usage(table)))
    tokens = jobs.drain(jobs.call_tokens_stream(stream), new_folder(spark, "s"), [], "append")
    assert rows(logs.call_text(tokens)) == rows(logs.call_text(logs.chunk_tokens(table)))


def test_closed_calls_leave_the_state(spark):
    usage = """concat('{"usage":{"input_tokens":', n, '}}') AS chunk"""
    path = new_folder(spark, "arriving")
    for minute, n in ((0, 5), (1, 9), (90, 4), (300, 1)):
        spark.sql(f"SELECT 1L AS call_id, {minute}L AS seq, timestamp'2024-01-01' + make_interval(0,0,0,0,0,{minute}) AS ts, {n} AS n").selectExpr(
            "call_id", "seq", "ts", usage
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    closed = jobs.closed_call_usage_stream(stream, "ts", "30 minutes", late="10 minutes")
    out = jobs.drain(closed, new_folder(spark, "s"), [], "append")
    assert sorted((str(r.started), r.input_tokens) for r in out.collect()) == [
        ("2024-01-01 00:00:00", 9), ("2024-01-01 01:30:00", 4),
    ]


def test_run_state(spark, arriving):
    table, stream = arriving("frames", "seq")
    latest = jobs.drain(jobs.run_events_stream(stream), new_folder(spark, "s"), ["run_id", "event", "subtask_id"])
    batch = run_state.latest_events(run_state.data_events(table))
    assert rows(run_state.run_report(latest)) == rows(run_state.run_report(batch))
    assert rows(run_state.run_subtasks(latest)) == rows(run_state.run_subtasks(batch))


def test_phase_complete(spark, arriving):
    table, stream = arriving("turns", "turn")
    out = jobs.drain(jobs.phase_complete_stream(stream), new_folder(spark, "s"), ["conv_id"])
    assert rows(out) == rows(conversation.phase_complete(table))


def test_resumes_after_a_stop(spark, sf_dir):
    """A second run over the same checkpoint reads only what is new."""
    table = fixture(spark, sf_dir, "chunks")
    path, folder = new_folder(spark, "arriving"), new_folder(spark, "s")
    table.filter("seq % 2 = 0").write.parquet(path)
    stream = jobs.call_usage_stream(spark.readStream.schema(table.schema).parquet(path))
    jobs.drain(stream, folder, ["call_id"])
    table.filter("seq % 2 = 1").write.mode("append").parquet(path)
    out = jobs.drain(stream, folder, ["call_id"])
    assert rows(out) == rows(logs.call_usage(logs.chunk_usage(table)))


def test_state_needs_a_shared_folder(spark):
    assert shared_folder(spark)
    folder = spark.conf.get("spark.checkpoint.dir")

    class Unset:
        class conf:
            @staticmethod
            def get(key, default):
                return default

    assert folder
    with pytest.raises(ValueError):
        shared_folder(Unset)
    assert shared_folder(Unset, "/x/") == "/x"
