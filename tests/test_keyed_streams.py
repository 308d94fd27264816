"""Streams with event time: the batch result whatever the order of arrival, and no state left behind."""

import random

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from promptloom.operators import conversation, logs, run_state
from promptloom.session import new_folder
from promptloom.streaming import jobs, keyed


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def arriving(spark, batches):
    """A stream over DataFrames that arrive one after the other, a micro-batch each."""
    path = new_folder(spark, "arriving")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, spark):
    folder = new_folder(spark, "s")
    query = jobs.run_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint", "append", keyed=True)
    query.awaitTermination()
    return jobs.latest_rows(spark, f"{folder}/rows", [], stream.schema), query


def held(query):
    """State rows in the order of the batches."""
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def timed(table, order, parts=4, seed=3):
    """The table in shuffled parts, with an event time that follows ``order``."""
    minute = F.make_interval(mins=F.col(order).cast("int"))
    spread = table.withColumn("ts", F.lit("2024-01-01").cast("timestamp") + minute)
    return [spread.where(F.pmod(F.hash(order, F.lit(seed)), F.lit(parts)) == i) for i in range(parts)]


def much_later(part):
    """One more row of a part, for another key, after which everything before is over."""
    return part.limit(1).withColumn(part.columns[0], F.lit(-1).cast("bigint")).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))


def test_run_state_equals_the_batch_for_any_order(spark, sf_dir):
    table = fixture(spark, sf_dir, "frames").where("run_id < 12")
    parts = timed(table, "seq")
    last = much_later(parts[0].where("line LIKE '2:[{%router_status%}]'"))
    out, query = drained(keyed.run_state_stream(arriving(spark, [*parts, last]), "ts", "1 hour", "1 minute"), spark)
    out = out.where("run_id >= 0")
    got = keyed.latest_run_events(out)
    batch = run_state.latest_events(run_state.data_events(table))
    assert rows(run_state.run_report(got)) == rows(run_state.run_report(batch))
    assert rows(run_state.run_subtasks(got)) == rows(run_state.run_subtasks(batch))
    # parts are shuffled over the whole time, so most rows come behind the watermark: counted, and used
    closed = keyed.closed_runs(out).agg(F.sum("n_rows"), F.sum("n_late")).first()
    events = run_state.data_events(table).count()
    assert closed[0] == events and 0 < closed[1] < events
    assert query.lastProgress["stateOperators"][0]["numRowsDroppedByWatermark"] == 0


def test_state_of_closed_runs_goes(spark):
    line = lambda n: f'2:[{{"event":"router_status","stage":"s","message":"step {n}"}}]'
    update = '2:[{"event":"subtask_update","id":"%s","title":"a","status":"done"}]'
    schema = "run_id bigint, seq bigint, line string, minute int"
    batches = [
        [(1, 1, line(1), 0), (1, 2, update % "x", 1), (1, 3, update % "y", 1), (2, 1, line(1), 2)],
        [(2, 2, line(2), 300)],
        [(2, 3, line(2), 305)],
        [(3, 1, line(9), 301), (1, 4, update % "x", 2), (1, 0, line(0), 0)],
        [(3, 2, line(9), 900)],
    ]
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("minute"))
    frames = [spark.createDataFrame(b, schema).withColumn("ts", at).drop("minute") for b in batches]
    out, query = drained(keyed.run_state_stream(arriving(spark, frames), "ts", "30 minutes", "10 minutes"), spark)
    closed = {r.run_id: (r.n_closed, r.n_rows, r.n_late) for r in keyed.closed_runs(out).collect()}
    # run 1 is over in the third part, comes back late, and is over again
    assert closed[1] == (2, 5, 2) and closed[2] == (1, 3, 0) and 3 not in closed
    assert max(held(query)) > held(query)[-1]
    report = {r.run_id: r.router_status for r in run_state.run_report(keyed.latest_run_events(out)).collect()}
    assert report == {1: "step 1", 2: "step 2", 3: "step 9"}
    # only run 3 has state at the end: its clock, its timer in two indexes, and one number
    alone, other = drained(keyed.run_state_stream(arriving(spark, frames[4:]), "ts", "30 minutes", "10 minutes"), spark)
    assert held(query)[-1] == held(other)[-1]


def test_completion_equals_the_batch_for_any_order(spark, sf_dir):
    table = fixture(spark, sf_dir, "turns")
    out, query = drained(keyed.completion_stream(arriving(spark, timed(table, "turn")), "ts", "2 minutes", "1 minute"), spark)
    assert rows(keyed.completion_rows(out)) == rows(conversation.phase_complete(table))
    assert query.lastProgress["stateOperators"][0]["numRowsDroppedByWatermark"] == 0


def test_state_of_idle_conversations_goes(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, ts timestamp"
    row = lambda c, n, role, text, ts: spark.sql(f"SELECT {c}L conv_id, {n}L turn, '{role}' role, '{text}' text, timestamp'{ts}' ts").to(
        spark.createDataFrame([], schema).schema
    )
    batches = [
        row(1, 0, "user", "hm", "2024-01-01 00:00:00").union(row(2, 0, "system", "s", "2024-01-01 00:00:00")),
        row(3, 0, "user", "just do it", "2024-01-02 00:00:00"),
        row(1, 1, "user", "go ahead", "2024-01-01 00:01:00"),
        row(1, 0, "user", "hm", "2024-01-01 00:00:00"),
        row(3, 1, "assistant", "REQUIREMENTS_COMPLETE", "2024-01-05 00:00:00"),
    ]
    out, query = drained(keyed.completion_stream(arriving(spark, batches), "ts", "1 hour", "1 hour"), spark)
    got = {r.conv_id: (r.wants_to_proceed, r.has_marker, r.complete) for r in keyed.completion_rows(out).collect()}
    assert got == {1: (True, False, True), 2: (False, False, False), 3: (True, True, True)}
    ended = {r.conv_id: (r.n, r.late) for r in out.where("n_rows IS NOT NULL").groupBy("conv_id").agg(F.sum("n_rows").alias("n"), F.sum("n_late").alias("late")).collect()}
    assert ended[1] == (3, 2) and ended[2] == (1, 0)
    assert held(query)[-1] < max(held(query))


def cut(text, seed):
    """Bytes of a text cut anywhere, characters included, as numbered chunks in any order, some twice."""
    rng = random.Random(seed)
    data, cuts = text.encode(), []
    while data:
        n = rng.choice([1, 2, 3, 7, 40, 200])
        cuts.append(data[:n])
        data = data[n:]
    parts = list(enumerate(cuts))
    parts += rng.sample(parts, min(3, len(parts)))
    rng.shuffle(parts)
    return parts


LOG = '0:"wörter 😀"\n\n2:[{"event":"task_mode","mode":"perform"}]\n0:"two"\r\n0:"cut\nd:{"finishReason":"stop"}'


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cutting_gives_the_lines(spark, seed):
    texts = {i: LOG * i + "\n" * (i % 2) for i in range(1, 6)}
    chunks = [(i, p, d, int(k)) for i, t in texts.items() for k, (p, d) in enumerate(cut(t, seed * 10 + i))]
    random.Random(seed).shuffle(chunks)
    schema = "run_id bigint, part bigint, data binary, minute int"
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("minute"))
    every = [spark.createDataFrame(chunks[i::3], schema).withColumn("ts", at).drop("minute") for i in range(3)]
    last = spark.sql("SELECT 0L run_id, 0L part, CAST('0:\"end\"' AS binary) data, timestamp'2024-02-01' ts").to(every[0].schema)
    out, query = drained(keyed.line_stream(arriving(spark, [*every, last]), "ts", "1 hour", "1 hour"), spark)
    whole = [(i, n, line) for i, t in texts.items() for n, line in enumerate(t.split("\n")) if line]
    assert sorted((r.run_id, r.seq, r.line) for r in out.where("run_id > 0").collect()) == sorted(whole)
    assert out.where("NOT whole").count() == 0
    table = spark.createDataFrame(whole, "run_id bigint, seq bigint, line string")
    assert rows(logs.decode_frames(out.where("run_id > 0"))) == rows(logs.decode_frames(table))


def test_missing_chunks_are_told(spark):
    schema = "run_id bigint, part bigint, data binary, ts timestamp"
    make = lambda listed: spark.createDataFrame([(1, p, d.encode(), None) for p, d in listed], "run_id bigint, part bigint, data binary, x int").select(
        "run_id", "part", "data", F.lit("2024-01-01").cast("timestamp").alias("ts")
    )
    other = lambda part, day: spark.sql(f"SELECT 2L run_id, {part}L part, CAST('' AS binary) data, timestamp'{day}' ts").to(
        spark.createDataFrame([], schema).schema
    )
    batches = [
        make([(0, "a\nb"), (3, "d\ne\nf"), (4, "g\n")]), other(0, "2024-02-01"), other(1, "2024-02-02"), make([(1, "c\n")]), other(2, "2024-03-01"),
    ]
    out, _ = drained(keyed.line_stream(arriving(spark, batches), "ts", "1 hour", "1 hour"), spark)
    first = sorted((r.seq, r.line, r.whole) for r in out.where("run_id = 1").collect() if r.line != "c")
    assert first == [(0, "a", True), (1, "b", False), (2, "d", False), (3, "e", True), (4, "fg", True)]
    # the late chunk waits for its turn, and is given out, cut, when its run is idle again
    assert [(r.line, r.whole) for r in out.where("line = 'c'").collect()] == [("c", False)]


def test_early_chunks_are_kept_in_blocks(spark):
    """Chunks that come before their turn are few values of state, and none is lost between blocks."""
    texts = {1: "".join(f"line {i}\n" for i in range(900)), 2: "one\ntwo\n" * 200}
    chunks = [(r, p, t[p * 3 : p * 3 + 3].encode(), 0) for r, t in texts.items() for p in range((len(t) + 2) // 3)]
    schema = "run_id bigint, part bigint, data binary, x int"
    make = lambda some: spark.createDataFrame(some, schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).drop("x")
    by_turn = [[c for c in chunks if c[1] % 3 == k] for k in (2, 1, 0)]
    late_first = [c for c in chunks if 300 < c[1] < 700]
    out, query = drained(keyed.line_stream(arriving(spark, [make(b) for b in (late_first, *by_turn)]), "ts", "1 hour", "1 hour"), spark)
    got = sorted((r.run_id, r.seq, r.line) for r in out.collect())
    assert got == [(r, n, line) for r, t in texts.items() for n, line in enumerate(t.split("\n")) if line]
    assert max(held(query)) < 40


def test_lines_of_a_table_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "c\n\n"), (1, 2, "d"), (2, 0, "")], "run_id bigint, part bigint, data string")
    assert rows(keyed.lines_of_chunks(chunks)) == [("a", 1, 0), ("bc", 1, 1), ("d", 1, 3)]
