import pytest
from pyspark.sql import functions as F

from promptloom.functions import text as T
from promptloom.functions.intent import answer_intent, strong_intent, weak_intent
from promptloom.operators import conversation as C
from promptloom.operators.inference import chat_requests
from promptloom.operators.intent import classify_intent, undecided_requests
from promptloom.plans.generate import generate_requests
from promptloom.sources.tables import display_rows, read_chat_requests, request_messages

SPAN = 4096


def turns(spark, *rows):
    return spark.createDataFrame(list(rows), "conv_id bigint, turn bigint, role string, text string")


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column("t")).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Got you! Here's what I'm locking in: a shop, with auth", "a shop, with auth"),
        ("To summarize what we said: **Python** CLI\n- rename_files\n- `fast`", "Python CLI rename files fast"),
        ("I've got it now: a poem.", "a poem"),
        ("A plain text: stays here", "A plain text: stays here"),
        ("first\nI'm sure: x", "first: x"),
        ("• a\n  - b\n#c >d", "a b c d"),
        ("Okay, great. Sure! ok", ""),
        ("a , , , b ; c", "a,, b; c"),
        ("a ,, b,,,c", "a,  b, c"),
        ("Im here. heres greatness Greatly", "here. greatness Greatly"),
        ("x" * 200 + " the plan is: y", "x" * 200 + " the plan is: y"),
        ("", ""),
    ],
)
def test_clean_requirements(spark, text, expected):
    assert one(spark, T.clean_requirements, text) == [expected]


def test_lead_in_only_near_the_start(spark):
    late = "word " * 39 + "the plan: late"
    assert one(spark, T.clean_requirements, late) == [("word " * 39 + "the plan: late").strip()]
    early = "word " * 30 + "the plan: rest"
    assert one(spark, T.clean_requirements, early) == ["rest"]


def test_display_text(spark):
    got = one(spark, T.display_text, " a REQUIREMENTS_COMPLETE b REQUIREMENTS_COMPLETE", "REQUIREMENTS_COMPLETE\n", "x", " ", "\ufeffb\x1c")
    assert got == ["a  b REQUIREMENTS_COMPLETE", None, "x", None, "b\x1c"]
    rows = turns(spark, (1, 0, "user", "hi"), (1, 1, "assistant", " REQUIREMENTS_COMPLETE "))
    assert [r.display for r in display_rows(rows).collect()] == ["hi"]


def test_deliverable(spark):
    cases = {
        "a?" + "\n" * 10 + "b": False,
        "?" + "x" * 299: False,
        "?" + "x" * 600: True,
        "a\nb\nc\nd\ne": True,
        "a\nb\nc\nd": False,
        "x" * 600: False,
        "x" * 601: True,
        "\n\n\n\n\na": False,
        None: False,
    }
    assert one(spark, T.looks_like_deliverable, *cases) == list(cases.values())


def test_chunks_are_code_points(spark):
    text = "a😀" * 17
    assert one(spark, T.chunks, text, "", "x" * 16) == [
        [text[i : i + 16] for i in range(0, len(text), 16)], [], ["x" * 16],
    ]


def test_word_count(spark):
    assert one(spark, T.word_count, " a b\x0bc\x85d ", "", "x") == [4, 0, 1]


def test_format_usd(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.01, 0.00123, 1234.56789, -0.5, 0.03125)], "v double")
    assert [r[0] for r in df.select(T.format_usd("v")).collect()] == [
        "$0", "$0.0100", "$0.001230", "$1234.5679", "$-0.500000", "$0.0313",
    ]


def test_templates(spark):
    assert one(spark, T.decompose_prompt, "x {y}")[0].endswith("subtasks:\n\nx {y}")
    both = spark.createDataFrame([("s{compressed}", "c")], "s string, c string")
    text = both.select(T.perform_prompt("s", "c")).first()[0]
    assert text.endswith("directly:\n\ns{compressed}\n\n(cost-optimised brief: c)")


def test_clean_history(spark):
    df = turns(
        spark,
        (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", " "), (1, 3, "assistant", "b"),
        (1, 4, "user", "c"), (1, 5, "assistant", "d"), (1, 6, "user", "\t\n"),
        (2, 0, "assistant", "only"), (2, 1, "system", "x"), (3, 0, "user", " "), (4, 0, "system", "s"),
        (2, SPAN * 3, "assistant", "far"),
    )
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in C.clean_history(df).collect())
    assert got == [
        (1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "c"),
        (2, 0, "user", "Hello"), (3, 0, "user", "Hello"), (4, 0, "user", "Hello"),
    ]


def test_extract_requirements(spark):
    df = turns(
        spark,
        (1, 0, "user", "u0"), (1, 1, "assistant", "The plan: old REQUIREMENTS_COMPLETE"),
        (1, 2, "assistant", "The plan: new REQUIREMENTS_COMPLETE REQUIREMENTS_COMPLETE"), (1, 3, "assistant", "later"),
        (2, 0, "user", "a"), (2, 1, "assistant", "x"), (2, 2, "user", " "), (2, 3, "user", "c"),
        (2, 4, "user", None), (3, 0, "assistant", "x"), (4, 0, "user", "REQUIREMENTS_COMPLETE"),
    )
    got = {r.conv_id: r.summary for r in C.extract_requirements(df).collect()}
    assert got == {1: "new", 2: "a |   | c | ", 3: "", 4: "REQUIREMENTS_COMPLETE"}


def test_phase_complete(spark):
    df = turns(
        spark,
        (1, 0, "user", "go ahead"), (1, 1, "assistant", "what?"), (1, 2, "user", "blue"),
        (2, 0, "user", "Just DO it"), (2, 1, "user", " "),
        (3, 0, "user", "PROCEED"), (4, 0, "assistant", "ok REQUIREMENTS_COMPLETE"),
        (5, 0, "assistant", "a\nb\nc\nd\ne"), (6, 0, "system", "go ahead"),
    )
    got = {r.conv_id: (r.wants_to_proceed, r.has_marker, r.is_deliverable, r.complete) for r in C.phase_complete(df).collect()}
    no = (False,) * 4
    assert got == {
        1: no, 2: no, 3: (True, False, False, True), 4: (False, True, False, True), 5: (False, False, True, True), 6: no,
    }
    assert {r.conv_id for r in C.wants_to_proceed(df).collect() if r.wants_to_proceed} == {3}


def test_chat_payload_rows(spark):
    df = turns(spark, (1, 0, None, "a"), (1, 1, "tool", None))
    assert sorted(tuple(r) for r in C.chat_payload_rows(df, "sys").collect()) == [
        (1, -1, "system", "sys"), (1, 0, "user", "a"), (1, 1, "tool", ""),
    ]
    assert C.chat_payload_rows(df).count() == 2


def test_intent_rules(spark):
    cases = {
        "": "build", " \t": "build", "Write a POEM": "perform", "a web app": "build", "a poem in a web app": None,
        "a capital": None,
    }
    assert one(spark, strong_intent, *cases) == list(cases.values())
    assert one(spark, weak_intent, "an overview and a draft", "an overview of therapist", "nothing", "brief draft code") == [
        "perform", "build", "build", "perform",
    ]
    assert one(spark, answer_intent, " perform.", "build or PERFORM", "Build", "hm", None) == [
        "perform", "perform", "build", None, None,
    ]


def test_classify_intent(spark):
    requests = spark.createDataFrame(
        [(1, "a poem"), (2, "poem library"), (3, "hm"), (4, "an overview"), (5, "hm")], "request_id bigint, text string"
    )
    answers = spark.createDataFrame([(1, "BUILD"), (2, "perform"), (3, "BUILD"), (5, "?")], "request_id bigint, answer string")
    got = {r.request_id: (r.intent, r.decided_by) for r in classify_intent(requests, answers).collect()}
    assert got == {
        1: ("perform", "strong"), 2: ("perform", "model"), 3: ("build", "model"), 4: ("perform", "weak"), 5: ("build", "weak"),
    }
    assert {r.request_id for r in undecided_requests(requests).collect()} == {2, 3, 4, 5}


def test_intent_join_does_not_shuffle_texts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "request_id")
    answers = turns.select("request_id", F.lit("BUILD").alias("answer"))
    plan = classify_intent(turns, answers)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange" in line]
    assert shuffled and all("text" not in line for line in shuffled)


def test_request_scan(spark, tmp_path):
    bodies = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"text":"a"},{"x":1},"b",3,true,null]}],"phase":"generate"}',
        '{"messages":[{"content":5},{"role":"user"}]}',
        '{"phase":"dance"}',
        "{}",
    ]
    (tmp_path / "r.json").write_text("\n".join(bodies) + "\n")
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id bigint, body string")
    got = sorted((tuple(r) for r in request_messages(df).collect()), key=str)
    assert got == sorted(
        [
            (0, "generate", "ok", 0, "user", "hi"), (0, "generate", "ok", 1, "assistant", "ab3TrueNone"),
            (1, "elicit", "ok", 0, None, "5"), (1, "elicit", "ok", 1, "user", ""),
            (2, "dance", "unknown_phase", None, None, None), (3, "elicit", "ok", None, None, None),
        ],
        key=str,
    )
    read = read_chat_requests(spark, str(tmp_path)).collect()
    assert sorted({r.seq for r in read}) == [0, 1, 2, 3] and len(read) == 6


# --- one conversation that holds most rows ----------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark):
    """One conversation of four spans next to many short ones."""
    n = 4 * SPAN
    role = "CASE WHEN turn % 3 = 1 THEN 'assistant' ELSE 'user' END AS role"
    long = spark.range(n).selectExpr("-1L AS conv_id", "id AS turn", role.replace("turn", "id"), "concat('t', id) AS text")
    short = spark.range(2000).selectExpr("id div 4 AS conv_id", "id % 4 AS turn", role.replace("turn", "id % 4"), "concat('s', id) AS text")
    return long.unionByName(short).repartition(8).cache()


def test_hot_conversation_is_one_summary(spark, hot):
    (whole,) = C.extract_requirements(hot).filter("conv_id = -1").collect()
    assert whole.summary == " | ".join(f"t{i}" for i in range(4 * SPAN) if i % 3 != 1)
    assert C.extract_requirements(hot).count() == 1 + 500


@pytest.mark.parametrize("first, step", [(4094, 1), (65_534, 1), (1_700_000_000_000_000, 1_000_003), (-3, 1)])
def test_order_numbers_do_not_cut_a_conversation(spark, first, step):
    df = turns(spark, *[(1, first + i * step, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5)])
    assert [r.summary for r in C.extract_requirements(df).collect()] == ["t0 | t2 | t4"]
    assert C.clean_history(df).count() == 5
    assert chat_requests(C.clean_history(df)).count() == 1
    answers = spark.createDataFrame([(1, "BUILD")], "request_id bigint, answer string")
    assert generate_requests(df, answers).count() == 1


def test_null_conversation_is_a_key_of_its_own(spark):
    df = turns(spark, (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (1, 0, "user", "x"))
    assert {r.conv_id: r.summary for r in C.extract_requirements(df).collect()} == {None: "a | c", 1: "x"}
    assert C.clean_history(df).count() == 4


def test_marker_in_a_far_span_decides_for_all_spans(spark, hot):
    marked = hot.withColumn(
        "text", F.when((F.col("conv_id") == -1) & (F.col("turn") == 3 * SPAN + 1), "The plan: x REQUIREMENTS_COMPLETE").otherwise(F.col("text"))
    )
    rows = C.extract_requirements(marked).filter("conv_id = -1").collect()
    assert [r.summary for r in rows] == ["x"]


def test_last_user_turn_in_an_early_span(spark, hot):
    rows = hot.withColumn("role", F.when((F.col("conv_id") == -1) & (F.col("turn") > SPAN), "assistant").otherwise(F.col("role")))
    kept = C.clean_history(rows).filter("conv_id = -1").agg(F.count("*"), F.max("turn")).first()
    last = max(i for i in range(SPAN + 1) if i % 3 != 1)
    assert tuple(kept) == (last + 1, last)


def test_key_values_are_joined_not_windowed(spark, hot):
    """A key's values come from an aggregation and reach its rows by a join that can be split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.extract_requirements(hot)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan
    assert "Window" not in plan
    assert "Window" not in C.clean_history(hot)._jdf.queryExecution().executedPlan().toString()


def test_requests_shuffle_texts_once(spark, hot):
    answers = spark.range(600).selectExpr("id AS request_id", "'BUILD' AS answer")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = generate_requests(hot, answers)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanged) <= 6 and "Window" not in plan
    rows = generate_requests(hot, answers).filter("request_id IN (-1, 7)").collect()
    assert len(rows) == 2 and {r.intent for r in rows} == {"build"}


def test_chat_requests(spark, hot):
    df = turns(spark, (1, 1, "assistant", "b"), (1, 0, "user", 'a"'))
    local = chat_requests(df, "local", "m", "sys").first().request
    assert local == (
        '{"model":"m","messages":[{"role":"system","content":"sys"},{"role":"user","content":"a\\""},'
        '{"role":"assistant","content":"b"}],"stream":true,"options":{"num_predict":512}}'
    )
    cloud = chat_requests(df, "bedrock", None, "sys").first().request
    assert cloud == (
        '{"anthropic_version":"bedrock-2023-05-31","max_tokens":512,"system":"sys","messages":'
        '[{"role":"user","content":"a\\""},{"role":"assistant","content":"b"}]}'
    )
    assert chat_requests(hot).filter("conv_id = -1").count() == 1
