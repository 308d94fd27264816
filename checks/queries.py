"""Every registered query: an operator over whole tables, flattened to comparable columns."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.fixtures import decomposition, fixture, fixture_stream
from promptloom.functions import text as T
from promptloom.functions import tokens as K
from promptloom.functions.columns import let
from promptloom.functions.intent import intent_question, strong_intent
from promptloom.functions.models import default_pricing, resolve_provider, short_model
from promptloom.functions.responses import cloud_fields, data_frame, finish_frame, text_frame
from promptloom.operators import answers, compression, conversation, inference, intent, ledger, logs, long_prompts, planning, run_state
from promptloom.operators import pricing as prices
from promptloom.plans import generate, pipeline
from promptloom.session import new_folder
from promptloom.sources.frames import read_frame_files, write_frame_files
from promptloom.sources.tables import display_rows, read_table, request_messages, spread, write_table
from promptloom.streaming import jobs, keyed

Query = Callable[[SparkSession, str], DataFrame]

LOCAL = default_pricing("local")
CLOUD = default_pricing("bedrock")
SYSTEM = "You scope requests."


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "prompts", spread_out=True)


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, name, spread_out=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(scan, 2 * spark.sparkContext.defaultParallelism, "doc_id")


# --- compression ------------------------------------------------------------------------------


def word_count(spark, sf_dir):
    return prompts(spark, sf_dir).select("id", T.word_count("text").alias("words"))


def tokenize(spark, sf_dir):
    tokens = let(
        K.tokenize("text"),
        lambda k: F.struct(F.size(k).alias("n"), F.array_join(k, " ").alias("tokens")),
    )
    return prompts(spark, sf_dir).select("id", tokens.alias("t")).select("id", "t.*")


def _centis(scores):
    return F.array_join(
        F.transform(scores, lambda s: F.round(s * 100).cast("int").cast("string")), " "
    )


def score_tokens(spark, sf_dir):
    scores = let(K.tokenize("text"), lambda k: K.score_tokens(k))
    return prompts(spark, sf_dir).select("id", _centis(scores).alias("scores"))


def key_boost(spark, sf_dir):
    scores = K.tagged_tokens("text")["scores"]
    return prompts(spark, sf_dir).select("id", _centis(scores).alias("scores"))


def length_scorer(token, index, total):
    """A custom scorer: longer and later tokens score higher."""
    return F.least(F.length(token), F.lit(10)) / 10 + index / total


def custom_scorer(spark, sf_dir):
    out = prompts(spark, sf_dir).transform(
        compression.compress("text", 0.3, length_scorer)
    )
    return out.select("id", "compressed", "original_tokens", "compressed_tokens")


def keep_threshold(spark, sf_dir):
    ratios = {"t29": 0.29, "t50": 0.5, "t100": 1.0}
    bound = let(
        K.tagged_tokens("text")["scores"],
        lambda s: F.struct(*[K.keep_threshold(s, r).alias(n) for n, r in ratios.items()]),
    )
    return prompts(spark, sf_dir).select("id", bound.alias("t")).select("id", "t.*")


def tag_tokens(spark, sf_dir):
    tokens = K.compress_struct("text", 0.3, wanted=("tokens",))["tokens"]
    return prompts(spark, sf_dir).select(
        "id",
        F.array_join(F.transform(tokens, lambda t: t["kept"].cast("int").cast("string")), "").alias("kept"),
    )


def reconstruct(spark, sf_dir):
    return prompts(spark, sf_dir).select(
        "id", let(K.tokenize("text"), K.reconstruct).alias("joined")
    )


def compression_stats(spark, sf_dir):
    return prompts(spark, sf_dir).transform(compression.compression_stats("text", 0.29))


def compress_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).transform(compression.compress("text"))


def compress_long(spark, sf_dir):
    """The same prompts, in slices of a few words that tasks share."""
    folder = os.path.dirname(_folder(spark, "long"))
    return long_prompts.compress_long(prompts(spark, sf_dir), "id", width=200, folder=folder)


def compress_detailed(spark, sf_dir):
    out = prompts(spark, sf_dir).transform(compression.compress_detailed("text", 0.55))
    scores = F.transform("tokens", lambda t: t["score"])
    dropped = F.transform(F.filter("tokens", lambda t: ~t["kept"]), lambda t: t["text"])
    return out.select(
        "id", "compressed", _centis(scores).alias("scores"), F.array_join(dropped, " ").alias("dropped")
    )


def compression_diff(spark, sf_dir):
    """All tokens of a document in one row, so that the result is quick to compare."""
    tokens = K.compress_struct("text", wanted=("tokens",))["tokens"]
    line = lambda t: F.concat_ws("|", t["kept"].cast("int"), F.round(t["score"] * 100).cast("int"), t["text"])
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(tokens, line), " ").alias("tokens"))


# --- conversations ----------------------------------------------------------------------------


def chat_scan(spark, sf_dir):
    return request_messages(log(spark, sf_dir, "bodies"))


def normalise_content(spark, sf_dir):
    rows = request_messages(log(spark, sf_dir, "bodies")).filter(F.col("turn").isNotNull())
    return rows.select("request_id", "turn", "text")


def clean_requirements(spark, sf_dir):
    return log(spark, sf_dir, "turns").select(
        "conv_id", "turn", T.clean_requirements("text").alias("cleaned")
    )


def display_text(spark, sf_dir):
    return display_rows(log(spark, sf_dir, "turns"))


def looks_deliverable(spark, sf_dir):
    return log(spark, sf_dir, "turns").select(
        "conv_id", "turn", T.looks_like_deliverable("text").alias("deliverable")
    )


def wants_to_proceed(spark, sf_dir):
    return conversation.wants_to_proceed(log(spark, sf_dir, "turns"))


def phase_complete(spark, sf_dir):
    return conversation.phase_complete(log(spark, sf_dir, "turns"))


def clean_history(spark, sf_dir):
    return conversation.clean_history(log(spark, sf_dir, "turns"))


def chat_payload_rows(spark, sf_dir):
    return conversation.chat_payload_rows(log(spark, sf_dir, "turns"), SYSTEM)


def extract_requirements(spark, sf_dir):
    return conversation.extract_requirements(log(spark, sf_dir, "turns"))


# --- intent -----------------------------------------------------------------------------------


def intent_strong(spark, sf_dir):
    return log(spark, sf_dir, "requests").select("request_id", strong_intent("text").alias("intent"))


def intent_model_join(spark, sf_dir):
    open_requests = intent.undecided_requests(log(spark, sf_dir, "requests"))
    asked = open_requests.select("request_id", F.length(intent_question("text")).alias("question_length"))
    answers = fixture(spark, sf_dir, "answers")
    return asked.join(answers, "request_id", "left").select(
        "request_id", "question_length", intent.answer_intent("answer").alias("intent")
    )


def classify_intent(spark, sf_dir):
    return intent.classify_intent(
        log(spark, sf_dir, "requests"), fixture(spark, sf_dir, "answers")
    )


def prompt_templates(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("short", F.concat(F.lit("d"), F.col("doc_id")))
    return rows.select(
        "doc_id",
        T.generation_prompt("text", "short").alias("generation"),
        T.perform_prompt("text", "short").alias("perform"),
        T.decompose_prompt("short").alias("decompose"),
    )


# --- planning and cost ------------------------------------------------------------------------


def model_labels(spark, sf_dir):
    return fixture(spark, sf_dir, "models").select(
        "event_id", short_model("model").alias("label"), resolve_provider("provider").alias("provider")
    )


def parse_plan(spark, sf_dir):
    return planning.parse_plan(fixture(spark, sf_dir, "plans"))


def route_subtasks(spark, sf_dir):
    routed = planning.route(fixture(spark, sf_dir, "tasks"), LOCAL)
    return planning.labelled(routed).select(
        "run_id", "id", "title", "estimated_tokens", "assigned_model", "model"
    )


def price_lookup(spark, sf_dir):
    paid_in, paid_out = CLOUD.usd_columns("model")
    local_in, _ = LOCAL.usd_columns("model")
    cloud_in, cloud_out = LOCAL.usd_columns("model", paid=False)
    return fixture(spark, sf_dir, "models").select(
        "event_id",
        LOCAL.weight("model").alias("weight"),
        paid_in.alias("paid_in"),
        paid_out.alias("paid_out"),
        local_in.alias("local_in"),
        cloud_in.alias("cloud_in"),
        cloud_out.alias("cloud_out"),
    )


def _tiers(spark, sf_dir):
    """Tiers of two providers from the given tables: bounds by the length of documents in a language."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    bounds = docs.groupBy("lang").agg(F.floor(F.max("n_chars") / 8).cast("bigint").alias("up_to"))
    own = bounds.select(F.lit("own").alias("provider"), F.concat(F.lit("m-"), "lang").alias("model"), "up_to")
    two = spark.createDataFrame([("local", LOCAL.heavy.model, None), ("local", LOCAL.light.model, 600)], "provider string, model string, up_to bigint")
    return own.unionByName(two)


def route_tiers(spark, sf_dir):
    tasks = fixture(spark, sf_dir, "tasks").select("run_id", "position", "estimated_tokens")
    provider = F.when(F.col("run_id") % 2 == 0, "local").otherwise(F.lit("own"))
    return prices.route_tiers(tasks.withColumn("provider", provider), _tiers(spark, sf_dir), "provider")


def _price_history(spark, sf_dir):
    """Today's prices, and earlier ones of every event type as a model."""
    events = read_table(spark, f"{sf_dir}/events.parquet")
    older = events.groupBy("event_type", F.col("ts").cast("date").alias("valid_from")).agg(F.count("*").cast("double").alias("n")).select(
        F.lit("bedrock").alias("provider"), F.col("event_type").alias("model"), "valid_from", F.lit(2.0).alias("weight"),
        F.col("n").alias("usd_per_1m_input"), (F.col("n") * 5).alias("usd_per_1m_output"),
    )
    return prices.price_table(spark, LOCAL, CLOUD).unionByName(older)


def price_as_of(spark, sf_dir):
    """The price of each event's model on the day after it, where the model has a history; else the default."""
    calls = fixture(spark, sf_dir, "models").join(read_table(spark, f"{sf_dir}/events.parquet").select("event_id", "ts"), "event_id")
    calls = calls.select("event_id", resolve_provider("provider").alias("provider"), "model", F.date_sub(F.col("ts").cast("date"), 1).alias("day"))
    found = prices.with_prices(calls, _price_history(spark, sf_dir), "day", model="model")
    return found.select("event_id", *[F.col(f"price.{f}").alias(f) for f in prices.PRICE_FIELDS])


def priced_ledger(spark, sf_dir):
    """The ledger of today's prices, read from the table."""
    calls = prices.priced_calls(_outcomes(spark, sf_dir, CLOUD), decomposition(spark, sf_dir), "bedrock", CLOUD.light.model)
    priced = prices.with_prices(calls, _price_history(spark, sf_dir), F.lit("2030-01-01").cast("date"))
    return prices.priced_ledger(priced)


def plan_savings(spark, sf_dir):
    return ledger.plan_savings(planning.route(fixture(spark, sf_dir, "tasks"), LOCAL), LOCAL)


def _outcomes(spark, sf_dir, pricing):
    routed = planning.route(fixture(spark, sf_dir, "tasks"), pricing)
    return planning.subtask_outcome(routed, fixture(spark, sf_dir, "responses"))


def subtask_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir, LOCAL).drop("prompt", "position")


def assemble_output(spark, sf_dir):
    return planning.assemble(_outcomes(spark, sf_dir, LOCAL))


def usage_ledger(spark, sf_dir):
    return ledger.usage_ledger(_tables(spark, sf_dir, CLOUD).totals, CLOUD)


def usage_per_subtask(spark, sf_dir):
    return ledger.usage_per_subtask(_outcomes(spark, sf_dir, CLOUD), CLOUD)


def usage_perform(spark, sf_dir):
    return ledger.usage_perform(decomposition(spark, sf_dir))


def _tables(spark, sf_dir, pricing):
    return generate.run_tables(
        fixture(spark, sf_dir, "tasks"),
        fixture(spark, sf_dir, "responses"),
        decomposition(spark, sf_dir),
        pricing,
    )


def savings_breakdown(spark, sf_dir):
    return ledger.savings_breakdown(_tables(spark, sf_dir, CLOUD).totals, CLOUD)


def usage_shares(spark, sf_dir):
    return ledger.usage_shares(usage_ledger(spark, sf_dir))


def savings_shares(spark, sf_dir):
    return ledger.savings_shares(savings_breakdown(spark, sf_dir))


def fmt_usd(spark, sf_dir):
    amount = F.when(F.col("event_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("value") / 4096)
    return fixture(spark, sf_dir, "models").select("event_id", T.format_usd(amount).alias("usd"))


def run_report(spark, sf_dir):
    return generate.run_report(_tables(spark, sf_dir, LOCAL))


def _event_fields(events, *keys, id_type="bigint"):
    """Events with the fields of their payloads as comparable columns."""
    planned = f"array<struct<id:{id_type},title:string,estimatedTokens:bigint,model:string,status:string>>"
    used = f"array<struct<id:{id_type},title:string,model:string,inputTokens:bigint,outputTokens:bigint>>"
    body = F.from_json(
        "payload",
        "struct<id:string,title:string,status:string,model:string,baselineModel:string,message:string,"
        "totalEstimatedTokens:bigint,realTotalTokens:bigint,savingsVsSingleCall:bigint,"
        "realInputTokens:bigint,realOutputTokens:bigint,realCostUnits:double,realTotalCostUsd:double,"
        "totalSavingUsd:double,savingsVsSingleCallPct:double,savingsPct:double,subtaskCount:bigint,"
        "compressedPrompt:string,original:string,mode:string,"
        f"subtasks:{planned},perSubtask:{used}>",
    )

    def listed(column, *fields):
        return F.array_join(
            F.transform(column, lambda t: F.concat_ws("|", *[t[f].cast("string") for f in fields])), ";"
        )

    return events.withColumn("b", body).select(
        *keys,
        "event",
        "b.id",
        "b.title",
        "b.status",
        F.coalesce("b.model", "b.baselineModel").alias("model"),
        "b.message",
        F.coalesce("b.totalEstimatedTokens", "b.realTotalTokens").alias("total_tokens"),
        F.col("b.savingsVsSingleCall").alias("saved_tokens"),
        F.col("b.realInputTokens").alias("input_tokens"),
        F.col("b.realOutputTokens").alias("output_tokens"),
        F.col("b.realCostUnits").alias("cost_units"),
        F.coalesce("b.realTotalCostUsd", "b.totalSavingUsd").alias("cost_usd"),
        F.coalesce("b.savingsVsSingleCallPct", "b.savingsPct").alias("share"),
        F.col("b.subtaskCount").alias("subtask_count"),
        F.coalesce(
            listed("b.subtasks", "id", "title", "estimatedTokens", "model", "status"),
            listed("b.perSubtask", "id", "title", "model", "inputTokens", "outputTokens"),
        ).alias("listed"),
        F.coalesce("b.compressedPrompt", "b.original", "b.mode").alias("text"),
    )


def run_events(spark, sf_dir):
    events = generate.run_events(_tables(spark, sf_dir, CLOUD))
    return _event_fields(events, "run_id", "stage", "position").drop("text")


def _run_log(spark, sf_dir, pricing):
    return pipeline.run_log(
        log(spark, sf_dir, "turns"),
        _answers(spark, sf_dir),
        fixture(spark, sf_dir, "replies"),
        fixture(spark, sf_dir, "task_responses"),
        pricing,
    )


def run_pipeline(spark, sf_dir):
    return pipeline.run_rows(_run_log(spark, sf_dir, CLOUD))


def run_pipeline_events(spark, sf_dir):
    return _event_fields(pipeline.event_rows(_run_log(spark, sf_dir, CLOUD)), "run_id", "seq", id_type="string")


def run_pipeline_text(spark, sf_dir):
    """What a reader of a run's frames puts together again."""
    return logs.run_text(pipeline.run_frames(_run_log(spark, sf_dir, LOCAL)))


def _answers(spark, sf_dir):
    turns = read_table(spark, f"{sf_dir}/conversations.parquet")
    answer = F.expr("CASE count(*) % 2 WHEN 0 THEN 'perform it' ELSE 'hm' END")
    return turns.groupBy(F.col("conv_id").alias("request_id")).agg(answer.alias("answer"))


def generate_requests(spark, sf_dir):
    return generate.generate_requests(log(spark, sf_dir, "turns"), _answers(spark, sf_dir))


def generate_events(spark, sf_dir):
    turns = log(spark, sf_dir, "turns")
    requests = generate.generate_requests(turns, _answers(spark, sf_dir), detailed=True)
    compressed = generate.request_events(requests)
    calls = turns.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count("*").alias("input_tokens"), (F.max("turn") * 7).alias("output_tokens")
    )
    answered = requests.filter(F.col("intent") == "perform").select(F.col("request_id").alias("run_id"))
    calls = calls.join(answered, "run_id", "left_semi")
    used = generate.perform_events(ledger.usage_perform(calls)).withColumnRenamed("run_id", "request_id")
    phases = generate.phase_events(conversation.phase_complete(turns)).withColumnRenamed("conv_id", "request_id")
    every = compressed.unionByName(used).unionByName(phases)
    body = F.from_json(
        "payload",
        "struct<originalTokens:int,compressedTokens:int,ratio:double,multiplier:double,compressedPrompt:string,"
        "original:string,tokens:array<struct<text:string,kept:boolean,score:double>>,mode:string,"
        "realTotalTokens:bigint,realTotalCostUsd:double,nextPhase:string>",
    )
    kept = F.array_join(
        F.transform("b.tokens", lambda t: F.concat(t["text"], F.when(t["kept"], "+").otherwise("-"))), " "
    )
    return every.select("request_id", "stage", "event", body.alias("b")).select(
        "request_id",
        "stage",
        "event",
        F.col("b.originalTokens").alias("original_tokens"),
        F.col("b.compressedTokens").alias("compressed_tokens"),
        "b.ratio",
        "b.multiplier",
        F.col("b.compressedPrompt").alias("compressed"),
        "b.original",
        kept.alias("tokens"),
        "b.mode",
        F.col("b.realTotalTokens").alias("total_tokens"),
        F.col("b.realTotalCostUsd").alias("cost_usd"),
        F.col("b.nextPhase").alias("next_phase"),
    )


# --- payloads and inference -------------------------------------------------------------------


def request_payloads(spark, sf_dir):
    prompts = log(spark, sf_dir, "requests").withColumnRenamed("text", "prompt")
    rows = prompts.withColumn(
        "provider", F.when(F.col("request_id") % 2 == 0, "bedrock").otherwise("local")
    ).withColumn("model", F.when(F.col("request_id") % 3 == 0, "m:1"))
    table = inference.request_table(rows, system=SYSTEM)
    single = inference.single_prompt_payload(
        "prompt", F.when(F.col("request_id") % 3 == 0, "x.Mistral-7b").otherwise("claude"), 4096
    )
    body = F.try_parse_json("request")

    def text(path):
        return F.try_variant_get(body, path, "string")

    def single_text(path):
        return F.try_variant_get(F.try_parse_json(single), path, "string")

    return table.select(
        "request_id",
        "provider",
        "model",
        text("$.model").alias("body_model"),
        text("$.messages[0].role").alias("first_role"),
        F.coalesce(text("$.messages[1].content"), text("$.messages[0].content")).alias("user_text"),
        text("$.system").alias("body_system"),
        F.coalesce(text("$.max_tokens"), text("$.options.num_predict")).cast("int").alias("max_tokens"),
        text("$.stream").alias("stream"),
        F.coalesce(single_text("$.prompt"), single_text("$.messages[0].content")).alias("single_text"),
        single_text("$.top_p").cast("double").alias("top_p"),
    )


def chat_requests(spark, sf_dir):
    history = conversation.clean_history(log(spark, sf_dir, "turns"))
    listed = inference.chat_requests(history, "local", "m:1", SYSTEM)
    body = (
        "struct<model:string,messages:array<struct<role:string,content:string>>,stream:boolean,"
        "options:struct<num_predict:int>>"
    )
    lines = F.transform("r.messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return listed.select("conv_id", F.from_json("request", body).alias("r")).select(
        "conv_id",
        "r.model",
        "r.stream",
        F.col("r.options.num_predict").alias("num_predict"),
        F.array_join(lines, "|").alias("messages"),
    )


def infer_table(spark, sf_dir):
    def echo(system: str, messages: str, model: str, max_tokens: int) -> tuple[str, int, int]:
        """A stand-in model: refuses to write poems, else answers with what it was asked."""
        if "Poem" in messages:
            raise ValueError("no poems")
        return f"{model}: {messages}", len(messages), max_tokens

    requests = log(spark, sf_dir, "requests").select(
        "request_id",
        F.lit("local").alias("provider"),
        F.lit("m").alias("model"),
        F.lit(SYSTEM).alias("system"),
        F.col("text").alias("messages"),
    )
    return inference.infer_table(requests, {"local": echo}, ["request_id"], 64, concurrency=4)


def infer_once(spark, sf_dir):
    """Half of the requests first, then all of them over what is stored."""
    def echo(system: str, messages: str, model: str, max_tokens: int) -> tuple[str, int, int]:
        if "Poem" in messages:
            raise ValueError("no poems")
        return f"{model}: {messages}", len(messages), max_tokens

    requests = log(spark, sf_dir, "requests").select(
        "request_id", F.lit("local").alias("provider"), F.lit("m").alias("model"), F.lit(SYSTEM).alias("system"), F.col("text").alias("messages")
    )
    store, serve = _folder(spark, "answers"), {"local": echo}
    answers.infer_once(requests.where("request_id % 2 = 0"), serve, ["request_id"], 64, store, concurrency=4, wait=0.0)
    return answers.infer_once(requests, serve, ["request_id"], 64, store, concurrency=4, wait=0.0)


def _fields(request, **paths):
    """Fields of request bodies by path, as text."""
    body = F.try_parse_json(request)
    return [F.try_variant_get(body, path, "string").alias(name) for name, path in paths.items()]


def intent_requests(spark, sf_dir):
    asked = inference.intent_requests(log(spark, sf_dir, "requests"), "bedrock", SYSTEM)
    return asked.select("request_id", "provider", "model", *_fields("request", max_tokens="$.max_tokens", system="$.system", text="$.messages[0].content"))


def decompose_requests(spark, sf_dir):
    asked = inference.decompose_requests(generate_requests(spark, sf_dir), LOCAL, SYSTEM)
    return asked.select(
        "request_id", "provider", "model", *_fields("request", max_tokens="$.options.num_predict", system="$.messages[0].content", text="$.messages[1].content")
    )


def subtask_requests(spark, sf_dir):
    routed = planning.route(fixture(spark, sf_dir, "tasks"), CLOUD)
    asked = inference.subtask_requests(routed, "bedrock")
    return asked.select("run_id", "position", "provider", "model", *_fields("request", max_tokens="$.max_tokens", text="$.messages[0].content"))


def single_prompt_requests(spark, sf_dir):
    model = F.when(F.col("request_id") % 3 == 0, "x.Mistral-7b").otherwise("claude")
    asked = inference.single_prompt_requests(generate_requests(spark, sf_dir), model)
    prompt, content = _fields("request", prompt="$.prompt", content="$.messages[0].content")
    return asked.select("request_id", "model", *_fields("request", max_tokens="$.max_tokens"), F.coalesce(prompt, content).alias("text"))


# --- tables -----------------------------------------------------------------------------------


def table_io(spark, sf_dir):
    """Documents written and read again in each format."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    parts = []
    for kind in ("parquet", "json", "text"):
        path = _folder(spark, f"table-{kind}")
        as_text = docs.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value"))
        write_table(as_text if kind == "text" else docs, path, kind)
        back = read_table(spark, path, kind, "doc_id bigint, lang string, text string")
        if kind == "text":
            back = back.select(F.from_json("value", "doc_id bigint, lang string, text string").alias("r")).select("r.*")
        parts.append(back.select(F.lit(kind).alias("kind"), "doc_id", "lang", "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def frame_files(spark, sf_dir):
    """Frames written to few files and read back."""
    path = _folder(spark, "frames")
    write_frame_files(fixture(spark, sf_dir, "frames"), path, files=8)
    lines = read_frame_files(spark, path).withColumn("run_id", F.col("run_id").cast("bigint"))
    return logs.decode_frames(lines)


# --- logs -------------------------------------------------------------------------------------


def local_usage(spark, sf_dir):
    return logs.local_usage(log(spark, sf_dir, "local_lines"), "line")


def local_stream_tokens(spark, sf_dir):
    return logs.local_stream_tokens(log(spark, sf_dir, "local_lines"))


def cloud_tokens(spark, sf_dir):
    fields = log(spark, sf_dir, "chunks").select("call_id", "seq", cloud_fields("chunk").alias("f"))
    return fields.select("call_id", "seq", "f.claude_token", "f.mistral_token")


def usage_extract(spark, sf_dir):
    return logs.chunk_usage(log(spark, sf_dir, "chunks"))


def call_fold(spark, sf_dir):
    return logs.call_fold(log(spark, sf_dir, "chunks"))


def frame_decode(spark, sf_dir):
    return logs.decode_frames(log(spark, sf_dir, "frames"))


def frame_text(spark, sf_dir):
    return logs.run_text(log(spark, sf_dir, "frames"))


def frame_encode(spark, sf_dir):
    rows = log(spark, sf_dir, "requests")
    payload = F.struct(F.lit("task_mode").alias("event"), F.col("text").alias("mode"))
    tokens = F.when(F.col("request_id") % 2 == 0, F.col("request_id"))
    lines = rows.select(
        "request_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seq"), text_frame("text").alias("line")),
                F.struct(F.lit(1).alias("seq"), data_frame(payload).alias("line")),
                F.struct(F.lit(2).alias("seq"), finish_frame("stop", tokens).alias("line")),
            )
        ).alias("f"),
    )
    decoded = logs.decode_frames(
        lines.select(F.col("request_id").alias("run_id"), F.col("f.seq").alias("seq"), F.col("f.line").alias("line"))
    )
    finish = lines.filter(F.col("f.seq") == 2).select(
        F.col("request_id").alias("run_id"),
        F.lit(2).alias("seq"),
        F.lit("finish").alias("kind"),
        F.lit(None).cast("string").alias("text"),
        F.substr("f.line", F.lit(3)).alias("payload"),
    )
    every = decoded.unionByName(finish)
    head = F.from_json("payload", "struct<event:string,mode:string,finishReason:string,usage:struct<completionTokens:bigint>>")
    return every.select("run_id", "seq", "kind", "text", head.alias("h")).select(
        "run_id",
        "seq",
        "kind",
        "text",
        "h.event",
        "h.mode",
        F.col("h.finishReason").alias("reason"),
        F.col("h.usage.completionTokens").alias("completion_tokens"),
    )


def chunk16(spark, sf_dir):
    return logs.split_chunks(documents(spark, sf_dir))


def _latest(spark, sf_dir):
    return run_state.latest_events(run_state.data_events(log(spark, sf_dir, "frames")))


def run_state_report(spark, sf_dir):
    return run_state.run_report(_latest(spark, sf_dir))


def run_state_diff(spark, sf_dir):
    return run_state.run_diff(_latest(spark, sf_dir))


def run_state_usage(spark, sf_dir):
    return run_state.run_usage(_latest(spark, sf_dir))


def call_finish(spark, sf_dir):
    lines = logs.finish_lines(logs.call_fold(log(spark, sf_dir, "chunks")))
    head = F.from_json(F.substr("line", F.lit(3)), "struct<finishReason:string,usage:struct<completionTokens:bigint>>")
    return lines.select("call_id", head.alias("h")).select(
        "call_id", F.col("h.finishReason").alias("reason"), F.col("h.usage.completionTokens").alias("completion_tokens")
    )


def run_state_subtasks(spark, sf_dir):
    return run_state.run_subtasks(_latest(spark, sf_dir))


# --- streams ----------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder; only one local process may go without that setting."""
    alone = spark.sparkContext.master.split("[")[0] == "local"
    return new_folder(spark, name, os.path.join(tempfile.gettempdir(), "promptloom") if alone else None)


def stream_compress(spark, sf_dir):
    stream = jobs.compress_stream(
        fixture_stream(spark, sf_dir, "prompts"), partitions=2 * spark.sparkContext.defaultParallelism
    )
    return jobs.drain(stream, _folder(spark, "compress"), [], "append")


def stream_call_usage(spark, sf_dir):
    stream = jobs.call_usage_stream(fixture_stream(spark, sf_dir, "chunks"))
    return jobs.drain(stream, _folder(spark, "usage"), ["call_id"])


def stream_call_text(spark, sf_dir):
    stream = jobs.call_tokens_stream(fixture_stream(spark, sf_dir, "chunks"))
    return logs.call_text(jobs.drain(stream, _folder(spark, "text"), [], "append"))


def stream_run_state(spark, sf_dir):
    stream = jobs.run_events_stream(fixture_stream(spark, sf_dir, "frames"))
    keys = ["run_id", "event", "subtask_id"]
    return run_state.run_report(jobs.drain(stream, _folder(spark, "events"), keys))


def stream_phase_complete(spark, sf_dir):
    stream = jobs.phase_complete_stream(fixture_stream(spark, sf_dir, "turns"))
    return jobs.drain(stream, _folder(spark, "phase"), ["conv_id"])


def _timed(stream: DataFrame, order: str) -> DataFrame:
    """The stream with an event time that follows a column."""
    return stream.withColumn("ts", F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col(order).cast("int")))


def stream_run_state_timed(spark, sf_dir):
    stream = _timed(fixture_stream(spark, sf_dir, "frames"), "seq")
    changes = keyed.run_state_stream(stream, "ts", "10 minutes", "1 minute")
    rows = jobs.drain(changes, _folder(spark, "timed"), [], "append", keyed=True)
    return run_state.run_report(keyed.latest_run_events(rows))


def stream_completion_timed(spark, sf_dir):
    changes = keyed.completion_stream(_timed(fixture_stream(spark, sf_dir, "turns"), "turn"), "ts", "10 minutes", "1 minute")
    return keyed.completion_rows(jobs.drain(changes, _folder(spark, "completion"), [], "append", keyed=True))


def _chunks(spark, sf_dir):
    """Frame lines of every run as text chunks that are cut inside the lines, numbered by run."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).cast("bigint") - 1
    cut = F.col("seq").cast("int") % 7
    pieces = F.array(F.substr("line", F.lit(1), cut), F.concat(F.substr("line", cut + 1), F.lit("\n")))
    numbered = fixture(spark, sf_dir, "frames").withColumn("nth", nth)
    return numbered.select("run_id", "nth", F.posexplode(pieces).alias("piece", "data")).select(
        "run_id", (F.col("nth") * 2 + F.col("piece")).alias("part"), "data"
    )


def frame_lines(spark, sf_dir):
    return logs.decode_frames(keyed.lines_of_chunks(_chunks(spark, sf_dir)))


def stream_frame_lines(spark, sf_dir):
    """Chunks that arrive in several files, dealt out of order."""
    path = _folder(spark, "chunks")
    _chunks(spark, sf_dir).withColumn("data", F.encode("data", "utf-8")).repartition(3, F.hash("part")).write.parquet(path)
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    lines = keyed.line_stream(_timed(arriving, "part"), "ts", "1 day", "1 minute")
    return logs.decode_frames(jobs.drain(lines, _folder(spark, "lines"), [], "append", keyed=True))


REGISTERED: tuple[Query, ...] = (
    word_count, tokenize, score_tokens, key_boost, custom_scorer, keep_threshold, tag_tokens,
    reconstruct, compression_stats, compress_prompt, compress_long, compress_detailed, compression_diff,
    chat_scan, normalise_content, clean_requirements, display_text, looks_deliverable,
    wants_to_proceed, phase_complete, clean_history, chat_payload_rows, extract_requirements,
    intent_strong, intent_model_join, classify_intent, prompt_templates,
    model_labels, parse_plan, route_subtasks, price_lookup, plan_savings, subtask_outcome,
    assemble_output, usage_ledger, usage_per_subtask, usage_perform, savings_breakdown,
    usage_shares, savings_shares, fmt_usd, run_report, run_events, run_pipeline, run_pipeline_events, run_pipeline_text, generate_requests,
    generate_events,
    request_payloads, chat_requests, infer_table, local_usage, local_stream_tokens, cloud_tokens, usage_extract,
    call_fold, call_finish, frame_decode, frame_text, frame_encode, chunk16, run_state_report,
    run_state_subtasks, run_state_diff, run_state_usage, stream_compress, stream_call_usage, stream_call_text, stream_run_state,
    stream_phase_complete, stream_run_state_timed, stream_completion_timed, frame_lines, stream_frame_lines,
    route_tiers, price_as_of, priced_ledger, infer_once, intent_requests, decompose_requests, subtask_requests,
    single_prompt_requests, table_io, frame_files,
)

_KEYS = {"model_labels": "short_model", "run_state_report": "run_state"}


def queries() -> dict[str, Query]:
    return {_KEYS.get(q.__name__, q.__name__): q for q in REGISTERED}
