"""Inputs derived from the given tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.sources.tables import read_table, spread

BS, NL, SQ = "chr(92)", "chr(10)", "chr(39)"

_JSON_TEXT = (
    f"replace(replace(replace(replace(text, {BS}, concat({BS}, {BS})), '\"', concat({BS}, '\"')), "
    f"{NL}, concat({BS}, 'n')), chr(9), concat({BS}, 't'))"
)

_CONV_TEXT = f"""CASE
  WHEN (conv_id + turn) % 11 = 0 THEN concat('  ', chr(9), {NL})
  WHEN conv_id % 8 = 0 AND role = 'assistant' AND turn % 4 = 1 THEN concat('Great, here', {SQ},
    's what I', {SQ}, 'm locking in: **', text, '**', {NL}, ' - user_name, , `code` ,; ok ', {NL},
    '# I', {SQ}, 'm sure: Okay, fine .', {NL}, 'REQUIREMENTS_COMPLETE', {NL})
  WHEN conv_id % 8 = 4 AND role = 'assistant' AND turn % 4 = 3 THEN concat('Got it, ', role,
    ' let me see : ', text, {NL}, '• a research library', {NL}, 'REQUIREMENTS_COMPLETE')
  WHEN conv_id % 8 = 6 AND role = 'assistant' THEN concat(text, {NL}, 'x?', {NL}, 'y')
  WHEN conv_id % 8 = 1 AND role = 'user' THEN concat(text, ' Just DO it')
  WHEN conv_id % 8 = 2 AND role = 'user' THEN concat(text, ' Write a Poem')
  WHEN conv_id % 8 = 3 AND role = 'user' THEN concat(text, ' build a REST API and a report on it')
  WHEN conv_id % 8 = 5 AND role = 'user' THEN concat(text, ' an overview, a draft and some code')
  WHEN conv_id % 8 = 7 AND role = 'user' THEN concat(text, ' go ahead with the mobile app')
  ELSE text END"""

_PROMPT_TEXT = f"""CASE conv_id % 3
  WHEN 0 THEN concat('{{"app_type": "', replace(text, '"', ''),
    '", "database": "I think PostgreSQL", "n": 3}}')
  WHEN 1 THEN concat('Frontend: React,, Backend : ', text, ' "say ', {BS}, '"hi', {BS}, '" to ',
    role, '" : [x_id, {{camelCase: 1.2.3}}], ,a#fff App.tsx "open ', {BS}, '"')
  ELSE concat('"features": "', text, ' : the api, (go-kart) ...') END"""

_PLAN = f"""CASE doc_id % 8
  WHEN 0 THEN concat('```json', {NL}, '[{{"id": 3, "title": "', source, '", "prompt": "p ', lang,
    '", "estimated_tokens": ', n_chars, '}}, {{"title": "b", "estimated_tokens": "70"}}]', {NL}, '```')
  WHEN 1 THEN concat('[{{"id": ', doc_id, '}}, {{}}, {{"prompt": "only ', source, '"}}]')
  WHEN 2 THEN text
  WHEN 3 THEN ' [] '
  WHEN 4 THEN '{{"id": 1}}'
  WHEN 5 THEN '[1, 2]'
  WHEN 6 THEN concat('[{{"id": 7, "estimated_tokens": ', n_chars, '.7}}]')
  ELSE concat('  ```', {NL}, '[{{"title": "last", "estimated_tokens": "x', lang, '"}}]', {NL}, '```  ')
  END"""

_CHUNK = """CASE event_type
  WHEN 'view' THEN concat('{"type": "content_block_delta", "delta": {"text": "v', event_id, ' "}}')
  WHEN 'click' THEN concat('{"type": "message_delta", "usage": {"output_tokens": ', event_id % 500, '}}')
  WHEN 'purchase' THEN concat('{"type": "message_stop", "amazon-bedrock-invocationMetrics": {',
    '"inputTokenCount": ', event_id % 700, ', "outputTokenCount": ', event_id % 300,
    '}, "usage": {"input_tokens": 9999}}')
  WHEN 'signup' THEN concat('{"outputs": [{"text": "s', event_id, ' "}], "usage": {"other": 1}}')
  ELSE concat('{"type": "content_block_delta", "delta": {"text": "', event_id, '"') END"""

_LOCAL_LINE = """CASE
  WHEN event_type = 'error' AND event_id % 2 = 0 THEN '  '
  WHEN event_type = 'error' THEN concat('{"message": {"content": "', event_id, '"')
  WHEN event_type = 'purchase' AND event_id % 10 = 9 THEN concat('{"message": {"content": "end"}, ',
    '"done": true, "prompt_eval_count": ', event_id % 400, ', "eval_count": ', event_id % 90, '}')
  WHEN event_type = 'click' THEN '{"message": {"content": ""}, "done": false, "eval_count": 5}'
  ELSE concat('{"message": {"role": "assistant", "content": "t', event_id, ' "}}') END"""

_FRAME_LINE = """CASE event_id % 16
  WHEN 0 THEN concat('0:"w', event_id, ' "')
  WHEN 1 THEN concat('0:"part ', event_type, chr(92), 'n"')
  WHEN 2 THEN concat('0:"cut', event_id)
  WHEN 3 THEN concat('2:[{"event":"compression_stats","originalTokens":', event_id % 900,
    ',"compressedTokens":', event_id % 400, ',"ratio":0.5,"compressedPrompt":"', event_type, '"}]')
  WHEN 4 THEN concat('2:[{"event":"router_plan","subtasks":[{"id":1,"title":"a","estimatedTokens":',
    event_id % 700, ',"model":"m1","status":"pending"},{"id":2,"title":"b","estimatedTokens":5,',
    '"model":"m2","status":"pending"}],"totalEstimatedTokens":', event_id % 700 + 5,
    ',"savingsVsSingleCall":3}]')
  WHEN 5 THEN concat('2:[{"event":"subtask_update","id":', event_id % 3 + 1,
    ',"title":"a","status":"running","model":"m1"}]')
  WHEN 6 THEN concat('2:[{"event":"subtask_update","id":', event_id % 3 + 1,
    ',"title":"a","status":"', CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END, '"}]')
  WHEN 7 THEN concat('2:[{"event":"task_mode","mode":"', CASE event_type WHEN 'view' THEN 'perform'
    WHEN 'click' THEN 'build' ELSE event_type END, '"}]')
  WHEN 8 THEN concat('2:[{"event":"router_status","stage":"s","message":"step ', event_id, '"}]')
  WHEN 9 THEN concat('2:[{"event":"real_usage","realInputTokens":', event_id % 77,
    ',"realOutputTokens":', event_id % 55, ',"realTotalTokens":', event_id % 77 + event_id % 55,
    ',"realCostUnits":2.5,"realTotalCostUsd":0.25,"perSubtask":[{"id":1,"title":"a","model":"m1",',
    '"inputTokens":', event_id % 77, ',"outputTokens":4,"costUsd":0.5},{"id":"b","title":"b","model":"m2",',
    '"inputTokens":1,"outputTokens":', event_id % 55, '}]}]')
  WHEN 10 THEN concat('2:[{"event":"savings_breakdown","provider":"local","baselineCostUsd":0.5,',
    '"actualCostUsd":0,"totalSavingUsd":0.5,"savingsPct":1.0,"compressionSavingUsd":0.1,',
    '"routingSavingUsd":0.4,"baselineModel":"', event_type, '"}]')
  WHEN 11 THEN '2:[{"event":"phase_complete","nextPhase":"generate"}]'
  WHEN 12 THEN '2:[{"event":"unheard_of","x":1},{"event":"task_mode","mode":"perform"}]'
  WHEN 13 THEN '2:[{"event":"router_status"'
  WHEN 14 THEN concat('d:{"finishReason":"stop","usage":{"completionTokens":', event_id, '}}')
  WHEN 15 THEN CASE event_type WHEN 'view' THEN concat('2:[{"event":"compression_diff","original":"o","multiplier":1.5,',
    '"tokens":[{"text":"a","kept":true,"score":0.5},{"text":"t', event_id, '","kept":false,"score":0.25}]}]')
    ELSE '0:"ok","more"' END END"""

_BODY = f"""CASE (conv_id + turn) % 5
  WHEN 0 THEN concat('{{"messages": [{{"role": "', role, '", "content": "', {_JSON_TEXT},
    '"}}], "phase": "generate"}}')
  WHEN 1 THEN concat('{{"messages": [{{"role": "user", "content": "hi"}}, {{"role": "', role,
    '", "content": [{{"type": "text", "text": "', {_JSON_TEXT}, '"}}, "and ", {{"type": "image"}}, "', role,
    '"]}}]}}')
  WHEN 2 THEN '{{"phase": "elicit"}}'
  WHEN 3 THEN concat('{{"messages": [], "phase": "p', turn, '"}}')
  ELSE concat('{{"messages": [{{"role": "', role, '"}}, {{"content": "', {_JSON_TEXT},
    '"}}], "phase": "elicit"}}') END"""

#: name -> [(table, select expressions)], the parts of a UNION ALL.
FIXTURES: dict[str, list[tuple[str, list[str]]]] = {
    "prompts": [
        ("documents", ["doc_id * 2 AS id", "text"]),
        ("conversations", ["(conv_id * 1000 + turn) * 2 + 1 AS id", f"{_PROMPT_TEXT} AS text"]),
    ],
    "turns": [("conversations", ["conv_id", "turn", "role", f"{_CONV_TEXT} AS text"])],
    "requests": [
        ("conversations", ["conv_id * 1000 + turn AS request_id", f"{_CONV_TEXT} AS text"])
    ],
    "answers": [
        (
            "conversations",
            [
                "conv_id * 1000 + turn AS request_id",
                "CASE (conv_id + turn) % 3 WHEN 0 THEN 'PERFORM' WHEN 1 THEN ' build.' ELSE 'unsure' END AS answer",
            ],
        )
    ],
    "bodies": [("conversations", ["conv_id * 1000 + turn AS request_id", f"{_BODY} AS body"])],
    "tasks": [
        (
            "documents",
            [
                "CAST(floor(doc_id / 5) AS BIGINT) AS run_id",
                "doc_id % 5 AS position",
                "doc_id % 5 + 1 AS id",
                "concat(source, ' ', lang) AS title",
                "text AS prompt",
                "CAST(floor(n_chars / 4) AS BIGINT) AS estimated_tokens",
            ],
        )
    ],
    "responses": [
        (
            "labels",
            [
                "CAST(floor(doc_id / 5) AS BIGINT) AS run_id",
                "doc_id % 5 AS position",
                "concat('code ', doc_id, ' q', quality) AS text",
                "CASE WHEN toxic = 1 THEN 'boom' END AS error",
                "(doc_id * 37) % 1009 AS input_tokens",
                "CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 71) % 997 END AS output_tokens",
            ],
        )
    ],
    "plans": [("documents", ["doc_id AS run_id", f"{_PLAN} AS raw", "text AS requirements"])],
    "replies": [
        (
            "documents",
            [
                "CASE WHEN doc_id % 19 = 5 THEN -doc_id ELSE doc_id END AS run_id",
                f"{_PLAN} AS text",
                "CASE WHEN doc_id % 17 = 3 THEN 'down' END AS error",
                "n_chars % 301 AS input_tokens",
                "CASE WHEN doc_id % 7 <> 0 THEN n_chars % 97 END AS output_tokens",
            ],
        )
    ],
    "task_responses": [
        (
            "documents",
            [
                "CASE WHEN doc_id % 13 = 7 THEN -1 ELSE CAST(floor(doc_id / 5) AS BIGINT) END AS run_id",
                "CASE WHEN doc_id % 13 = 7 THEN doc_id ELSE doc_id % 5 END AS position",
                "concat('code ', doc_id, ' ', lang) AS text",
                "CASE WHEN doc_id % 11 = 4 THEN 'boom' END AS error",
                "(doc_id * 37) % 1009 AS input_tokens",
                "CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 71) % 997 END AS output_tokens",
            ],
        )
    ],
    "chunks": [("events", ["user_id AS call_id", "event_id AS seq", f"{_CHUNK} AS chunk"])],
    "local_lines": [("events", ["user_id AS call_id", "event_id AS seq", f"{_LOCAL_LINE} AS line"])],
    "frames": [("events", ["user_id AS run_id", "event_id AS seq", f"{_FRAME_LINE} AS line"])],
    "models": [
        (
            "events",
            [
                "event_id",
                "CASE event_id % 6 WHEN 0 THEN 'llama3.2:3b' WHEN 1 THEN 'qwen2.5-coder:7b' "
                "WHEN 2 THEN concat('us.vendor.', event_type, '-v1:0') WHEN 3 THEN '' "
                "WHEN 4 THEN concat(event_type, '.small') ELSE event_type END AS model",
                "CASE event_id % 5 WHEN 0 THEN ' Bedrock ' WHEN 1 THEN 'bedrock' WHEN 2 THEN 'local' "
                "WHEN 3 THEN 'other' ELSE '' END AS provider",
                "value",
            ],
        )
    ],
}

#: One row per run for the decomposition call: an aggregate both engines read alike.
DECOMPOSITION = [
    "CAST(floor(doc_id / 5) AS BIGINT) AS run_id",
    "n_chars",
]
DECOMPOSITION_AGGREGATES = [
    "max(n_chars) % 301 AS input_tokens",
    "min(n_chars) % 97 AS output_tokens",
    "CAST(floor(sum(n_chars) / 6) AS BIGINT) AS uncompressed_tokens",
]


def fixture_sql(name: str) -> str:
    """The fixture as a query over the registered tables."""
    return " UNION ALL ".join(
        f"SELECT {', '.join(exprs)} FROM {table}" for table, exprs in FIXTURES[name]
    )


def fixture(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = False) -> DataFrame:
    """The fixture as a DataFrame over the parquet tables."""
    parts = []
    for table, exprs in FIXTURES[name]:
        scan = read_table(spark, f"{sf_dir}/{table}.parquet")
        used = [c for c in scan.columns if any(c in e for e in exprs)]
        if spread_out:  # the given tables are one file each
            scan = spread(scan.select(*used), 2 * spark.sparkContext.defaultParallelism, *[c for c in used if c != "text"])
        parts.append(scan.selectExpr(*exprs))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def fixture_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a stream over its tables, each a parquet file or a folder of them."""
    parts = []
    for table, exprs in FIXTURES[name]:
        schema = read_table(spark, f"{sf_dir}/{table}.parquet").schema
        # a pattern, as a stream takes a file, other than a folder, only by one
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")
        parts.append(source.selectExpr(*exprs))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, f"{sf_dir}/documents.parquet").selectExpr(*DECOMPOSITION)
    return rows.groupBy("run_id").agg(*[F.expr(e) for e in DECOMPOSITION_AGGREGATES])


def decomposition_sql() -> str:
    return (
        f"SELECT run_id, {', '.join(DECOMPOSITION_AGGREGATES)} FROM "
        f"(SELECT {', '.join(DECOMPOSITION)} FROM documents) GROUP BY run_id"
    )
