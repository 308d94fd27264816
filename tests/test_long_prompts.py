"""Prompts in slices give what they give as a whole."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from promptloom.operators import compression
from promptloom.operators import long_prompts as L

TEXTS = [
    None, "", "  \n ", "plain words only, no marks", '"a b" c "d', 'x "say \\" no" y: z', '" " " "', '"open \\" still \\\\" open? "closed" key : v',
    '{"app_type": "e-commerce site", "n": 3}', 'key\n\n\n\n\n\n\n\n\n\n: value "quoted key"\n\n\n\n\n\n\n\n : x', '\\" a \\" b "c', 'a"b c"d e"f',
    "word " * 50 + ': ' + '" ' * 7 + "end : of it", "nospaceatall" * 40 + ":" + "x" * 90, "ü é ß 😀 :   x y" * 5,
]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_slices_of_any_width_give_the_whole(spark, tmp_path, width):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    for ratio in (0.3, 0.5):
        assert rows(L.compress_long(df, "id", ratio=ratio, width=width, folder=str(tmp_path))) == rows(df.transform(compression.compress("text", ratio)))
    pieces = L.slices(df, "id", "text", width)
    back = pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "piece"))), lambda p: p["piece"]), "").alias("t"))
    assert {r.id: r.t for r in back.collect()} == {i: t for i, t in enumerate(TEXTS) if t}


def test_following_tokens_take_few_slices_apart(spark):
    """Only slices that start with a colon or a quote are cut into tokens to find what follows another slice."""
    pieces = [(1, 0, "plain words ", False), (1, 1, ' "', False), (1, 2, "  ", True), (1, 3, " : x", True), (1, 4, "\n:y z", False), (1, 5, '"" :', True)]
    located = spark.createDataFrame(pieces, "id bigint, slice int, piece string, inside boolean")
    following = L._following(located, "id")
    got = {r.slice: [t if t in (":", '"') else "-" for t in r.after[:2]] for r in following.collect()}
    assert got == {0: ['"', ":"], 1: [":", "-"], 3: [":", "-"], 4: ['"', '"'], 5: []}
    # the filter on what a slice starts with does not tokenize it once more
    plan = following._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract_all" in line for line in plan.splitlines() if "Filter" in line)


def test_all_prompts(spark, sf_dir, tmp_path):
    prompts = fixture(spark, sf_dir, "prompts")
    assert rows(L.compress_long(prompts, "id", width=100, folder=str(tmp_path))) == rows(prompts.transform(compression.compress("text")))


def test_one_long_prompt_is_split_over_tasks(spark, tmp_path):
    unit = 'The "user_name, first" wants : a React app, {"key": ["v", 3.14]} and \\" more. '
    df = spark.range(1).select("id", F.repeat(F.lit(unit), 60_000).alias("text"))
    # small partitions would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scored = L.scored_slices(df, "id", "text").select(F.spark_partition_id().alias("p"), F.size("tokens").alias("n")).groupBy("p").sum("n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(scored) > 4 and max(r[1] for r in scored) < 0.5 * sum(r[1] for r in scored)
    out = L.compress_long(df, "id", folder=str(tmp_path)).first()
    whole = df.transform(compression.compress("text")).first()
    assert out.asDict() == whole.asDict()
