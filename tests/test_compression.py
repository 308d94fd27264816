import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.queries import documents, length_scorer
from promptloom.functions import fixed_values as V
from promptloom.functions import tokens as K
from promptloom.functions.columns import let, round_exact
from promptloom.operators.compression import compress, compress_detailed, compress_scored, compression_diff

SAMPLE = (
    '{"app_type": "I would really like a modern shop website for handmade crafts", '
    '"database": "I think PostgreSQL would be the best choice", '
    '"features": "I need user authentication, a product catalogue, and Stripe payments"}'
)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


def tokens_of(spark, *values):
    rows = texts(spark, *values).select("id", K.tokenize("text").alias("t")).orderBy("id").collect()
    return [r.t for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"app_type": "e-commerce site"}', ["{", '"', "app_type", '"', ":", '"', "e-commerce", "site", '"', "}"]),
        ('a "b c: d, {e} : f" g:h', ["a", '"', "b", "c:", "d,", "{e}", ":", "f", '"', "g", ":", "h"]),
        ('open "never closed: x', ["open", '"', "never", "closed:", "x"]),
        ('x "say \\"hi\\" now" y', ["x", '"', "say", '\\"hi\\"', "now", '"', "y"]),
        ('\\"a" b', ["\\", '"', "a", '"', "b"]),
        ('""', ['"', '"']),
        ("a\x85b c d\x1ce", ["a", "b", "c", "d", "e"]),
        ("", []),
        (" \t\n", []),
    ],
)
def test_tokenize(spark, text, expected):
    assert tokens_of(spark, text) == [expected]


def test_tokenize_null(spark):
    assert tokens_of(spark, None) == [None]


def test_long_strings_do_not_recurse(spark):
    many = '"' + 'a\\"b ' * 100_000
    commas = "a" + "," * 100_000 + "b"
    found = tokens_of(spark, many, commas)
    assert len(found[0]) == 100_001 and len(found[1]) == 100_002
    out = texts(spark, many, commas).transform(compress("text")).orderBy("id").collect()
    assert out[1].compressed.count(",") <= 1


def scores(spark, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    return {r.t: r.s for r in df.select("t", K.default_score(F.col("t")).alias("s")).collect()}


def test_score_rules(spark):
    expected = {
        "{": 1.0, ",": 1.0, '"': 0.9, "...": 0.25, "--": 0.25, "3.14": 1.0, "42,": 1.0, "1.2.": 1.0, "v1.2": 0.48,
        "app_type": 0.92, "iPhone": 0.92, "iPhone6": 0.55, "rest": 0.95, "REST": 0.95,
        "Go": 0.95, "go-kart": 0.95, "therapist": 0.62, "next.js": 0.95, "nextjs": 0.95, "app.tsx": 0.95, "app.txt": 0.55,
        "#fff": 0.35, "a#fff": 0.95, "a#ffff000": 0.62, "éa.py": 0.48, "é-a.py": 0.95, "The": 0.85, "USA": 0.35,
        "I": 0.15, "A": 0.15, "the": 0.15, "'the'": 0.15, "use": 0.35, "needs": 0.48, "feature": 0.55, "catalogue": 0.62,
        "Éa": 0.85, "ÉA": 0.35, "ǅa": 0.35, "(Stripe)": 0.95, "٣.٤": 1.0, "ruſt": 0.95, "rúst": 0.48,
    }
    got = scores(spark, list(expected))
    assert got == expected


def test_key_boost(spark):
    text = '"use": x the : "a" ] : that:'
    df = texts(spark, text).select(K.tagged_tokens("text").alias("t")).first().t
    assert list(zip(df.tokens, df.scores)) == [
        ('"', 0.9), ("use", 0.93), ('"', 0.9), (":", 1.0), ("x", 0.35), ("the", 0.93), (":", 1.0), ('"', 0.9),
        ("a", 0.15), ('"', 0.9), ("]", 1.0), (":", 1.0), ("that", 0.93), (":", 1.0),
    ]


def test_golden_example(spark):
    row = texts(spark, '{"app_type": "e-commerce site"}').transform(compress("text")).first()
    assert row.asDict() == {
        "id": 0, "compressed": '{"app_type":""}', "original_tokens": 10, "compressed_tokens": 8, "ratio": 0.2,
        "multiplier": 1.25,
    }


@pytest.mark.parametrize("text", ["", "   ", "\n\t", None])
def test_blank_is_unchanged(spark, text):
    row = texts(spark, text).transform(compress_detailed("text")).first()
    assert (row.compressed, row.original_tokens, row.compressed_tokens) == (text, 0, 0)
    assert (row.ratio, row.multiplier, row.tokens) == (0.0, 1.0, [])


@pytest.mark.parametrize(
    "kept, expected",
    [
        (["{", '"', "a", '"', ":", '"', "b", "c", '"', "}"], '{"a":"b c"}'),
        (["a", ",", ",", ",", "b", ","], "a,b"),
        (["{", ",", "a", ",", "}"], "{a}"),
        (["x", ",", "Deployment", ":", "y"], "x Deployment:y"),
        ([":", ":", "y", ",", ":", "z"], "y,z"),
        (["x", ":", ":", ",", "z"], "x:z"),
        (["a:", "b"], "a:b"),
        ([], ""),
    ],
)
def test_reconstruct(spark, kept, expected):
    df = spark.createDataFrame([(kept,)], "k array<string>")
    assert df.select(K.reconstruct(F.col("k"))).first()[0] == expected


def test_invariants(spark, sf_dir):
    """Kept count, skeleton, order and monotonicity in the ratio, on every prompt."""
    from checks.fixtures import fixture

    prompts = fixture(spark, sf_dir, "prompts")
    previous = None
    for ratio in (0.0, 0.3, 0.55, 0.9, 1.0, 1.7):
        rows = prompts.transform(compress_detailed("text", ratio)).orderBy("id").collect()
        kept_sets = []
        for r in rows:
            kept = [i for i, t in enumerate(r.tokens) if t.kept]
            assert len(kept) == r.compressed_tokens and len(r.tokens) == r.original_tokens
            if r.tokens:
                assert len(kept) >= max(1, int(len(r.tokens) * ratio)) or ratio > 1
            assert all(t.kept for t in r.tokens if t.text in (*V.STRUCTURAL, '"'))
            words = [r.tokens[i].score for i in kept if r.tokens[i].text not in (*V.STRUCTURAL, '"')]
            assert all(t.score < min(words, default=2.0) for t in r.tokens if not t.kept)
            kept_sets.append(set(kept))
        if ratio >= 1:
            assert all(r.original_tokens == r.compressed_tokens for r in rows)
        if previous:
            assert all(a <= b for a, b in zip(previous, kept_sets, strict=True))
        previous = kept_sets


def test_threshold_truncates_in_double(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x.cast("double")).alias("s"))
    # 100 * 0.29 is a little less than 29.
    assert df.select(K.keep_threshold(F.col("s"), 0.29)).first()[0] == 73.0


def test_custom_scorers(spark):
    row = texts(spark, "a bb ccc dddd").transform(compress("text", 0.25, length_scorer)).first()
    assert row.compressed == "dddd"

    @F.pandas_udf("array<double>")
    def reversed_rank(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [float(len(t) - i) for i in range(len(t))])

    rows = texts(spark, "a bb ccc dddd", "", None, '"x": y').transform(
        compress_scored(reversed_rank, ratio=0.5, detailed=True)
    )
    got = [(r.compressed, r.original_tokens, r.compressed_tokens) for r in rows.orderBy("id").collect()]
    assert got == [("a bb", 4, 2), ("", 0, 0), (None, 0, 0), ('"x"', 5, 4)]


def test_diff_is_every_token_in_order(spark):
    rows = texts(spark, SAMPLE).transform(compression_diff("text", 0.55)).orderBy("position").collect()
    assert [r.token for r in rows] == tokens_of(spark, SAMPLE)[0]
    assert [r.position for r in rows] == list(range(len(rows)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compression_is_narrow_and_in_the_jvm(spark, sf_dir):
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = plan_of(scan.transform(compress_detailed("text")))
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(docs.transform(compress("text")).filter("lang = 'en'").select("doc_id", "compressed"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_cost_grows_linearly_with_the_document(spark):
    """Arrays are bound once; an inlined array would make this quadratic."""
    long = " ".join(random.Random(1).choices(["alpha", "Beta", "x:", '"q"', "the"], k=200_000))
    start = time.time()
    row = texts(spark, long).transform(compress_detailed("text")).select("original_tokens").first()
    assert row.original_tokens > 200_000 and time.time() - start < 60


def test_round_exact(spark):
    rng = random.Random(2)
    values = [rng.randint(1, 900) / rng.randint(1, 900) for _ in range(3000)]
    values += [k / 8 for k in range(40)] + [2.195, 2.675, 1.005, 0.0, 1e-9] + [-rng.randint(1, 9999) / 2000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4, 6):
        for r in df.select("v", round_exact("v", digits).alias("r")).collect():
            assert r.r == round(r.v, digits), (r.v, digits)
    up = spark.createDataFrame([(0.03125,), (0.125,)], "v double")
    assert [r[0] for r in up.select(round_exact("v", 4, ties_up=True)).collect()] == [0.0313, 0.125]


def test_let_evaluates_once(spark):
    df = spark.range(3).select(let(F.rand(7), lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("s"))
    assert all(r.s.a == r.s.b for r in df.collect())


def test_spread_is_asked_for(spark, sf_dir):
    from promptloom.sources.tables import spread

    scan = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(scan, None) is scan
    assert spread(scan, 5, "doc_id").rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name", ["compression_diff", "compression_stats", "tag_tokens"])
def test_no_text_is_rebuilt_where_none_is_asked_for(spark, sf_dir, name):
    from checks import queries

    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
