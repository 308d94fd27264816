"""Graph search, whitening and hard negatives against brute force, with their edge cases."""

import numpy as np
import pytest

from checks.compare import connect
from promptloom.llm import hard_negatives, pruned_graph, queries, whitening

SF = "/root/testdata/sf0.01"
ROW = "vec_id bigint, embedding array<double>, label int, size string, shard int, rank string"
NAN, INF = float("nan"), float("inf")
#: Vectors that take no part anywhere: null, empty, null and non-finite components.
ODD = [None, [], [None, 1.0], [NAN, 1.0], [INF, 0.0]]


def table(spark, rows):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "s", 7, "r") for i, v, label in rows], ROW)


def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = sorted((r.vec_id, r.embedding, r.label) for r in rows.collect())
    return rows, np.array([r[0] for r in found]), np.array([r[1] for r in found]), np.array([r[2] for r in found])


# --- op11 ------------------------------------------------------------------------------------------------


def nearest(ids, x, queries_, k):
    out = {}
    for q in queries_:
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, away)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(away[i])) for i in order]
    return out


def found_by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_graph_search_recall_on_real_vectors(spark):
    _, ids, x, _ = embeddings(spark)
    truth = nearest(ids, x, [i for i in ids if i % 100 == 0], 10)
    got = found_by_query(queries.op11_graph_search(spark, SF))
    assert set(got) == set(truth)
    hits = 0
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        score = dict(nearest(ids, x, [q], len(ids))[q])
        np.testing.assert_allclose([s for _, _, s in rows], [score[i] for _, i, _ in rows], rtol=1e-12)
        hits += len({i for _, i, _ in rows} & {i for i, _ in truth[q]})
    assert hits >= 0.95 * 10 * len(truth)


def test_graph_of_one_large_shard_reaches_every_vector():
    rng = np.random.default_rng(5)
    # clusters far apart, lines, and vectors of which many are nearly the same
    x = np.concatenate([rng.normal(c * 50, 1, (700, 16)) for c in range(3)] + [np.outer(np.arange(400), np.ones(16)), rng.normal(0, 1e-4, (300, 16))])
    graph = pruned_graph.Graph(x)
    graph.build()
    assert graph._reached().all()
    found, _ = graph.search(graph.x[::40], 128)
    away = ((x[::40, None, :] - x[None]) ** 2).sum(axis=2)
    true = np.argsort(away, axis=1, kind="stable")[:, :10]
    hits = sum(len(set(f[:30].tolist()) & set(t.tolist())) for f, t in zip(found, true, strict=True))
    assert hits >= 0.9 * true.size


def test_graph_search_edge_cases(spark):
    same = [(i, [1.0, 2.0], 0) for i in range(300, 340)]
    rows = [(i, v, 0) for i, v in enumerate(ODD)] + same + [
        (100, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (500, [1e200, -1e200], 0), (501, [1e200, -1e200 * (1 + 1e-9)], 0),
        (600, [0.0, 0.0], 0), (700, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0], 0), (800, [-0.0, 5.0], 0), (801, [0.0, 5.0], 0),
    ]
    df = table(spark, rows)
    got = found_by_query(pruned_graph.search(pruned_graph.build(df), df.where("vec_id % 100 = 0")))
    # equal vectors in the order of their ids; one row of a repeated row; the query's own id never
    assert [(i, s) for _, i, s in got[100]] == [(300 + k, 0.0) for k in range(10)]
    assert [(i, s) for _, i, s in got[300]] == [(100, 0.0), *[(301 + k, 0.0) for k in range(9)]]
    assert got[500][0][1] == 501 and np.isclose(got[500][0][2], 1e191)
    assert got[800][0][1:] == (801, 0.0)
    # no candidate of its size; vectors of zeros take no part
    assert 700 not in got and 600 not in got
    few = table(spark, [(0, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 3.0], 0)])
    assert [(r, i) for r, i, _ in found_by_query(pruned_graph.search(pruned_graph.build(few), few.where("vec_id = 0")))[0]] == [(1, 1), (2, 2)]
    none = few.limit(0)
    assert pruned_graph.search(pruned_graph.build(none), none).count() == 0


# --- op12 ------------------------------------------------------------------------------------------------


def brute_whitened(x, k):
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    y = (n * distinct - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


@pytest.mark.parametrize("components", [16, 3])
def test_whitening_equals_a_full_decomposition(spark, components):
    rows, ids, v, _ = embeddings(spark)
    n, deviation, white, explained = brute_whitened(np.floor(64 * v).astype(np.int64) + 1_000_000, components)
    out = whitening.whiten(rows, components).toPandas().sort_values(["vec_id", "component"])
    assert set(out.n) == {n} and out.identity_error.max() < 1e-12
    got = out.whitened.to_numpy().reshape(-1, components)
    signs = np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got, white * signs, atol=1e-9)
    np.testing.assert_allclose(out.explained.to_numpy().reshape(-1, components), np.tile(explained, (len(ids), 1)), rtol=1e-10)
    assert out.deviation.to_numpy().reshape(-1, components)[:, 0].tolist() == deviation.tolist()


def test_subspace_iteration_on_hard_spectra():
    rng = np.random.default_rng(3)
    size = 120
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    spectra = {
        "one large": np.r_[1e6, np.linspace(1, 0.9, size - 1)], "flat": np.linspace(1.05, 1.0, size), "falling": 0.8 ** np.arange(size),
        "rank 5": np.r_[np.arange(5, 0, -1), np.zeros(size - 5)], "ties": np.r_[[3.0] * 4, [2.0] * 30, np.linspace(1, 0, size - 34)],
    }
    for name, values in spectra.items():
        matrix = (turn * values) @ turn.T
        got, vectors = whitening.leading_pairs(lambda q, m=matrix: m @ q, size, 8)
        wanted = np.sort(values)[::-1][:8]
        wanted = wanted[wanted > 1e-9 * wanted[0]]
        np.testing.assert_allclose(got, wanted, rtol=1e-9, err_msg=name)
        assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-9 * wanted[0], name
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


def test_whitening_edge_cases(spark):
    odd = [(i, v, 0) for i, v in enumerate(ODD)]
    rows = odd + [(10, [0.5, 0.0, 1.0], 0)] * 3 + [(11, [0.25, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (12, [1.0], 0), (12, [2.0], 0)]
    out = whitening.whiten(table(spark, rows)).collect()
    # three distinct vectors of the most frequent size span two dimensions; repeated rows come out as often as they stand
    assert {r.n for r in out} == {3} and sorted({r.component for r in out}) == [1, 2]
    assert sum(r.vec_id == 10 for r in out) == 6 and sum(r.vec_id is None for r in out) == 2
    assert all(r.identity_error < 1e-9 for r in out) and np.isclose(sum(r.explained for r in out if r.vec_id == 11), 1)
    huge = whitening.whiten(table(spark, [(1, [1e300, 0.0], 0), (2, [0.0, 1.0], 0), (3, [5.0, -1e300], 0)])).collect()
    assert len(huge) == 6 and all(r.deviation is None and np.isfinite(r.whitened) for r in huge)
    assert whitening.whiten(table(spark, odd)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 4)).count() == 0
    empty = whitening.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in whitening.WHITENED.split(", ")]


# --- op13 ------------------------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    kept = sorted({(i, label, tuple(int(np.floor(256 * c)) for c in v)) for i, v, label in rows if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for a, label, q in kept:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), i, other) for i, other, p in kept if i != a and len(p) == len(q)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            ok = sorted(s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(ok, 1)]
    return sorted(out)


def mined(df, *args, **kw):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hard_negatives.mine(df, *args, **kw).select(columns).collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    # many ties, negative scores, scores of zero, components of very different size, one label with a third of all rows
    rows = [(int(i), [float(c) for c in rng.integers(-2, 4, 11) / 2.0 * (300 if i % 7 == 0 else 1 + i % 2)], int(i) % 3 if i % 2 else 0) for i in range(260)]
    rows += rows[:20] + [(900 + i, v, 1) for i, v in enumerate(ODD)] + [(950, None, None), (951, rows[0][1], None), (None, rows[0][1], 1), (1000, [1.0], 0), (1001, [1.0], 0), (1002, [0.7], 1)]
    df = table(spark, rows)
    got = mined(df, "vec_id % 10 = 0")
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 50
    assert mined(df, "vec_id % 10 = 0", positives=2, negatives=50, low=0, high=100) == brute_negatives(rows, lambda i: i % 10 == 0, 2, 50, 0, 100)
    assert mined(df.limit(0), "vec_id % 10 = 0") == [] and mined(df, "vec_id < 0") == []


def test_hard_negatives_query_equals_sql_values(spark):
    sql = connect(SF).sql(queries.oracle_sql()["op13_hard_negatives"])
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = sorted(sql.select(*columns).fetchall())
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, SF).select(columns).collect()) == expected


def test_look_ups_give_inner_products():
    rng = np.random.default_rng(2)
    for size, most in ((1, 1), (8, 100), (13, 5), (64, 1 << 20), (9, 1 << 30)):
        a, c = rng.integers(-most, most + 1, (5, size)), rng.integers(-most, most + 1, (40, size))
        c[0], c[1] = most, -most
        packed = hard_negatives.planes(c)
        for wide in (0, 3):
            p = hard_negatives.widened(packed, len(packed) + wide)
            assert (hard_negatives.scores(hard_negatives.tables(a, len(p)), p) == c @ a.T).all()
    zeros = hard_negatives.planes(np.zeros((3, 4), dtype=np.int64))
    assert (hard_negatives.scores(hard_negatives.tables(np.ones((2, 4), dtype=np.int64), len(zeros)), zeros) == 0).all()


def test_saturated_components_do_not_overflow(spark):
    rows = [(i, [s * 1e300] * 8, i % 2) for i, s in enumerate((1, 1, -1, 1, 1))]
    got = mined(table(spark, rows), "vec_id = 0", low=-100, high=100)
    assert got and max(abs(r[4]) for r in got) < 2**63
