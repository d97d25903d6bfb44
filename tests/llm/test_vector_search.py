import numpy as np
import pytest
from sqlcheck import compare_with_sql

from strandloom.llm import queries
from strandloom.llm import vector_search as V


def _brute(rows, queries_, k):
    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in {i: v for i, v in ok if i in queries_}.items():
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("d", [1, 3, 10, 64])
def test_against_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(V, "CANDIDATES", 70)
    monkeypatch.setattr(V, "QUERIES", 5)
    rng = np.random.default_rng(d)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, d).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(9)] + [(400, None), (401, []), (402, [None] * d), (403, [float("nan")] * d), (404, [float("inf")] * d), (None, rows[0][1]), (405, [0.5] * (d + 1)), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in V.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    want = _brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert got == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in V.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 128 * 64)]
    assert V.top_k(df.limit(0), df.limit(0)).collect() == []


def test_against_sql(spark, sf_dir):
    got, want = compare_with_sql(spark, sf_dir, queries.op5_vector_search, queries.oracle_sql()["op5_vector_search"])
    assert got == want


def test_queries_of_one_id(spark):
    """Two query rows of one id with unlike vectors are two queries."""
    vectors = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(6)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in V.top_k(vectors, queries, 2).collect())
    assert got == [(1, 0), (1, 5), (2, 1), (2, 4)]
