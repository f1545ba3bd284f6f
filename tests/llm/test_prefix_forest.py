import numpy as np
import pytest

from pyspark.sql import functions as F

from claimspark.llm import prefix_forest as M


def brute(ids, x, wanted, k=10):
    """(query, rank) -> (distance, id) over all rows but the query's own."""
    out = {}
    for i in np.flatnonzero(wanted):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = [j for j in np.lexsort((ids, d)) if j != i][:k]
        for rank, j in enumerate(others, 1):
            out[(int(ids[i]), rank)] = (d[j], int(ids[j]))
    return out


def recall(rows, exact):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(v in found.get(q, ()) for (q, _), (_, v) in exact.items()) / len(exact)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as part", "3 as block", "4 as x")


def test_query_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    exact = brute(ids, x, ids % 100 == 0)
    rows = M.op8_prefix_forest(spark, folder).collect()
    assert {(r.query_id, r["rank"]) for r in rows} == set(exact)
    assert recall(rows, exact) >= 0.9
    place = {int(i): n for n, i in enumerate(ids)}
    for r in rows:
        assert r.score == pytest.approx(np.sqrt(((x[place[r.query_id]] - x[place[r.vec_id]]) ** 2).sum()), rel=1e-14)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_over_many_blocks_and_small_share_of_clustered_data(spark, monkeypatch, clustered):
    monkeypatch.setattr(M, "BLOCK", 700)
    monkeypatch.setattr(M, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if clustered:
        x = (rng.normal(size=(150, 24))[rng.integers(0, 150, 3000)] * 5 + x * 0.2).astype(np.float32)
    ids = np.arange(3000)
    exact = brute(ids, x.astype(float), ids % 100 == 0)
    assert recall(M.nearest(frame(spark, ids, x), F.col("vec_id") % 100 == 0).collect(), exact) >= 0.9
    if clustered:
        hashing = M.Hashing(x[:2048].astype(float))
        looked = []
        monkeypatch.setattr(M, "distances", lambda x, q: looked.append(len(x)) or np.sqrt(((x - q) ** 2).sum(axis=1)))
        list(M.Forest(hashing, x.astype(float), ids, ids).search(x[:50].astype(float), ids[:50]))
        assert sum(looked) < 0.25 * 50 * 3000


def test_many_equal_vectors_and_ties(spark):
    x = np.array([[1.0, 2.0]] * 40 + [[1.0, 3.0], [0.0, 2.0], [2.0, 2.0]])
    ids = np.arange(1000, 1043)[::-1].copy()
    exact = brute(ids, x, np.ones(43, bool))
    rows = M.nearest(frame(spark, ids, x), F.lit(True)).collect()
    assert {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in rows} == exact


def test_edges(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    good = [(100, [1.0, 1.0]), (100, [1.0, 1.0]), (200, [2.0, 1.0])]
    docs = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in M.nearest(docs, F.col("vec_id") % 100 == 0).collect())
    assert rows == [(100, 1, 100, 0.0), (100, 1, 100, 0.0), (100, 2, 200, 1.0), (100, 2, 200, 1.0), (200, 1, 100, 1.0), (200, 2, 100, 1.0)]
    assert M.nearest(docs.limit(0), F.lit(True)).count() == 0
    assert M.nearest(docs.where("vec_id = 200"), F.lit(True)).count() == 0
