"""Nearest vectors by matrix products against the cosine of each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronkb.operators import products, retrieval


def by_pairs(vectors, queries, k, key="vec_id"):
    scored = vectors.select(key, "embedding").crossJoin(queries).select("query_id", key, F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return sorted(map(repr, retrieval.top(scored.where("score is not null"), k, key).select("query_id", key, "score", "rank").collect()))


def got(vectors, queries, k, key="vec_id"):
    return sorted(map(repr, retrieval.nearest(vectors, queries, k, key).select("query_id", key, "score", "rank").collect()))


def test_many_queries_make_no_row_for_each_pair(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = retrieval.nearest(e, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert got(e, asked, 10) == by_pairs(e, asked, 10)


@pytest.mark.parametrize("k", [1, 3, 30])
def test_copies_ties_and_odd_vectors(spark, monkeypatch, k):
    monkeypatch.setattr(products, "ROWS", 16)  # in this process; the workers have their own
    rng = np.random.default_rng(4)
    rows = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(300)] + [[1.0, 2.0, 0.0, -1.0]] * 90
    rows += [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan"), 0.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0], [1e200, -1e200, 1.0, 0.0], [1e-170, 0.0, 0.0, 0.0], [1e-120, 1e-120, 0.0, 0.0]]
    order = rng.permutation(len(rows))
    vectors = spark.createDataFrame([(int(i), rows[j]) for i, j in enumerate(order)], "vec_id bigint, embedding array<double>").repartition(3)
    asked = [[1.0, 2.0, 0.0, -1.0], [-1.0, 0.0, 1.0, 1.0], None, [0.0] * 4, [2.0, 1.0], [float("nan"), 1.0, 0.0, 0.0], [1e160, 1e160, 0.0, 0.0], [1.0, None, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, q array<double>")
    assert got(vectors, queries, k) == by_pairs(vectors, queries, k)


def test_keys_of_other_types(spark):
    rows = [(f"k{i % 7}", [float(i % 3), 1.0]) for i in range(40)] + [(None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "name string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 1.0])], "query_id bigint, q array<float>")
    assert got(vectors, queries, 5, "name") == by_pairs(vectors, queries, 5, "name")


def test_blocks_are_merged(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(products, "ROWS", 16)
    monkeypatch.setattr(products, "QUERIES", 8)
    rng = np.random.default_rng(5)
    data, asked = rng.integers(-2, 3, (500, 3)).astype(float), rng.integers(-2, 3, (20, 3)).astype(float)
    batches = [pa.record_batch({"key": pa.array(range(a, a + 50)), "embedding": pa.array(data[a : a + 50].tolist())}) for a in range(0, 500, 50)]
    found = {}
    for batch in products.best(iter(batches), products.sides(pa.array(asked.tolist())), pa.array(range(20)), 6):
        for r in batch.to_pylist():
            found.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    for q in range(20):
        with np.errstate(all="ignore"):
            score = data @ asked[q] / (np.linalg.norm(data, axis=1) * np.linalg.norm(asked[q]))
        want = sorted((-round(float(x), 6), i) for i, x in enumerate(score) if not np.isnan(x))[:6]
        assert sorted((-s, i) for i, s in found.get(q, [])) == want


def test_rows_are_ranked_when_many_wait(monkeypatch):
    import pyarrow as pa

    ranked, first_of = [], products.first_of
    monkeypatch.setattr(products, "ROWS", 16)
    monkeypatch.setattr(products, "ELEMENTS", 64, raising=False)
    monkeypatch.setattr(products, "first_of", lambda table, k: ranked.append(len(table)) or first_of(table, k))
    rng = np.random.default_rng(6)
    data, asked = rng.normal(size=(2000, 8)), rng.normal(size=(20, 8))
    batches = [pa.record_batch({"key": pa.array(range(a, a + 100)), "embedding": pa.array(data[a : a + 100].tolist())}) for a in range(0, 2000, 100)]
    found = {}
    for batch in products.best(iter(batches), products.sides(pa.array(asked.tolist())), pa.array(range(20)), 5):
        for r in batch.to_pylist():
            found.setdefault(r["query_id"], []).append(r["key"])
    score = asked @ data.T / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(data, axis=1))
    assert found == {q: np.argsort(-score[q])[:5].tolist() for q in range(20)}
    assert len(ranked) < 20 and max(ranked) < 3 * 20 * 16  # of 126 tiles of rows; what waits stays small


def test_single_precision_is_not_widened_before_the_tasks(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = e.limit(3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert "cast(embedding" not in retrieval.nearest(e, asked, 2)._jdf.queryExecution().analyzed().toString()
    wide = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert got(e, asked, 7) == got(wide, asked, 7) == by_pairs(e, asked, 7)


def test_halves_are_rounded_as_spark_does(spark):
    values = [0.1234565, -0.1234565, 0.0000005, -0.0000005, 2.5e-7, 0.9999995, 1.0, -1.0, 0.3000004999999, 0.1234575]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert products.scores_of(products.micros(np.array(values))).tolist() == want


@pytest.mark.parametrize("name", ["cosine_topk", "ann_dedup"])
def test_queries_over_vectors_make_no_row_for_each_pair(spark, small, name):
    from heronkb.plans import catalog

    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan
