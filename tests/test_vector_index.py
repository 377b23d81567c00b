"""Recall of the inverted file against exact search, and what it does with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronkb.operators import retrieval, vector_index


def truth(vectors, queries, k=10):
    out = {}
    for r in retrieval.nearest(vectors, queries, k).collect():
        out.setdefault(r.query_id, {})[r.vec_id] = r.score
    return out


def recall(found, exact):
    """Rows at least as near as the k-th count, since equal vectors stand for each other."""
    hits = total = 0
    for q, best in exact.items():
        least = min(best.values())
        hits += sum(r.score >= least for r in found if r.query_id == q)
        total += len(best)
    return hits / total


def queries_of(e):
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_recall_on_the_whole_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = vector_index.search(spark, vector_index.build(e), queries_of(e)).collect()
    assert recall(found, truth(e, queries_of(e))) >= 0.9
    assert all(r.rank <= 10 for r in found) and len(found) == 10 * queries_of(e).count()


def test_recall_on_clusters_with_a_hot_one(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 30))
    which = np.where(rng.random(6000) < 0.35, 0, rng.integers(0, 40, 6000))
    rows = [(i, (centres[c] + 0.3 * rng.normal(size=30)).astype(float).tolist()) for i, c in enumerate(which)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    folder = vector_index.build(e, lists=48, parts=14, sample=2000)  # 30 dimensions in 14 parts
    assert recall(vector_index.search(spark, folder, queries_of(e), probes=16).collect(), truth(e, queries_of(e))) >= 0.9
    # Every row is in the index, once.
    assert vector_index._codes(spark, folder).select("key").distinct().count() == 6000 == vector_index._codes(spark, folder).count()


def test_all_lists_and_all_rows_is_exact(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").limit(300)
    folder = vector_index.build(e, lists=16)
    exact = sorted(map(tuple, retrieval.nearest(e, queries_of(e), 7).collect()))
    assert sorted(map(tuple, vector_index.search(spark, folder, queries_of(e), 7, probes=16, keep=300).collect())) == exact


def test_rows_that_come_later_are_found(spark, small, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 2)
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    folder = vector_index.build(e.where("vec_id < 400"))
    vector_index.add(e.where("vec_id >= 400"), folder)
    asked = e.where("vec_id in (401, 417, 450, 3)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert {(r.query_id, r.vec_id) for r in vector_index.search(spark, folder, asked, 1).collect()} == {(i, i) for i in (401, 417, 450, 3)}


def test_only_probed_lists_are_opened(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    folder = vector_index.build(e)
    one = e.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = vector_index.search(spark, folder, one, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and plan.count("list#") and "isnotnull(list" not in plan.split("PartitionFilters: [")[1].split("]")[0].replace("isnotnull(list", "", 1)


def test_null_zero_and_few_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [0.0, 0.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0] * 3)], "query_id bigint, q array<float>")
    found = vector_index.search(spark, vector_index.build(e), asked, 2, probes=64).collect()
    assert [(r.query_id, r.vec_id, r.rank) for r in sorted(found)] == [(1, 1, 1), (1, 4, 2)]
    with pytest.raises(ValueError):
        vector_index.build(e.where("vec_id in (2, 3)"))
