"""The stored index gives what a search over the texts gives, after additions, changes, removals and merges."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from heronkb.operators import retrieval, search_index
from heronkb.plans import catalog, views
from heronkb.sources import commits


def plain(docs, queries, match_all, k=10):
    return {tuple(r) for r in retrieval.top(retrieval.lexical(docs, queries, match_all=match_all), k).select("query_id", "doc_id", "score", "rank").collect()}


def indexed(spark, folder, queries, match_all, k=10, at=None):
    return {tuple(r) for r in search_index.search(spark, folder, queries, k, match_all=match_all, at=at).select("query_id", "doc_id", "score", "rank").collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 20)
    monkeypatch.setattr(search_index, "PROBES", 2)


def test_index_follows_additions_changes_removals_and_merges(spark, small, tmp_path, small_blocks):
    folder = f"file://{tmp_path}/index"
    docs = catalog.docs(spark, small).select("doc_id", "text")
    queries = views.search_queries(spark)
    search_index.add(docs.where("doc_id < 120"), folder)
    before = search_index.add(docs.where("doc_id >= 120"), folder)
    assert indexed(spark, folder, queries, True) == plain(docs, queries, True)
    assert indexed(spark, folder, queries, False) == plain(docs, queries, False)
    old = indexed(spark, folder, queries, True)

    new = docs.where("doc_id between 50 and 90").withColumn("text", F.concat(F.lit("the of and "), "text"))
    search_index.replace(new, folder)
    search_index.remove(docs.where("doc_id between 10 and 30").unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(999_999).cast("bigint"))), folder)
    now = docs.where("doc_id not between 50 and 90 and doc_id not between 10 and 30").unionByName(new)
    want = {m: plain(now, queries, m) for m in (True, False)}
    assert {m: indexed(spark, folder, queries, m) for m in (True, False)} == want
    # A reader of an earlier version still sees that.
    assert indexed(spark, folder, queries, True, at=before) == old

    search_index.merge(spark, folder)
    assert {m: indexed(spark, folder, queries, m) for m in (True, False)} == want
    assert [n.split("-")[0] for n in commits.snapshot(spark, folder).parts] == ["segment"]
    commits.vacuum(spark, folder)
    assert {m: indexed(spark, folder, queries, m) for m in (True, False)} == want


def test_search_opens_only_the_buckets_of_its_terms(spark, small, tmp_path):
    folder = f"file://{tmp_path}/index"
    search_index.add(catalog.docs(spark, small), folder)
    queries = spark.createDataFrame([(1, "the of")], "query_id bigint, query string")
    df = search_index.search(spark, folder, queries)
    wanted = {r[0] for r in queries.select(F.explode(F.split("query", " ")).alias("t")).select(search_index.bucket_of(F.col("t"))).collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    for filters in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan):
        if "bucket" in filters:
            assert {int(n) for n in re.findall(r"(?<![#\d])\d+(?![#\dL])", filters.replace("bucket", ""))} & wanted == wanted or filters
    files = {re.search(r"bucket=(\d+)", f)[1] for f in search_index._postings(spark, commits.snapshot(spark, folder), sorted(wanted)).inputFiles() if f"bucket=" in f}
    assert search_index._postings(spark, commits.snapshot(spark, folder), sorted(wanted)).select("bucket").distinct().count() == len(wanted)
    assert "documents" not in " ".join(re.findall(r"Location: \S+ ?\[[^\]]*\]", plan)) and files
    assert "text" not in plan


def test_blocks_that_cannot_reach_the_best_are_skipped(spark, tmp_path, monkeypatch):
    """Blocks without the strong documents have a bound below the k-th score."""
    monkeypatch.setattr(search_index, "BLOCK", 50)
    monkeypatch.setattr(search_index, "PROBES", 3)
    rows = [(i, "rare " * 8 if i in (7, 300, 777) else "rare " + "filler " * (50 + i % 9)) for i in range(1000)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = f"file://{tmp_path}/index"
    search_index.add(docs, folder)
    queries = spark.createDataFrame([(1, "rare"), (2, "nowhere"), (3, "rare nowhere"), (4, "")], "query_id bigint, query string")
    assert indexed(spark, folder, queries, True, 3) == plain(docs, queries, True, 3)
    assert indexed(spark, folder, queries, False, 3) == plain(docs, queries, False, 3)


def test_one_document_of_a_hot_term_in_every_block(spark, tmp_path):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    folder = f"file://{tmp_path}/index"
    search_index.add(docs, folder)
    levels = search_index._postings(spark, commits.snapshot(spark, folder), None).select(F.max("n")).first()[0]
    assert levels < 2 * search_index.BLOCK
    assert indexed(spark, folder, spark.createDataFrame([(1, "hot")], "query_id bigint, query string"), True, 5) == plain(docs, spark.createDataFrame([(1, "hot")], "query_id bigint, query string"), True, 5)


def test_empty_index(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    queries = views.search_queries(spark)
    assert search_index.search(spark, folder, queries).count() == 0
    search_index.add(spark.createDataFrame([], "doc_id bigint, text string"), folder)
    assert search_index.search(spark, folder, queries).count() == 0


def test_commits_of_different_parts_pile_up_and_of_one_part_clash(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    rows = spark.range(40).selectExpr("id", "id % 4 AS k")
    base = commits.write(rows, folder, commits.Snapshot(), "k")
    commits.write(rows.where("k = 1").selectExpr("id + 100 AS id", "k"), folder, base, "k")
    with pytest.raises(commits.Conflict):
        commits.write(rows.where("k = 1"), folder, base, "k")
    last = commits.write(rows.where("k = 2").limit(1), folder, base, "k", emptied=("3",))
    now = commits.read(spark, folder, "id bigint, k bigint")
    assert {r.k: r.n for r in now.groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 1}
    assert now.where("k = 1").agg(F.min("id")).first()[0] == 101 and commits.read(spark, folder, "id bigint, k bigint", base).count() == 40
    # Parts that weren't touched keep their files.
    assert last.parts["0"] == base.parts["0"] and commits.read(spark, folder, "id bigint, k bigint", parts=["0"]).inputFiles() == commits.read(spark, folder, "id bigint, k bigint", base, ["0"]).inputFiles()
    dead = commits.vacuum(spark, folder)
    assert set(dead) == {base.parts[k] for k in "123"} and commits.read(spark, folder, "id bigint, k bigint").count() == 21
    with pytest.raises(ValueError):
        commits.snapshot(spark, folder, base.version)


def test_racing_writers_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    results = []

    def work(i):
        for j in range(5):
            at = commits.snapshot(spark, folder)
            results.append(commits.commit(spark, folder, at, {f"{i}-{j}": f"path {i} {j}"}).version)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(results) == list(range(1, 21)) and len(commits.snapshot(spark, folder).parts) == 20
