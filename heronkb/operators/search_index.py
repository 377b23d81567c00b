"""A stored inverted index: segments of postings by term, tombstones, merges, and a search that skips blocks.

A segment holds, for each term and each block of about ``BLOCK`` documents, one row: how many documents hold the term,
and by count of occurrences (``levels``) which documents and their lengths. The levels' counts and least lengths bound what
any document of the block can score, so a search first reads those, settles the score that the k-th best reaches at least,
and then scores only the blocks that can reach it. Rows lie in folders by bucket of the term; a search opens the
buckets of its terms only.

Documents are added as new segments; removing one writes a tombstone, which hides it in the segments that were there before;
a merge rewrites all live rows as one segment. Each of these is a commit (``sources.commits``): writers may work at the same
time, and a search sees one version. Scores are those of ``retrieval.lexical``, whose tokens are used.

Document ids must not repeat among the live documents of an index; null ids are left out. A null text has no terms, but
counts as a document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_folder
from ..sources import commits
from .retrieval import B, K1, _runs, query_terms, top

BUCKETS, SPLITS, BLOCK, PROBES = 64, 8, 4096, 4
_POSTINGS = "term string, seq bigint, block bigint, n bigint, levels array<struct<tf: bigint, least_dl: bigint, docs: array<struct<doc_id: bigint, dl: bigint>>>>, bucket int"
_STATS = "n bigint, dl bigint"
_DOCUMENTS = "doc_id bigint, dl bigint, seq bigint"
_GONE = "doc_id bigint, upto bigint"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _write_segment(rows: DataFrame, to: str, seq: int) -> None:
    """rows: doc_id, dl, terms (array of term and tf). Postings are shuffled once; a term's are dealt to ``SPLITS`` tasks."""
    spark = rows.sparkSession
    rows.select("doc_id", "dl", F.lit(seq).cast("bigint").alias("seq")).write.parquet(f"{to}/documents")
    written = spark.read.schema(_DOCUMENTS).parquet(f"{to}/documents")
    stats = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    stats.coalesce(1).write.parquet(f"{to}/stats")
    blocks = max(1, -(-stats.first().n // BLOCK))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    found = rows.select("doc_id", "dl", block.alias("block"), F.explode("terms").alias("p")).select("doc_id", "dl", "block", "p.term", "p.tf")
    dealt = found.withColumn("bucket", bucket_of(F.col("term"))).withColumn("split", F.pmod("block", F.lit(SPLITS))).repartition("bucket", "split")
    level = dealt.groupBy("bucket", "split", "term", "block", "tf").agg(F.min("dl").alias("least_dl"), F.array_sort(F.collect_list(F.struct("doc_id", "dl"))).alias("docs"))
    packed = level.groupBy("bucket", "split", "term", "block").agg(F.sum(F.size("docs")).cast("bigint").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("tf").cast("bigint").alias("tf"), "least_dl", "docs"))).alias("levels"))
    out = packed.select("term", F.lit(seq).cast("bigint").alias("seq"), "block", "n", "levels", "bucket")
    out.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{to}/postings")


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.array_sort(tokens(F.coalesce(F.col(text), F.lit("")))).alias("all"))
    return rows.select("doc_id", F.size("all").cast("bigint").alias("dl"), _runs(F.col("all")).alias("terms"))


def _parts(at: commits.Snapshot, kind: str) -> list[str]:
    return [path for name, path in sorted(at.parts.items()) if name.startswith(f"{kind}-")]


def _name(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def _live(spark: SparkSession, at: commits.Snapshot) -> DataFrame:
    """doc_id, dl, seq of all documents that no tombstone hides."""
    segments = _parts(at, "segment")
    rows = spark.read.schema(_DOCUMENTS).parquet(*(f"{p}/documents" for p in segments)) if segments else spark.createDataFrame([], _DOCUMENTS)
    return _without_gone(rows, spark, at)


def _without_gone(rows: DataFrame, spark: SparkSession, at: commits.Snapshot) -> DataFrame:
    gone = _parts(at, "gone")
    if not gone:
        return rows
    dead = spark.read.schema(_GONE).parquet(*(f"{p}/ids" for p in gone)).groupBy("doc_id").agg(F.max("upto").alias("upto"))
    return rows.join(dead, "doc_id", "left").where(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).drop("upto")


def _bury(ids: DataFrame, folder: str, at: commits.Snapshot, to: str) -> None:
    """Tombstones for the live documents among ``ids``, and what they take from the statistics."""
    spark = ids.sparkSession
    found = _live(spark, at).join(ids.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi")
    found.select("doc_id", "dl", F.lit(at.version).cast("bigint").alias("upto")).write.parquet(f"{to}/found")
    kept = spark.read.schema("doc_id bigint, dl bigint, upto bigint").parquet(f"{to}/found")
    kept.select("doc_id", "upto").write.parquet(f"{to}/ids")
    kept.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("dl")).coalesce(1).write.parquet(f"{to}/stats")


def add(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text") -> commits.Snapshot:
    """Appends a segment of documents that aren't in the index."""
    return replace(docs, folder, doc_id=doc_id, text=text, known=False)


def replace(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", known: bool = True) -> commits.Snapshot:
    """Sets the texts of documents: those with the same id are hidden and the new ones added, in one commit."""
    spark = docs.sparkSession
    at, to, changes = commits.snapshot(spark, folder), commits.place(folder), {}
    rows = _counted(docs, doc_id, text)
    if known and at.version:
        _bury(rows, folder, at, f"{to}/gone")
        changes[_name("gone")] = f"{to}/gone"
    _write_segment(rows, f"{to}/segment", at.version + 1)
    return commits.commit(spark, folder, at, changes | {_name("segment"): f"{to}/segment"})


def remove(ids: DataFrame, folder: str) -> commits.Snapshot:
    """Hides the documents with these ids (column doc_id)."""
    spark = ids.sparkSession
    at, to = commits.snapshot(spark, folder), commits.place(folder)
    _bury(ids, folder, at, to)
    return commits.commit(spark, folder, at, {_name("gone"): to})


def merge(spark: SparkSession, folder: str) -> commits.Snapshot:
    """All live postings as one segment, without tombstones. A commit of others that came between stays on top."""
    at, to = commits.snapshot(spark, folder), commits.place(folder)
    old = [name for name in at.parts if name.startswith(("segment-", "gone-"))]
    entries = _without_gone(_entries(_postings(spark, at, None)), spark, at)
    terms = entries.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    _write_segment(_live(spark, at).select("doc_id", "dl").join(terms, "doc_id", "left"), to, at.version)
    return commits.commit(spark, folder, at, {_name("segment"): to} | dict.fromkeys(old))


def _postings(spark: SparkSession, at: commits.Snapshot, buckets: list[int] | None) -> DataFrame:
    segments = [spark.read.schema(_POSTINGS).parquet(f"{p}/postings") for p in _parts(at, "segment")]  # few, once merged
    rows = reduce(DataFrame.unionByName, segments) if segments else spark.createDataFrame([], _POSTINGS)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def _entries(blocks: DataFrame) -> DataFrame:
    keys = [c for c in blocks.columns if c not in ("levels", "n")]
    return blocks.select(*keys, F.explode("levels").alias("level")).select(*keys, F.col("level.tf").alias("tf"), F.explode("level.docs").alias("d")).select(*keys, "tf", "d.doc_id", "d.dl")


def _part(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, *, match_all: bool = True, at: commits.Snapshot | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of each query (query_id, query), as ``retrieval.lexical`` would rank them."""
    at = at or commits.snapshot(spark, folder)
    terms = query_terms(queries)
    # At most BUCKETS numbers; they prune folders when the plan is made.
    buckets = [r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]
    blocks = _postings(spark, at, buckets).join(terms.select("term").distinct(), "term", "left_semi")
    stats = [spark.read.schema(_STATS).parquet(f"{p}/stats") for p in (*_parts(at, "segment"), *_parts(at, "gone"))]
    whole = reduce(DataFrame.unionByName, stats, spark.createDataFrame([], _STATS)).agg(F.sum("n").alias("n_docs"), F.try_divide(F.sum("dl"), F.sum("n")).alias("avgdl"))
    df = (_without_gone(_entries(blocks), spark, at).groupBy("term").agg(F.count("*").alias("df"))) if _parts(at, "gone") else blocks.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").crossJoin(F.broadcast(whole)).withColumn("idf", idf)  # one row

    # What a block of documents can score at most, for each query.
    most = F.array_max(F.transform("levels", lambda x: _part(x["tf"], x["least_dl"], F.col("avgdl"))))
    bounds = blocks.join(asked, "term").groupBy("query_id", "n_terms", "seq", "block").agg(F.sum(F.col("idf") * most).alias("bound"), F.count("*").alias("found"))
    bounds = bounds.where("found = n_terms") if match_all else bounds

    def scored(chosen: DataFrame) -> DataFrame:
        keyed = blocks.join(asked, "term").join(chosen.select("query_id", "seq", "block"), ["query_id", "seq", "block"])
        entries = _without_gone(_entries(keyed.select("query_id", "n_terms", "idf", "avgdl", "term", "seq", "levels")), spark, at)
        out = entries.groupBy("query_id", "doc_id", "n_terms").agg(F.round(F.sum(F.col("idf") * _part(F.col("tf"), F.col("dl"), F.col("avgdl"))), 6).alias("score"), F.count("*").alias("found"))
        return (out.where("found = n_terms") if match_all else out).select("query_id", "doc_id", "score")

    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "seq", "block"))
    probed = bounds.withColumn("nth", first).where(F.col("nth") <= PROBES)
    reached = top(scored(probed), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # Scores are rounded to six places.
    able = bounds.join(reached, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least")))
    return top(scored(able), k)


def built(docs: DataFrame, name: str = "index") -> str:
    """A new index of the documents in the shared folder; returns its folder."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    add(docs, folder)
    return folder
