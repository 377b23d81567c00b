"""Lexical, vector and fused retrieval, batched over queries.

Queries are DataFrames (query_id, query) and are small next to the corpus; each corpus row is read once
for all of them, keeps only the query terms it holds, and the rest is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Hooks
from ..functions.language import ByWord
from ..functions.text import let, tokens
from . import products

K1, B = 1.2, 0.75
#: Query vectors that are sent to every task at once; more are taken in blocks.
BLOCK_ROWS = 20_000
#: Query terms that are sought inside each row; the terms of more queries are joined.
FEW_TERMS = 64


def blocks_of(queries: DataFrame, key: str = "query_id") -> list[DataFrame]:
    """The stated queries in parts of about ``BLOCK_ROWS``; only they are counted, never the corpus."""
    parts = -(-queries.count() // BLOCK_ROWS)
    return [queries] if parts <= 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf: counted inside each row, so nothing is shuffled."""
    found = tokens(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(found).alias("all")).select("doc_id", F.explode(_runs(F.col("all"))).alias("p"))
    return rows.select("doc_id", "p.term", F.col("p.tf").cast("bigint").alias("tf"))


def _runs(ordered: Column) -> Column:
    """(term, tf) from a sorted array: a run starts where its left neighbour differs, and ends where the next starts."""

    def of(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(xs, i - 1) != F.get(xs, i - 2)))
        ends = lambda at: F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(n + 1))
        runs = let(starts, lambda at: F.zip_with(at, ends(at), lambda a, b: F.struct(F.get(xs, a - 1).alias("term"), (b - a).alias("tf"))))
        return F.when(n > 0, runs)

    return let(ordered, of)


Analyse = Callable[[Column], Column]


def query_terms(queries: DataFrame, analyse: Analyse = tokens) -> DataFrame:
    """query_id, term, n_terms: distinct terms of each query; a query of stop words alone has none, and finds nothing."""
    found = F.array_distinct(analyse(F.col("query")))
    return queries.select("query_id", F.size(found).cast("bigint").alias("n_terms"), F.explode(found).alias("term"))


def corpus_stats(docs: DataFrame, text: str = "text", analyse: Analyse = tokens) -> DataFrame:
    """n_docs, avgdl: one row, worth keeping beside a corpus that is searched often."""
    return docs.select(F.size(analyse(F.coalesce(F.col(text), F.lit("")))).cast("bigint").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _matches(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, analyse: Analyse = tokens) -> DataFrame:
    """Postings of the query terms only, with document lengths.

    Up to ``FEW_TERMS`` distinct terms are sought and counted inside each row, so nothing else leaves it; more are joined.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), analyse(F.coalesce(F.col(text), F.lit(""))).alias("toks")).withColumn("dl", F.size("toks").cast("bigint"))
    wanted = terms.select("term").distinct()
    few = [r.term for r in wanted.limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        held = F.array_intersect("toks", F.array(*map(F.lit, few)).cast("array<string>"))
        found = rows.where(F.size(held) > 0).select("doc_id", "dl", "toks", F.explode(held).alias("term"))
        return found.select("doc_id", "term", "dl", (F.col("dl") - F.size(F.array_remove("toks", F.col("term")))).alias("tf"))
    return rows.select("doc_id", "dl", F.explode("toks").alias("term")).join(wanted, "term").groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def _matches_by_word(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, analyse: ByWord) -> tuple[DataFrame, DataFrame]:
    """``_matches`` where a term hangs on its word alone, and term, df, n_docs, sum_dl: figures of the documents that count under each term.

    Each distinct word of the corpus is analysed once; texts are only searched for the words whose term is asked for.
    Every document counts in n_docs and sum_dl of one row, that of its first term, or of none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), analyse.config().alias("config"))
    rows = rows.select("doc_id", "config", analyse.words(F.col("text"), F.col("config")).alias("words"))
    met = rows.select("config", F.explode(F.array_distinct("words")).alias("word")).distinct()
    met = met.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)  # words are few bytes and much work, so Spark would join their partitions
    asked = met.select("config", "word", analyse.term(F.col("word"), F.col("config")).alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    # One row for each language, with the forms of FEW_TERMS terms at most.
    forms = F.broadcast(asked.groupBy("config").agg(F.map_from_entries(F.collect_list(F.struct("word", "term"))).alias("forms")))
    term = lambda x: F.try_element_at("forms", x)
    dl, held = F.size("words").cast("bigint").alias("dl"), F.array_intersect("words", F.map_keys("forms"))
    marked = rows.join(forms, "config", "left").select(dl, F.posexplode_outer(F.array_distinct(F.transform(held, term))).alias("at", "term"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    figures = marked.groupBy("term").agg(F.count("*").alias("df"), F.count_if(first).alias("n_docs"), F.sum(F.when(first, F.col("dl"))).alias("sum_dl"))
    some = rows.join(forms, "config").select("doc_id", dl, "words", "forms", held.alias("held")).where(F.size("held") > 0)
    runs = _runs(F.array_sort(F.transform(F.filter("words", lambda x: F.array_contains("held", x)), term)))
    hits = some.select("doc_id", "dl", F.explode(runs).alias("p")).select("doc_id", "p.term", "dl", F.col("p.tf").cast("bigint").alias("tf"))
    return hits, figures


def lexical(docs: DataFrame, queries: DataFrame, *, match_all: bool = True, scorer: str = "bm25", stats: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", analyse: Analyse = tokens) -> DataFrame:
    """query_id, doc_id, score for each match: all terms of a query, or any.

    ``analyse`` makes terms of texts and queries alike (see ``functions.language.analyser``).

    ``stats`` (see ``corpus_stats``) saves the pass over the corpus that finds its size and mean length.

    Scores are Okapi BM25 (k1 1.2, b 0.75) over the whole corpus, or plain term frequency, rounded to
    six places so that ranks don't hang on the order of a sum.
    """
    return scores(docs, queries, match_all=match_all, stats=stats, doc_id=doc_id, text=text, analyse=analyse).select("query_id", "doc_id", F.col(scorer).alias("score"))


def scores(docs: DataFrame, queries: DataFrame, *, match_all: bool = True, stats: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", analyse: Analyse = tokens) -> DataFrame:
    """query_id, doc_id, bm25, tf: both scores of each match from one pass over the postings."""
    terms = query_terms(queries, analyse)
    if isinstance(analyse, ByWord) and len(terms.select("term").distinct().limit(FEW_TERMS + 1).collect()) <= FEW_TERMS:
        hits, figures = _matches_by_word(docs, terms, doc_id, text, analyse)
        whole = figures.agg(F.sum("n_docs").alias("n_docs"), (F.sum("sum_dl") / F.sum("n_docs")).alias("avgdl")) if stats is None else stats
        df = figures.where("term is not null").select("term", "df")
    else:
        hits, whole = _matches(docs, terms, doc_id, text, analyse), corpus_stats(docs, text, analyse) if stats is None else stats
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(terms, "term").join(df, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = joined.groupBy("query_id", "doc_id", "n_terms").agg(F.round(F.sum(part), 6).alias("bm25"), F.sum(F.col("tf").cast("double")).alias("tf"), F.count("*").alias("found"))
    return (out.where("found = n_terms") if match_all else out).select("query_id", "doc_id", "bm25", "tf")


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores rank by key."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Unit vector of white-space token counts, each token at the last byte of its SHA-256 (dim must be 256)."""
    if dim != 256:
        raise ValueError("the native form takes a bucket from one byte")
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != "")
    at = F.transform(toks, lambda x: F.conv(F.right(F.sha2(x, 256), F.lit(2)), 16, 10).cast("int"))
    runs = _runs(F.array_sort(at))
    norm = lambda rs: F.sqrt(F.aggregate(rs, F.lit(0.0), lambda acc, x: acc + x["tf"] * x["tf"]))
    counts = lambda rs: let(norm(rs), lambda n: F.map_from_entries(F.transform(rs, lambda x: F.struct(x["term"], x["tf"] / n))))
    dense = let(let(runs, counts), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    return F.when(F.size(toks) > 0, dense).otherwise(F.array_repeat(F.lit(0.0), dim))


def embed(rows: DataFrame, text: str = "text", hooks: Hooks = DEFAULT.hooks) -> DataFrame:
    """Adds ``embedding``: by the injected model, in Arrow batches, or by hashing."""
    if hooks.embed is None:
        return rows.withColumn("embedding", hash_embedding(F.col(text)).cast("array<float>"))
    model = hooks.embed

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(list(model(batch.fillna("").tolist())))

    return rows.withColumn("embedding", vectors(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank: exact cosine, each vector against a block of stated queries (query_id, q).

    Each task keeps its ``k`` best a query (see ``products.best``), so what is ranked in the end is small.
    """
    kind, asked = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    # Single precision goes to the tasks as it is, in half the bytes, and is widened there.
    wide = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), wide.alias("embedding"))
    arms = []
    for block in blocks_of(queries.select("query_id", F.col("q").cast("array<double>").alias("q"))):
        table = block.toArrow()  # a block of bounded size
        shared = queries.sparkSession.sparkContext.broadcast(products.sides(table["q"].combine_chunks()))
        ids = queries.sparkSession.sparkContext.broadcast(table["query_id"].combine_chunks())
        few = table.num_rows <= FEW_TERMS  # their products cost less than a shuffle of the vectors
        # The lambda binds this block's broadcasts.
        found = (rows if few else _dealt(rows)).mapInArrow(lambda batches, shared=shared, ids=ids: products.best(batches, shared.value, ids.value, k), f"query_id {asked}, key {kind}, score double")
        arms.append(top(found.withColumnRenamed("key", key), k, key))
    return reduce(DataFrame.unionByName, arms)


def _dealt(rows: DataFrame) -> DataFrame:
    """At least as many partitions as Spark runs at once: vectors often lie in few files, and products are the cost."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(2 * least)


def best_sections(chunk_hits: DataFrame, key: str = "order_index") -> DataFrame:
    """Sections of the best chunks: chunks were limited before, so there may be fewer sections than chunks."""
    best = chunk_hits.groupBy("query_id", "doc_id", key).agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("first"))
    return best.withColumn("rank", rank.cast("bigint")).drop("first")


def fuse(arms: list[DataFrame], key: str = "doc_id", k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of arms (query_id, key, rank): the sum of 1 / (k + rank)."""
    every = arms[0].select("query_id", key, "rank")
    for arm in arms[1:]:
        every = every.unionByName(arm.select("query_id", key, "rank"))
    return every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 10, *, mode: str = "hybrid", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, graph: DataFrame | None = None, hooks: Hooks = DEFAULT.hooks, overfetch: int = DEFAULT.overfetch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank. Arms by mode (bm25, vector, graph or all), 3k each, fused, optionally reranked."""
    wide, arms = k * overfetch, []
    if mode in ("hybrid", "bm25"):
        arms.append(top(lexical(docs, queries, doc_id=doc_id, text=text), wide))
    if mode in ("hybrid", "vector") and vectors is not None:
        arms.append(nearest(vectors, query_vectors, wide, "doc_id"))
    if mode in ("hybrid", "graph") and graph is not None:
        arms.append(top(graph, wide))
    fused = top(fuse(arms), wide)
    if hooks.rerank is not None:
        fused = rerank(fused, docs, queries, hooks, doc_id, text)
    return fused.where(F.col("rank") <= k).withColumn("score", F.round("score", 4))


def rerank(fused: DataFrame, docs: DataFrame, queries: DataFrame, hooks: Hooks, doc_id: str, text: str) -> DataFrame:
    """Reorders each query's candidates by an injected model, stably; candidates are few."""
    model = hooks.rerank
    body = docs.select(F.col(doc_id).alias("doc_id"), F.left(F.col(text), F.lit(2000)).alias("body"))
    rows = body.join(fused, "doc_id").join(queries, "query_id").select("query_id", "query", "doc_id", "score", "rank", "body")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        scores = pd.Series(model(group["query"].iloc[0], group.body.tolist()), index=group.index).round(4)
        group = group.loc[scores.sort_values(ascending=False, kind="stable").index]
        return group.assign(rank=range(1, len(group) + 1))[["query_id", "doc_id", "score", "rank"]]

    return rows.groupBy("query_id").applyInPandas(order, "query_id bigint, doc_id bigint, score double, rank bigint")


def evaluate(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Per query hits, returned, recall and precision. golden: query_id, relevant (text contained in a hit's title).

    A hit is a returned row whose title contains any relevant text; recall is capped at 1.
    """
    wanted = golden.groupBy("query_id").agg(F.collect_set(F.lower("relevant")).alias("wanted"))
    judged = hits.join(wanted, "query_id", "right").withColumn("hit", F.coalesce(F.exists("wanted", lambda w: F.lower(F.col("title")).contains(w)), F.lit(False)))
    by_query = judged.groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.count("title").alias("returned"), F.max(F.size("wanted")).alias("n"))
    return by_query.select("query_id", "hits", "returned", F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(1), F.col("n"))).alias("recall"), (F.col("hits") / F.greatest(F.lit(1), F.col("returned"))).alias("precision"))


def evaluation_mean(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.bround(F.coalesce(F.avg("recall"), F.lit(0.0)), 3).alias("recall_at_k"), F.bround(F.coalesce(F.avg("precision"), F.lit(0.0)), 3).alias("precision_at_k"))
