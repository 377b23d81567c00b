"""Knowledge graph derived from text: entities, mentions and co-occurrence, recomputed as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import let, sub


# An upper-case word start, phrases of two or more such words, tokens, and words that are no entity.
_CAP = r"[A-ZА-ЯЁ][\p{L}\p{N}_\-]*"
PHRASE = rf"{_CAP}(?:[ \t]+{_CAP})+"
TOKEN = r"[A-Za-zА-яёЁ0-9][A-Za-zА-яёЁ0-9\-]*"
STOP = ("the", "and", "for", "with", "this", "that", "from", "into", "are", "was", "were", "его", "это", "как", "для", "что", "при", "или", "see", "note", "fig")


def entities_of(text: Column, least: int = DEFAULT.graph_min_entity_len, most: int = DEFAULT.graph_max_entities) -> Column:
    """Array of (norm, name, kind): phrases first, then codes and acronyms, each norm once, at most ``most``."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    named = lambda raw, kind: F.struct(F.lower(raw).alias("norm"), raw.alias("name"), kind.alias("kind"))
    tidy = lambda raw: sub(sub(raw, r"(?U)\s+", " "), r"^[ \-·•\t]+|[ \-·•\t]+$", "")
    phrases = F.filter(F.transform(found(PHRASE), lambda x: named(tidy(x), F.lit("concept"))), lambda e: F.length(e["norm"]) >= least)
    code = lambda x: x.rlike("[0-9]") & x.rlike(r"\p{L}")
    acronym = lambda x: x.rlike(r"^\p{Lu}{2,6}$")
    marks = F.filter(found(TOKEN), lambda x: code(x) | acronym(x))
    singles = F.filter(F.transform(marks, lambda x: named(tidy(x), F.when(code(x), "code").otherwise("acronym"))), lambda e: F.length(e["norm"]) >= 2)
    every = F.filter(F.concat(phrases, singles), lambda e: ~e["norm"].isin(*STOP) & ~e["norm"].rlike(r"^\p{Nd}+$"))
    norms = lambda es: F.slice(F.array_distinct(F.transform(es, lambda e: e["norm"])), 1, most)
    return let(every, lambda es: F.transform(norms(es), lambda n: F.element_at(F.filter(es, lambda e: e["norm"] == n), 1)))


def mentions(sections: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", **options) -> DataFrame:
    """keys, position, norm, name, kind: in place."""
    return sections.select(*keys, F.posexplode(entities_of(F.coalesce(F.col(text), F.lit("")), **options)).alias("position", "e")).select(*keys, F.col("position").cast("bigint"), "e.*")


def entities(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """norm, name and kind as first seen, and in how many sections."""
    first = F.min_by(F.struct("name", "kind"), F.struct(*keys, "position"))
    return found.groupBy("norm").agg(first.alias("f"), F.count("*").alias("mention_count")).select("norm", "f.name", "f.kind", "mention_count")


def edges(sections: DataFrame, text: str = "text", **options) -> DataFrame:
    """norm_a, norm_b, weight: in how many sections two entities stand together.

    Pairs are formed inside a row, which holds at most 30 entities, and counted before they move.
    """
    norms = F.array_sort(F.transform(entities_of(F.coalesce(F.col(text), F.lit("")), **options), lambda e: e["norm"]))
    rows = sections.select(norms.alias("norms")).where(F.size("norms") > 1).select("norms", F.posexplode("norms").alias("i", "norm_a"))
    pairs = rows.select("norm_a", F.explode(F.slice("norms", F.col("i") + 2, F.size("norms"))).alias("norm_b"))
    return pairs.groupBy("norm_a", "norm_b").agg(F.count("*").alias("weight"))


def search_entities(known: DataFrame, query: str = "", most: int = 50) -> DataFrame:
    """Entities whose norm contains the query, most mentioned first."""
    wanted = query.strip().lower()
    rows = known.where(F.col("norm").contains(wanted)) if wanted else known
    return rows.orderBy(F.desc("mention_count"), "name", "norm").limit(most)


def neighbours(links: DataFrame, known: DataFrame, norm: str, most: int = 25) -> DataFrame:
    """Other ends of an entity's edges, heaviest first; both directions are one equi-join."""
    both = links.select(F.col("norm_a").alias("me"), F.col("norm_b").alias("norm"), "weight").unionByName(links.select(F.col("norm_b").alias("me"), F.col("norm_a").alias("norm"), "weight"))
    return both.where(F.col("me") == norm).join(known, "norm").select("norm", "name", "kind", "weight").orderBy(F.desc("weight"), "norm").limit(most)


def entity_sections(found: DataFrame, norm: str, docs: DataFrame, most: int = 100) -> DataFrame:
    hits = found.where(F.col("norm") == norm).select("doc_id", "position")
    return docs.join(hits, "doc_id").orderBy("doc_id", "position").limit(most)


def size(known: DataFrame) -> DataFrame:
    """n: how many entities the graph holds."""
    return known.agg(F.count("*").alias("n"))


def overview(known: DataFrame, links: DataFrame, nodes: int = 60, most: int = 500) -> DataFrame:
    """Heaviest edges among the most mentioned entities."""
    best = F.broadcast(known.orderBy(F.desc("mention_count"), "name", "norm").limit(nodes).select("norm"))  # nodes rows at most
    inside = links.join(best.withColumnRenamed("norm", "norm_a"), "norm_a", "left_semi").join(best.withColumnRenamed("norm", "norm_b"), "norm_b", "left_semi")
    return inside.orderBy(F.desc("weight"), "norm_a", "norm_b").limit(most)


def stream(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: how many of a section's entities contain any query word of 3 or more letters."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda x: F.length(x) >= 3)
    asked = queries.select("query_id", words.alias("words"))
    # Every entity name is compared once with a few queries, before its mentions are joined.
    hit = found.select("norm").distinct().join(asked, F.exists("words", lambda w: F.col("norm").contains(w))).select("query_id", "norm")
    return found.join(hit, "norm").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
