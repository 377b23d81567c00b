"""Markdown to sections, parts and chunks; trees of sections back to Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import slugify, strip

HEADING = r"(?mdU)^(#{1,6})\s+(.+?)\s*$"
# Headings of which an empty repeat is dropped.
NOISE_HEADINGS = ("оглавление", "описание", "содержание", "содержимое")


def split_sections(docs: DataFrame, doc_id: str = "doc_id", md: str = "md") -> DataFrame:
    """doc_id, order_index, level, heading, content, own_level: one row for each section, in place.

    A text without headings is one "(untitled)" section; text before the first heading is a
    "(preamble)". ``own_level`` is null for those two, which are nobody's parent.
    """
    marks = F.regexp_extract_all(F.col(md), F.lit(HEADING), F.lit(0))
    bodies = F.transform(F.split(F.col(md), HEADING), strip)
    found = F.transform(
        F.arrays_zip(marks.alias("mark"), F.slice(bodies, 2, F.greatest(F.size(bodies), F.lit(1))).alias("body")),
        lambda x: F.struct(
            F.length(F.regexp_extract(x["mark"], "^#+", 0)).alias("level"),
            strip(F.regexp_extract(x["mark"], r"(?sU)^#+\s+(.*)$", 1)).alias("heading"),
            F.coalesce(x["body"], F.lit("")).alias("content"),
            F.length(F.regexp_extract(x["mark"], "^#+", 0)).alias("own_level"),
        ),
    )
    alone = lambda name, text: F.struct(F.lit(1).alias("level"), F.lit(name).alias("heading"), text.alias("content"), F.lit(None).cast("int").alias("own_level"))
    first = F.element_at(bodies, 1)
    every = (
        F.when(F.size(marks) == 0, F.array(alone("(untitled)", strip(F.col(md)))))
        .when(first != "", F.concat(F.array(alone("(preamble)", first)), found))
        .otherwise(found)
    )
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(every).alias("order_index", "s")).select("doc_id", F.col("order_index").cast("bigint"), "s.*")


def with_hierarchy(sections: DataFrame) -> DataFrame:
    """Adds parent_order_index and breadcrumb.

    The parent is the nearest earlier section of a smaller level: the latest of the last ones of each
    level. On the way from the root each level counts only if it comes after all smaller ones.
    """
    before = W.partitionBy("doc_id").orderBy("order_index").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("own_level") == k, F.struct("order_index", "heading")), ignorenulls=True).over(before) for k in range(1, 6)}
    rows = sections.withColumns({f"last_{k}": x for k, x in last.items()})
    at = lambda k: F.when(F.col("own_level") > k, F.col(f"last_{k}"))
    parent = F.greatest(*[at(k)["order_index"] for k in range(1, 6)])
    steps = []
    for k in range(1, 6):
        older = [F.col(f"last_{j}")["order_index"] for j in range(1, k)]
        newest = reduce(lambda a, b: F.greatest(a, b), older) if len(older) > 1 else older[0] if older else F.lit(None).cast("bigint")
        steps.append(F.when(at(k)["order_index"] > F.coalesce(newest, F.lit(-1)), at(k)["heading"]))
    trail = F.concat_ws(" > ", *steps, F.col("heading"))
    return rows.select(*sections.columns, parent.alias("parent_order_index"), trail.alias("breadcrumb"))


def pack_paragraphs(content: Column, most: int) -> Column:
    """Paragraphs joined greedily to pieces of at most ``most`` characters; a longer paragraph stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    grow = lambda acc, p: F.when(
        (F.length(acc["cur"]) + F.length(p) + 2 > most) & (acc["cur"] != ""),
        F.struct(F.concat(acc["done"], F.array(strip(acc["cur"]))).alias("done"), p.alias("cur")),
    ).otherwise(F.struct(acc["done"].alias("done"), F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p).alias("cur")))
    return F.aggregate(F.split(content, r"\n{2,}"), start, grow, lambda acc: F.when(strip(acc["cur"]) != "", F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]))


def normalise(sections: DataFrame, most: int = DEFAULT.max_section_chars) -> DataFrame:
    """Drops repeated empty noise headings, splits large sections, renumbers, and keeps parents right.

    Further pieces of a section are its children, named "(pt.N)" one level deeper.
    """
    name = F.lower(strip(F.col("heading")))
    noise = (F.col("content") == "") & name.isin(*NOISE_HEADINGS)
    seen = F.row_number().over(W.partitionBy("doc_id", "noise").orderBy("order_index"))
    kept = sections.withColumn("noise", F.when(noise, name)).withColumn("nth", F.when(F.col("noise").isNotNull(), seen).otherwise(1)).where("nth = 1")
    pieces = F.when(F.length("content") > most, pack_paragraphs(F.col("content"), most)).otherwise(F.array("content"))
    cut = kept.select("doc_id", F.col("order_index").alias("old"), "parent_order_index", "level", "heading", "breadcrumb", F.posexplode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array("content"))).alias("piece", "content"))
    new = F.row_number().over(W.partitionBy("doc_id").orderBy("old", "piece")).cast("bigint") - 1
    numbered = cut.withColumn("order_index", new)
    # Where each old section's first piece went, so that parents can be found without a join.
    firsts = F.map_from_entries(F.collect_list(F.when(F.col("piece") == 0, F.struct("old", "order_index"))).over(W.partitionBy("doc_id")))
    part = F.concat(F.lit(" (pt."), (F.col("piece") + 1).cast("string"), F.lit(")"))
    more = F.col("piece") > 0
    return numbered.withColumn("moved", firsts).select(
        "doc_id",
        "order_index",
        F.try_element_at("moved", F.when(more, F.col("old")).otherwise(F.col("parent_order_index"))).alias("parent_order_index"),
        F.when(more, F.least(F.col("level") + 1, F.lit(6))).otherwise(F.col("level")).alias("level"),
        F.when(more, F.concat("heading", part)).otherwise(F.col("heading")).alias("heading"),
        F.when(more, F.concat("breadcrumb", part)).otherwise(F.col("breadcrumb")).alias("breadcrumb"),
        "content",
    )


def build_sections(docs: DataFrame, doc_id: str = "doc_id", md: str = "md", most: int = DEFAULT.max_section_chars, slugs: bool = False) -> DataFrame:
    """The whole section stage."""
    out = normalise(with_hierarchy(split_sections(docs, doc_id, md)), most)
    return out.withColumn("anchor_slug", slugify("heading")) if slugs else out


def toc(sections: DataFrame, depth: int = 2) -> DataFrame:
    return sections.where(F.col("level") <= depth).select("doc_id", "order_index", "level", "heading", "breadcrumb")


def chunks(sections: DataFrame, size: int = DEFAULT.chunk_tokens, overlap: int = DEFAULT.chunk_overlap, keys: tuple[str, ...] = ("doc_id", "order_index"), content: str = "content") -> DataFrame:
    """keys, ordinal, text, token_count: windows of white-space tokens; a short text is one chunk, as it is."""
    text = strip(F.coalesce(F.col(content), F.lit("")))
    step = max(1, size - overlap)
    rows = sections.select(*keys, text.alias("body"), F.split(text, r"(?U)\s+").alias("toks")).where("body <> ''").withColumn("n", F.size("toks"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((F.col("n") - size) / step) * step).cast("int"), F.lit(step)))
    at = rows.select(*keys, "body", "toks", "n", F.posexplode(starts).alias("ordinal", "start"))
    return at.select(
        *keys,
        F.col("ordinal").cast("bigint"),
        F.when(F.col("n") <= size, F.col("body")).otherwise(F.array_join(F.slice("toks", F.col("start") + 1, size), " ")).alias("text"),
        F.least(F.lit(size), F.col("n") - F.col("start")).cast("bigint").alias("token_count"),
    )


def _parts(text: str, most: int, marks: list[int]) -> Iterator[str]:
    """Lossless cuts: at the last heading that fits, else a blank line, else a line end, else hard."""
    at = 0
    while len(text) - at > most:
        limit = at + most
        tries = (max((m for m in marks if at < m <= limit), default=-1), text.rfind("\n\n", at, limit), text.rfind("\n", at, limit))
        cut = next((x for x in tries if x > at), limit)
        yield text[at:cut]
        at = cut
    yield text[at:]


def split_parts(docs: DataFrame, doc_id: str = "doc_id", md: str = "md", most: int = DEFAULT.max_part_chars) -> DataFrame:
    """doc_id, part_number (from 1), content. Cuts depend on each other, so a document is one Python step; short ones never leave the JVM."""
    import re

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(md), F.lit("")).alias("md"))
    heading = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.MULTILINE)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, p) for k, text in zip(batch.doc_id, batch.md) for i, p in enumerate(_parts(text, most, [m.start() for m in heading.finditer(text)]), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "part_number", "content"])

    long = rows.where(F.length("md") > most).mapInPandas(cut, "doc_id bigint, part_number bigint, content string")
    return rows.where(F.length("md") <= most).select("doc_id", F.lit(1).cast("bigint").alias("part_number"), F.col("md").alias("content")).unionByName(long)


def read_parts(parts: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """doc_id, content: chosen parts, or all, put together in order."""
    chosen = parts if numbers is None else parts.where(F.col("part_number").isin(numbers))
    ordered = F.array_sort(F.collect_list(F.struct("part_number", "content")))
    return chosen.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("content"))


def ancestors(sections: DataFrame) -> DataFrame:
    """doc_id, order_index, root_index: every section with itself and all sections above it.

    Levels rise along a path, so five steps up reach every root; each step is a look-up in a map of the
    document's parents.
    """
    parents = F.map_from_entries(F.collect_list(F.when(F.col("parent_order_index").isNotNull(), F.struct("order_index", "parent_order_index"))).over(W.partitionBy("doc_id")))
    rows = sections.withColumn("up", parents)
    path, here = [F.col("order_index")], F.col("order_index")
    for _ in range(6):
        here = F.try_element_at("up", here)
        path.append(here)
    return rows.select("doc_id", "order_index", F.explode(F.filter(F.array(*path), lambda x: x.isNotNull())).alias("root_index"))


def subtree_markdown(sections: DataFrame) -> DataFrame:
    """doc_id, root_index, markdown: each section with all below it, as Markdown in order."""
    line = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"), F.when(F.col("content") != "", F.concat(F.lit("\n\n"), F.col("content"))).otherwise(""))
    rows = ancestors(sections).join(sections.select("doc_id", "order_index", line.alias("line")), ["doc_id", "order_index"])
    ordered = F.array_sort(F.collect_list(F.struct("order_index", "line")))
    return rows.groupBy("doc_id", "root_index").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("markdown"))


def section_by_heading(sections: DataFrame, heading: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first section of each document with that heading in any case, and headings that contain it."""
    low = heading.strip().lower()
    exact = sections.where(F.lower("heading") == low).groupBy("doc_id").agg(F.min_by(F.struct("order_index", "heading", "content"), "order_index").alias("s")).select("doc_id", "s.*")
    near = sections.where(F.lower("heading").contains(low)).withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("order_index"))).where(F.col("nth") <= most).select("doc_id", "order_index", "heading")
    return exact, near
