"""The whole way from pages to a knowledge base, all documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as t
from ..sources.hooks import metadata, rewritten
from . import graph, retrieval, sections, verify


def structure(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds md and score to pages (doc_id, page_number, text): clean or broken pages as they are, others by the model.

    An answer that lost too much text is replaced by the source.
    """
    routed = pages.withColumn("route", verify.structure_route(F.coalesce(F.col("text"), F.lit("")), enabled=settings.hooks.rewrite is not None))
    raw = routed.where("route <> 'rewrite'").withColumn("md", t.strip(F.coalesce(F.col("text"), F.lit(""))))
    if settings.hooks.rewrite is not None:
        told = rewritten(routed.where("route = 'rewrite'"), "text", "answer", settings.hooks)
        if settings.hooks.escalate is not None:
            told = _escalated(told, settings)
        kept = verify.preserve(F.col("text"), F.coalesce(t.strip(F.col("answer")), t.strip(F.col("text"))), settings)
        raw = raw.unionByName(told.withColumn("md", kept).drop("answer"))
    found = verify.report(F.coalesce(F.col("text"), F.lit("")), F.col("md"), settings.faithfulness_min, settings.target_language)
    return raw.withColumn("score", F.when(t.strip(F.coalesce(F.col("text"), F.lit(""))) == "", F.lit(1.0)).otherwise(found["score"]))


def _escalated(told: DataFrame, settings: Settings) -> DataFrame:
    """The pages with a second answer, from the stronger model, where the first one failed. Only those pages go to it."""
    first = F.coalesce(t.strip(F.col("answer")), t.strip(F.col("text")))
    failed = ~verify.report(F.col("text"), first, settings.faithfulness_min, settings.target_language)["passed"]
    again = rewritten(told.withColumn("failed", failed), "text", "second", settings.hooks, settings.hooks.escalate, only="failed")
    return again.withColumn("answer", verify.better(F.col("text"), first, t.strip(F.col("second")), settings)).drop("second", "failed")


def assemble(pages: DataFrame, settings: Settings = DEFAULT, mask_secrets: bool = False) -> DataFrame:
    """doc_id, source, md, faithfulness, language, content_hash, pipeline_version: one row for each document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "md", "text")))
    docs = pages.groupBy("doc_id").agg(ordered.alias("p"), F.min("score").alias("worst"))
    joined = lambda field: F.array_join(F.transform("p", lambda x: F.coalesce(x[field], F.lit(""))), "\n\n")
    md = docs.select("doc_id", "worst", joined("text").alias("source"), t.clean_markdown(joined("md")).alias("md"))
    md = md.withColumn("md", F.coalesce(t.repair_encoding("md"), "md"))
    if mask_secrets:
        md = md.withColumn("md", t.redact(F.col("md")))
    whole = verify.report(F.col("source"), F.col("md"), settings.faithfulness_min, settings.target_language)["score"]
    languages = t.languages(F.col("md"))
    return md.select("doc_id", "source", "md", F.least("worst", whole).alias("faithfulness"), F.coalesce(F.get(languages, 0), t.guess_language(F.col("md"))).alias("language"), F.sha2("md", 256).alias("content_hash"), F.lit(settings.pipeline_version).alias("pipeline_version"))


def resolve_folders(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds folder: a wanted id that exists, else the wanted path, else the suggested one, else the root (null)."""
    known = folders.select(F.col("folder_id").alias("known_id"), F.col("path").alias("known_path"))
    rows = docs.join(known, docs["wanted_id"] == known["known_id"], "left")
    return rows.withColumn("folder", F.coalesce("known_path", F.nullif(F.col("wanted_path"), F.lit("")), F.nullif(F.col("suggested_path"), F.lit("")))).drop("known_id", "known_path")


def ingest(pages: DataFrame, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """All tables of the knowledge base from pages (doc_id, filename, page_number, text)."""
    names = pages.groupBy("doc_id").agg(F.min("filename").alias("filename"))
    docs = metadata(assemble(structure(pages.select("doc_id", "page_number", "text"), settings), settings).join(names, "doc_id"))
    found = sections.build_sections(docs, most=settings.max_section_chars)
    cut = sections.chunks(found, settings.chunk_tokens, settings.chunk_overlap)
    keyed = found.withColumn("whole", F.concat_ws("\n", "heading", "content"))
    named = graph.mentions(keyed, ("doc_id", "order_index"), "whole", least=settings.graph_min_entity_len, most=settings.graph_max_entities)
    return {
        "documents": docs,
        "parts": sections.split_parts(docs, most=settings.max_part_chars),
        "sections": found,
        "chunks": retrieval.embed(cut, hooks=settings.hooks),
        "mentions": named,
        "entities": graph.entities(named, ("doc_id", "order_index")),
        "edges": graph.edges(keyed, "whole", least=settings.graph_min_entity_len, most=settings.graph_max_entities),
    }
