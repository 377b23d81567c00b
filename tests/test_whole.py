"""Queries that look at the whole of their input."""

from pyspark.sql import functions as F

from heronkb.functions import text as t
from heronkb.operators import ingest, sections
from heronkb.plans import catalog, views


def test_diff_of_all_sections(spark, small):
    rows = catalog.QUERIES["section_diff_whole"](spark, small).select("doc_id", "status").collect()
    keys = sections.split_sections(views.md_docs(spark, small)).select("doc_id", t.heading_key(F.col("heading"))).distinct().count()
    assert sum(r.status != "added" for r in rows) == keys and {r.doc_id for r in rows} == {r.doc_id for r in catalog.docs(spark, small).select("doc_id").collect()}
    assert {r.status for r in rows} == {"added", "removed", "changed", "unchanged"}


def test_language_of_a_long_page_is_that_of_all_of_it(spark):
    page = "der die " + "zzz " * 1500 + "the and of to in is for with that this"
    pages = spark.createDataFrame([(1, "a", 1, page)], "doc_id bigint, filename string, page_number int, text string")
    assert ingest.ingest(pages)["documents"].first().language == "en"


def test_labels_of_whole_texts(spark, small):
    rows = catalog.QUERIES["slugs"](spark, small).collect()
    assert all(r.label == r.slug.replace("-", "_") for r in rows) and any(len(r.label) > 30 for r in rows)
