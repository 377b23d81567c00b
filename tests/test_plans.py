"""Plans stay the ones wanted: filters and columns reach the scan, and nothing runs in Python that needn't."""

import re

import pytest
from pyspark.sql import functions as F

from heronkb.operators import sections, upkeep
from heronkb.plans import catalog, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(catalog.filtered_documents(spark, small))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", text)[1]  # Spark cuts the list short
    assert "IsNotNull(source)" in pushed and "IsNotNull(n_chars)" in pushed and "Exchange" not in text
    assert "ReadSchema: struct<source:string>" in plan(catalog.source_counts(spark, small))


@pytest.mark.parametrize("name", ["redact_docs", "html_to_text", "looks_clean", "detect_lang", "chunks", "verify_faith", "postings", "graph_mentions", "content_hash"])
def test_row_wise_operators_shuffle_nothing_and_stay_in_the_jvm(spark, small, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert not re.search("Exchange|Python|Pandas|Arrow", text)


def test_copies_move_ids_and_hashes_only(spark, small):
    text = plan(upkeep.deduplicate(catalog.docs(spark, small)))
    assert text.count("Exchange") == 1 and "partial_min" in text


def test_sections_are_dealt_by_document_once(spark, small):
    text = plan(sections.build_sections(views.md_docs(spark, small)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_tree_columns(spark, small):
    assert views.folders(spark, small).where(F.col("parent_id").isNull()).count() == 5
