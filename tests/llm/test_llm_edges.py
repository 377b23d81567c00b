"""Null, empty, long, tied and repeated rows, empty tables and clashing columns, for every dealt operator."""

import pytest
from pyspark.sql import functions as F

from heronkb.llm import decontam, licenses, order_minhash, packing, pii, ring, simhash, toxicity, urlfilter, warc

LONG = "long words go on " * 60_000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and names that operators use inside."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   ", "en", "s", 3), (4, LONG, "en", "s", len(LONG)), (5, "same text here", "en", "s", 14), (5, "same text here", "en", "s", 14), (6, "same text here", "en", "s", 14), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (7, "x" * 300_000, "en", "s", 1)]
    clash = {c: F.lit(1) for c in ("fp", "component", "node", "guest", "part", "score", "spans", "arc", "salt", "nth", "length", "twin", "place", "size")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 1, 1), (5, 0, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "here"), (4, "!!")], "item_id bigint, text string")


def _ids(rows):
    return sorted((-1 if r[0] is None else r[0]) for r in rows)


ALL = [-1, -1, 1, 2, 3, 4, 5, 5, 6, 7]


@pytest.mark.parametrize("make", [order_minhash.edit_likeness, simhash.digest, pii.digest, licenses.digest, ring.digest, lambda d: packing.pack(d).where("piece = 0")], ids=["omh", "simhash", "pii", "licenses", "ring", "pack"])
def test_every_row_once_and_empty_tables(odd, make):
    assert _ids(make(odd).select("doc_id").collect()) == ALL
    assert make(odd.limit(0)).collect() == []


def test_decontamination(odd, bench):
    rows = decontam.digest(odd, bench).collect()
    assert _ids(rows) == ALL
    hit = {r.doc_id: r for r in rows if r.contaminated}
    assert set(hit) == {5, 6} and hit[5].n_hit == 3 and hit[5].n_items == 1
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert decontam.digest(odd.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.digest(odd, bench.limit(0)).collect())


def test_decontamination_in_blocks_is_the_same(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = decontam.scan(docs, bench)
    blocks = decontam.scan(docs, bench, block_bytes=2000)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_removal_keeps_columns_and_clean_rows(odd, bench):
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and _ids(kept.select("doc_id").collect()) == [-1, -1, 1, 2, 3, 4, 7]
    cut = {r.doc_id: r.text for r in decontam.cut_spans(odd, bench).collect()}
    assert cut[5] == "" and cut[1] is None and cut[4] == LONG


def test_toxicity(odd, labels):
    rows = toxicity.digest(odd, labels).collect()
    assert _ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = toxicity.digest(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert toxicity.digest(odd.limit(0), labels).collect() == []
    kept = toxicity.drop_toxic(odd, toxicity.model(odd, labels))
    assert kept.columns == odd.columns


def test_ties_in_simhash(odd):
    rows = simhash.digest(odd).collect()
    by = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (None, None)} <= by
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and _ids(kept.select("doc_id").collect()) == [-1, 1, 4, 5, 7]


def test_one_row_of_each_class_where_ids_repeat(spark):
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.text for r in kept) == texts and {r.doc_id for r in kept if r.text == texts[0]} == {1}


def test_masking(odd):
    kept = pii.mask(odd, length="n_chars")
    assert kept.columns == odd.columns and {r.doc_id: r.n_chars for r in kept.collect()}[1] is None


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no url", ""), (2, "http://a.com/en/1", "x" * 2000), (3, "http://a.com/en/1", "x" * 2000), (None, "http://b.net/q\n?", "é" * 600_000), (3, "http://a.com/en/1", "x" * 2000)], "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "node": F.lit(1), "rule": F.lit("x"), "first_id": F.lit(0)})
    got = sorted(map(tuple, warc.digest(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (2, 2000, "revisit", 3), (3, 2000, "response", None), (3, 2000, "response", None), (None, 1_200_000, "response", None)], key=str)
    verdicts = urlfilter.digest(pages).collect()
    assert len(verdicts) == 6 and {r.verdict for r in verdicts if r.host == "a.com"} == {"block"}
    assert warc.digest(pages.limit(0)).collect() == [] and urlfilter.digest(pages.limit(0)).collect() == []


def test_repeated_and_quoted_aliases(spark):
    html = """<link rel="canonical"><link rel="canonical" href="http://c.org/1"><link rel="canonical" href="http://c.org/2">
    <meta http-equiv="refresh" content="0; url='http://a.org/b'"><meta http-equiv=refresh content="5; URL=http://a.org/c">"""
    edges = urlfilter.alias_edges(spark.createDataFrame([("http://x.org/", html)], "url string, html string")).collect()
    assert {r.dst for r in edges} == {"http://c.org/1", "http://c.org/2", "http://a.org/b", "http://a.org/c"}
