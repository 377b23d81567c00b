"""Stop words and endings: families of words meet, and both engines agree on odd ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from heronkb.functions import language
from heronkb.functions.text import tokens
from heronkb.operators import retrieval

FAMILIES = {
    "english": ["walk walks walked walking", "city cities", "class classes", "run runs running", "relate relates relation relational", "kind kindness kindly", "make makes making", "bus"],
    "german": ["haus hauses häuser häusern", "zeitung zeitungen", "freiheit freiheiten", "maß masse"],
    "french": ["cheval chevaux", "parler parlez parlaient parlant", "nation nations nationale", "vérité vérités"],
    "spanish": ["casa casas", "hablar hablando hablado hablaron", "canción canciones", "rápido rápida rápidamente"],
}


@pytest.mark.parametrize("config", FAMILIES)
def test_families_meet_and_stop_words_go(spark, config):
    for family in FAMILIES[config]:
        found = spark.range(1).select(language.stems(tokens(F.lit(family)), config)).first()[0]
        if family.startswith(("nation", "canción", "maß")):
            assert len(set(found)) < len(found)
        else:
            assert len(set(found)) == 1, (family, found)
    stop = language.STOP[config]
    assert spark.range(1).select(language.stems(tokens(F.lit(f"{stop} {stop.upper()}")), config)).first()[0] == []


@pytest.mark.parametrize("config", FAMILIES)
def test_native_form_equals_sql(spark, small, config):
    words = ["", "a", "es", "ies", "sses", "x ies", "the the the", "ing bing ring", "äöüß", "à à", "aux beaux", "ssss", "e ee eee eeee eeeee", "n_1 22nd"]
    texts = words + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(language.stems(tokens("t"), config)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    pattern = r"[\p{L}\p{N}_]+"
    want = [r[0] for r in con.execute(f"SELECT {language.sql(f'regexp_extract_all(lower(t), {chr(39)}{pattern}{chr(39)})', config)} FROM x ORDER BY i").fetchall()]
    assert got == want


def test_search_by_language(spark):
    docs = spark.createDataFrame(
        [(1, "He was walking in the cities", "en"), (2, "walks", "de"), (3, "die Häuser", "de"), (4, None, "en"), (5, "Walked; a city!", "en"), (6, "walk city", None), (7, "walk city", "xx")],
        "doc_id bigint, text string, lang string",
    )
    queries = spark.createDataFrame([(1, "the walks of a city", "en"), (2, "Haus", "de"), (3, "the of", "en"), (4, "walk city", None)], "query_id bigint, query string, lang string")
    hits = retrieval.lexical(docs, queries, analyse=language.analyser()).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == {(1, 1), (1, 5), (2, 3), (4, 6), (4, 7)}


def test_many_query_terms_are_joined_instead(spark, monkeypatch, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    queries = spark.createDataFrame([(1, "the of and"), (2, "der die the the")], "query_id bigint, query string")
    rows = lambda: {tuple(r) for r in retrieval.scores(docs, queries, match_all=False).collect()}
    few = rows()
    monkeypatch.setattr(retrieval, "FEW_TERMS", 1)
    assert few and rows() == few


def test_the_corpus_is_analysed_by_its_distinct_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    queries = spark.createDataFrame([(1, "the ingly hested", "en"), (2, "der ungen cht", "de"), (3, "the of", "en")], "query_id bigint, query string, lang string")
    analyse = language.analyser()
    terms = retrieval.query_terms(queries, analyse)
    whole = lambda a: {tuple(r) for r in retrieval.scores(docs, queries, match_all=False, analyse=a).collect()}
    assert retrieval._matches_by_word(docs, terms, "doc_id", "text", analyse)[1].agg(F.sum("n_docs")).first()[0] == docs.count()
    assert whole(analyse) == whole(lambda text: analyse(text))  # the second analyses whole texts
