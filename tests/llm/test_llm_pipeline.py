"""The pipeline against its parts written plainly."""

import corpus_pipeline
from heronkb.llm import pii


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]
    masked = spark.read.parquet(f"{tmp_path}/pii").collect()
    assert not any(pii.spans_of(r.text) for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in masked}


def test_a_stage_drops_the_memory_of_the_one_before(spark, small):
    from heronkb.llm import arrow, packing

    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    left = arrow.map_rows(docs.select("text"), "n int", lambda: lambda batch: {"n": [len(arrow._kept)] * batch.num_rows})
    packing.pieces(docs).count()
    assert left.first().n == 0
    words = packing.word_tokens(packing.tokenizer_path())
    arrow.drop_all_but(f"words {packing.tokenizer_path()}")
    assert packing.word_tokens(packing.tokenizer_path()) is words
    arrow.drop_all_but(None)
    assert packing.word_tokens(packing.tokenizer_path()) is not words
