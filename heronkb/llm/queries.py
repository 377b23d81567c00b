"""The dealt operators as queries over the whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, curriculum, decontam, licenses, order_minhash, packing, pii, ring, simhash, toxicity, urlfilter, warc


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_likeness(_t(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_t(spark, sf_dir, "documents"))


def op8_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.digest(_t(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(_t(spark, sf_dir, "pages"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_t(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_t(spark, sf_dir, "pages"))


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator over archives that were damaged on purpose."""
    return warc.salvage_digest(_t(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_t(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_t(spark, sf_dir, "documents"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.digest(_t(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(_t(spark, sf_dir, "documents"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator over pages that name aliases, which the pages of the table hardly do."""
    return urlfilter.alias_digest(_t(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_order_minhash, op3_simhash, op4_toxicity, op5_pii, op6_warc, op7_licenses, op8_ring, op9_url_filter, op10_pack, op11_align, op12_mix, op13_collocations, url_aliases, warc_salvage)
}
#: The others are tested against brute force in tests/llm: SQL has no XXH64, sequential packing, positions of
#: matches or learned weights.
SQL = {
    "op1_decontaminate": decontam.SQL,
    "op6_warc": warc.SQL,
    "warc_salvage": warc.SALVAGE_SQL,
    "op9_url_filter": urlfilter.sql(),
    "op12_mix": curriculum.sql(),
    "op13_collocations": collocations.SQL,
    "url_aliases": urlfilter.sql(urlfilter.ALIAS_PAGES),
}
