"""Files to page texts, and documents back to Markdown files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Hooks
from ..functions import text as t

# File endings that are read as text, those of HTML, and the extractors of the catalogue.
TEXT_ENDINGS = ("md", "markdown", "txt", "text")
HTML_ENDINGS = ("html", "htm")
EXTRACTORS = ("passthrough", "tika", "docling", "azure_di", "vision_llm", "marker", "aws_textract", "google_docai", "mistral_ocr", "unstructured", "llamaparse")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, folder: str, hooks: Hooks = DEFAULT.hooks, glob: str | None = None) -> DataFrame:
    """path, page_number, text. Text and HTML stay in the JVM; other files go to the injected extractor, if any.

    Control characters are dropped and misread Cyrillic is mended on every page.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path", "content")
    kind = ending(F.col("path"))
    body = F.decode("content", "UTF-8")
    plain = files.where(kind.isin(*TEXT_ENDINGS, *HTML_ENDINGS)).select("path", F.lit(1).alias("page_number"), F.when(kind.isin(*HTML_ENDINGS), t.html_to_text(body)).otherwise(body).alias("text"))
    if hooks.extract is not None:
        model = hooks.extract

        def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(p, i, x) for p, c in zip(batch.path, batch.content) for i, x in enumerate(model(c, p), 1)], columns=["path", "page_number", "text"])

        plain = plain.unionByName(files.where(~kind.isin(*TEXT_ENDINGS, *HTML_ENDINGS)).mapInPandas(pages, "path string, page_number int, text string"))
    tidy = plain.withColumn("text", t.strip_control(F.col("text")))
    return tidy.withColumn("text", F.coalesce(t.repair_encoding("text"), "text"))


def has_text_layer(pages: DataFrame) -> DataFrame:
    """path, text_layer: whether pages hold at least max(200, 20 a page) characters in all."""
    return pages.groupBy("path").agg((F.sum(F.length("text")) >= F.greatest(F.lit(200), 20 * F.count("*"))).alias("text_layer"))


def page_ranges(files: DataFrame, most: int = DEFAULT.extract_max_pages) -> DataFrame:
    """path, first_page, last_page: large files in ranges that are extracted on their own, numbered through."""
    starts = F.explode(F.sequence(F.lit(1), F.col("n_pages"), F.lit(most)))
    return files.where("n_pages > 0").select("path", "n_pages", starts.alias("first_page")).select("path", "first_page", F.least(F.col("first_page") + most - 1, "n_pages").alias("last_page"))


def rescan_needed(detected: Column, current: Column) -> Column:
    """Whether some language of the text was not among those that it was scanned for."""
    return F.size(F.array_except(detected, current)) > 0


def keep_rescan(old: Column, new: Column) -> Column:
    """A new scan counts if it isn't much shorter."""
    return F.length(new) >= 0.9 * F.length(old)


def catalogue(spark: SparkSession, hooks: Hooks = DEFAULT.hooks) -> DataFrame:
    """name, available: only text and HTML are built in, the rest is what a hook provides."""
    return spark.createDataFrame([(n, n == "passthrough" or hooks.extract is not None) for n in EXTRACTORS], "name string, available boolean")


def figure_links(md: Column, prefix: str = "assets/") -> Column:
    """Image links that point to the exported folder, by the last part of their target."""
    return F.regexp_replace(md, r"!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)\)", f"![$1]({prefix}$2)")


def export(docs: DataFrame, folder: str, name: str = "title", md: str = "md") -> None:
    """One folder of Markdown text for each document, by slug."""
    rows = docs.select(t.slugify(name).alias("slug"), figure_links(F.col(md)).alias("value"))
    rows.write.mode("overwrite").partitionBy("slug").text(folder)


_MARK = "version string, number bigint, published_at timestamp"


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    """The markers of all versions; none where nothing was published yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _MARK)
    return spark.read.schema(_MARK).parquet(f"{folder}/_versions")


def publish(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """Writes all tables under one version, then a marker: readers that look for the marker see all or nothing.

    A version that is published already is refused, since readers may be at it. One publisher at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    marks = _marks(spark, folder)
    known = marks.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"), F.coalesce(F.bool_or(F.col("version") == version), F.lit(False)).alias("there")).first()
    if known.there:
        raise ValueError(f"version {version} is published already")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")  # what a failed attempt left
    mark = spark.range(1).select(F.lit(version).alias("version"), F.lit(known.last + 1).cast("bigint").alias("number"), F.current_timestamp().alias("published_at"))
    mark.coalesce(1).write.mode("append").parquet(f"{folder}/_versions")
    return version


def published(spark: SparkSession, folder: str) -> str | None:
    """The version that was published last, by its number, whatever its name."""
    return _marks(spark, folder).agg(F.max_by("version", "number")).first()[0]


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant from a JSON list of {query, relevant_doc_titles, relevant_section_headings}."""
    rows = spark.read.schema("query string, relevant_doc_titles array<string>, relevant_section_headings array<string>").json(path, multiLine=True)
    keyed = rows.withColumn("query_id", F.xxhash64("query"))
    none = F.array().cast("array<string>")
    return keyed.select("query_id", "query", F.explode_outer(F.concat(F.coalesce("relevant_doc_titles", none), F.coalesce("relevant_section_headings", none))).alias("relevant"))
