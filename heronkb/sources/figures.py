"""Figures of pages, repairs by a second reading, and answers of models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import OCR_CODE, extract_json, has_residual_garble, looks_garbled

# Figure classes that are left out, and the longest alternative text.
SKIPPED = ("logo", "decor")
ALT_CHARS = 80


def with_tokens(figures: DataFrame) -> DataFrame:
    """Adds a token to figures (doc_id, page_number, figure): one number for each, through the whole document."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "figure")) - 1
    return figures.withColumn("token", F.format_string("[[FIGURE_%04d]]", nth))


def described(answer: Column) -> dict[str, Column]:
    """fig_class, informative, description from a model's JSON answer; without a description nothing is informative."""
    json = extract_json(F.coalesce(answer, F.lit("")))
    kind = F.coalesce(F.nullif(F.get_json_object(json, "$.fig_class"), F.lit("")), F.nullif(F.get_json_object(json, "$.class"), F.lit("")), F.lit("schematic"))
    text = F.trim(F.coalesce(F.get_json_object(json, "$.description"), F.lit("")))
    says = F.coalesce(F.get_json_object(json, "$.informative"), F.lit("true")) != "false"
    good = says & ~kind.isin(*SKIPPED) & (text != "")
    return {"fig_class": kind, "informative": good, "description": F.when(good, text).otherwise("")}


def block(path: Column, caption: Column, description: Column, informative: Column) -> Column:
    """The Markdown that takes a token's place; an empty one for figures that say nothing."""
    alt = F.left(F.coalesce(F.nullif(caption, F.lit("")), F.nullif(description, F.lit("")), F.lit("figure")), F.lit(ALT_CHARS))
    picture = F.concat(F.lit("\n\n!["), alt, F.lit("]("), path, F.lit(")\n\n"))
    return F.when(informative, F.concat(picture, F.when(description != "", F.concat(F.lit("> **Figure:** "), description, F.lit("\n\n"))).otherwise(""))).otherwise("\n\n")


def put_figures(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, md) with the tokens of blocks (doc_id, page_number, token, block) replaced."""
    found = blocks.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("token", "block")).alias("blocks"))
    rows = pages.join(found, ["doc_id", "page_number"], "left")
    done = F.aggregate("blocks", F.col("md"), lambda md, b: F.replace(md, b["token"], b["block"]))
    return rows.withColumn("md", F.coalesce(done, "md")).drop("blocks")


def accept_repair(old: Column, new: Column) -> Column:
    """Whether a second reading of a page counts: it must be clean itself, and the first broken, shorter, or
    partly broken and at most twice as long."""
    fresh = F.coalesce(new, F.lit(""))
    clean = (fresh != "") & ~looks_garbled(fresh) & ~has_residual_garble(fresh)
    before = F.coalesce(old, F.lit(""))
    return clean & (looks_garbled(before) | (F.length(fresh) > F.length(before)) | (has_residual_garble(before) & (F.length(fresh) >= 0.5 * F.length(before))))


def answered_languages(answer: Column, most: int = 3) -> Column:
    """Known two-letter codes of a model's answer, in order, each once."""
    codes = F.regexp_extract_all(F.lower(answer), F.lit("[a-z]{2}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(codes, lambda c: c.isin(*OCR_CODE))), 1, most)


def prompt(template: str, **values: object) -> str:
    """A prompt with each {NAME} replaced."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def demo_pages(spark: SparkSession) -> DataFrame:
    """Three short documents with their folders, to try the engine on."""
    rows = [
        (1, "Machines/Lathes", "lathe.md", "# Bench Lathe BL-20\n\n## Data\n\nSwing 200 mm, power 1.5 kW.\n\n## Use\n\nOil the ways before work.\n"),
        (2, "Machines/Saws", "saw.md", "# Band Saw BS-7\n\n## Purpose\n\nThe Band Saw BS-7 cuts bars for the Bench Lathe.\n\n## Care\n\nChange the blade each month.\n"),
        (3, "Rules", "rules.md", "# Workshop Rules\n\n## Dress\n\nWear glasses and no loose sleeves.\n\n## Power\n\nPull the plug before repairs.\n"),
    ]
    return spark.createDataFrame([(i, folder, name, 1, text) for i, folder, name, text in rows], "doc_id bigint, folder_path string, filename string, page_number int, text string")
