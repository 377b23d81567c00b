"""Faithfulness of rewritten text to its source, by words, numbers and foreign remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import let, looks_clean, looks_garbled, strip


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def report(source: Column, output: Column, least: float = DEFAULT.faithfulness_min, target_language: str = "auto") -> dict[str, Column]:
    """coverage, numbers_ok, missing_numbers (20 at most), clean, score, passed; rounded half-even to 3 places."""
    return _report(_parts(source, output), output, least, target_language)


def _parts(source: Column, output: Column) -> dict[str, Column]:
    return {"src": _words(source), "out": _words(output), "numbers": _numbers(source), "there": _numbers(output)}


def _report(parts: dict[str, Column], output: Column, least: float, target_language: str) -> dict[str, Column]:
    src, out, numbers, there = parts.values()
    coverage = F.when(F.size(src) > 0, F.size(F.array_intersect(src, out)) / F.size(src)).otherwise(F.lit(1.0))
    # What is gone is mostly little, so each number is sought in that and not in all of the other text's.
    missing = let(F.array_except(numbers, there), lambda gone: F.filter(numbers, lambda x: F.array_contains(gone, x)))
    numbers_ok = F.when(F.size(numbers) > 0, F.size(missing) / F.size(numbers) < 0.05).otherwise(True)
    clean = F.lit(True) if target_language in ("auto", "zh", "zh-cn") else ~output.rlike(r"[\x{4E00}-\x{9FFF}]")
    score = coverage * F.when(numbers_ok, 1.0).otherwise(0.7) * F.when(clean, 1.0).otherwise(0.8)
    return {
        "coverage": F.bround(coverage, 3),
        "numbers_ok": numbers_ok,
        "missing_numbers": F.slice(missing, 1, 20),
        "clean": clean,
        "score": F.bround(score, 3),
        "passed": score >= least,
    }


def verify(pairs: DataFrame, source: str = "source", output: str = "output", least: float = DEFAULT.faithfulness_min, target_language: str = "auto") -> DataFrame:
    """The report of each row; words and numbers are columns of an inner step, so that each text is read once."""
    rest = [c for c in pairs.columns if c not in (source, output)]
    parts = _parts(F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit("")))
    read = pairs.select(*rest, F.coalesce(F.col(output), F.lit("")).alias("__output"), *[v.alias(f"__{k}") for k, v in parts.items()])
    found = _report({k: F.col(f"__{k}") for k in parts}, F.col("__output"), least, target_language)
    return read.select(*rest, *[v.alias(k) for k, v in found.items()])


def corpus(scores: DataFrame, score: str = "score", least: float = DEFAULT.faithfulness_min) -> DataFrame:
    """How many documents are scored, mean and least score, and how many are under the threshold."""
    s = F.col(score)
    return scores.agg(
        F.count(s).alias("documents_scored"),
        F.bround(F.coalesce(F.avg(s), F.lit(0.0)), 3).alias("avg_faithfulness"),
        F.bround(F.coalesce(F.min(s), F.lit(0.0)), 3).alias("min_faithfulness"),
        F.count_if(s < least).alias("below_threshold"),
    )


def worst(pages: DataFrame, whole: DataFrame) -> DataFrame:
    """doc_id, faithfulness, confidence: the least of all page scores and the document's own; the mean page confidence."""
    by_doc = pages.groupBy("doc_id").agg(F.min("score").alias("page_min"), F.avg("confidence").alias("confidence"))
    return whole.join(by_doc, "doc_id", "left").select("doc_id", F.least("score", "page_min").alias("faithfulness"), F.bround("confidence", 4).alias("confidence"))


def structure_route(text: Column, enabled: bool = True, smart: bool = True) -> Column:
    """What becomes of a page: empty, raw (off, garbled or clean already), or rewritten by the model."""
    raw = F.when(F.lit(not enabled), "raw").when(looks_garbled(text), "raw_garbled")
    raw = raw.when(looks_clean(text), "raw_clean") if smart else raw
    return F.when(strip(text) == "", "empty").otherwise(raw.otherwise("rewrite"))


def better(source: Column, first: Column, second: Column, settings: Settings = DEFAULT) -> Column:
    """The second answer where the first fails verification and the second scores as much or more, else the first."""
    score = lambda x: report(source, x, settings.faithfulness_min, settings.target_language)
    one = score(first)
    return F.when(~one["passed"] & second.isNotNull() & (score(second)["score"] >= one["score"]), second).otherwise(first)


def preserve(source: Column, output: Column, settings: Settings = DEFAULT) -> Column:
    """The output, or the source where a long source has lost too much of its length."""
    lost = (F.length(output) < settings.structure_min_length_ratio * F.length(source)) & (F.length(source) > 200)
    return F.when(lost, strip(source)).otherwise(output)
