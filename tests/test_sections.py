"""Sections, parts, chunks and faithfulness against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from heronkb.operators import ingest, sections, verify


def md(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, md string")


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id, r.order_index))


def plain_tree(levels):
    out, stack = [], []
    for i, level in enumerate(levels):
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append((stack[-1][1] if stack else None, [j for _, j in stack]))
        stack.append((level, i))
    return out


def test_tree_equals_a_stack(spark):
    rng = random.Random(4)
    lists = [[rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    found = sections.build_sections(md(spark, *["".join(f"{'#' * k} h{i}\ntext {i}\n" for i, k in enumerate(ks)) for ks in lists]))
    got = {}
    for r in found.collect():
        got[r.doc_id, r.order_index] = (r.parent_order_index, r.breadcrumb)
    for d, levels in enumerate(lists):
        for i, (parent, path) in enumerate(plain_tree(levels)):
            assert got[d, i] == (parent, " > ".join(f"h{j}" for j in [*path, i]))


def test_untitled_preamble_and_odd_headings(spark):
    got = rows(sections.build_sections(md(spark, "just text ", "before\n# A\nbody\n## B\n", "# \nfoo\nbar", "", "```\n# code\n```"), slugs=True))
    assert [(r.doc_id, r.heading, r.content, r.parent_order_index) for r in got] == [
        (0, "(untitled)", "just text", None), (1, "(preamble)", "before", None), (1, "A", "body", None), (1, "B", "", 1), (2, "foo", "bar", None), (3, "(untitled)", "", None), (4, "(preamble)", "```", None), (4, "code", "```", None),
    ]
    assert got[2].anchor_slug == "a"


def test_large_sections_keep_their_children(spark):
    text = "# A\n" + "\n\n".join(f"paragraph {i} " + "x" * 90 for i in range(40)) + "\n## B\nend"
    got = rows(sections.build_sections(md(spark, text), most=1000))
    assert len(got) > 3 and all(len(r.content) <= 1000 for r in got)
    assert got[1].heading == "A (pt.2)" and got[1].level == 2 and got[1].parent_order_index == 0
    assert got[-1].heading == "B" and got[-1].parent_order_index == 0
    assert "\n\n".join(r.content for r in got[:-1]) == text[4:].split("\n## B")[0]


def test_repeated_empty_noise_goes(spark):
    got = rows(sections.build_sections(md(spark, "# Содержание\n# X\na\n# Содержание\n# Содержание\nfull")))
    assert [r.heading for r in got] == ["Содержание", "X", "Содержание"] and got[2].content == "full"


@pytest.mark.parametrize("most", [100, 1000])
def test_parts_lose_nothing(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice(["word ", "\n", "\n\n", "\n# Head\n", "x" * 150]) for _ in range(200)), "y" * 2500, "short", ""]
    parts = sections.split_parts(md(spark, *texts), most=most)
    assert all(len(r.content) <= most for r in parts.collect())
    assert {r.doc_id: r.content for r in sections.read_parts(parts).collect()} == dict(enumerate(texts))
    assert {r.content for r in sections.read_parts(parts, [1]).where("doc_id = 1").collect()} == {"y" * most}


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 9)])
def test_chunks_equal_a_loop(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 4, 5, 7, 10, 11, 40)]
    got = {}
    for r in sections.chunks(md(spark, *texts), size, overlap, ("doc_id",), "md").collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = (r.text, r.token_count)
    for d, text in enumerate(texts):
        toks, want, at = text.split(), [], 0
        while toks and True:
            want.append((" ".join(toks[at : at + size]), len(toks[at : at + size])))
            if at + size >= len(toks):
                break
            at += max(1, size - overlap)
        assert [got[d][i] for i in sorted(got.get(d, {}))] == want


def test_subtree(spark):
    found = sections.build_sections(md(spark, "# A\na\n## B\nb\n### C\nc\n## D\n# E\ne"))
    got = {r.root_index: r.markdown for r in sections.subtree_markdown(found).collect()}
    assert got[0] == "# A\n\na\n\n## B\n\nb\n\n### C\n\nc\n\n## D" and got[1] == "## B\n\nb\n\n### C\n\nc" and got[4] == "# E\n\ne"


def test_verify(spark):
    pairs = [("Pump 11 kW and tank", "Pump 11 kW and tank"), ("Pump 11 kW and tank", "Pump kW and tank"), ("", "x"), ("water tank", "water tank 漢"), ("1,5 one", "1.5 one")]
    got = verify.verify(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, source string, output string"), target_language="en").orderBy("i").collect()
    assert [(r.passed, r.clean, r.numbers_ok) for r in got] == [(True, True, True), (False, True, False), (True, True, True), (False, False, True), (True, True, True)]
    assert got[1].missing_numbers == ["11"] and got[1].score == 0.7 and got[3].score == 0.8


def test_ingest_with_and_without_a_model(spark):
    from dataclasses import replace

    from heronkb.config import DEFAULT, Hooks

    text = "The Centrifugal Pump NTs-100 moves 36000 litres of water from the lower tank to the upper tank every single day."
    pages = spark.createDataFrame([(1, "pump.txt", 1, text), (1, "pump.txt", 2, "# Second\nmore words here"), (2, "b.md", 1, None)], "doc_id bigint, filename string, page_number int, text string")
    plain = ingest.ingest(pages)
    docs = {r.doc_id: r for r in plain["documents"].collect()}
    assert docs[1].title == "pump" and docs[1].faithfulness == 1.0 and docs[1].language == "en" and docs[2].md == "\n"
    assert {r.norm for r in plain["entities"].collect()} >= {"nts-100"}
    assert all(len(r.embedding) == 256 for r in plain["chunks"].collect())
    for answer, kept in ((lambda xs: ["# Pump\n\n" + x for x in xs], "# Pump"), (lambda xs: ["gone" for _ in xs], "The Centrifugal"), (lambda xs: 1 / 0, "The Centrifugal")):
        told = ingest.structure(pages.withColumn("text", F.repeat("text", F.lit(3))).drop("filename"), replace(DEFAULT, hooks=Hooks(rewrite=answer)))
        assert told.where("doc_id = 1 and page_number = 1").first().md.startswith(kept)


def test_lookup_by_heading(spark):
    exact, near = sections.section_by_heading(sections.split_sections(md(spark, "# The Pump\na\n# the pump\nb\n# Pumps of 100% use\nc")), "THE PUMP")
    assert [r.content for r in exact.collect()] == ["a"] and len(near.collect()) == 2
    _, near = sections.section_by_heading(sections.split_sections(md(spark, "# Pumps of 100% use\nc\n# 1000 use")), "100%")
    assert [r.heading for r in near.collect()] == ["Pumps of 100% use"]
