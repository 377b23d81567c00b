"""Phrases against plain counting; suffix arrays against sorted suffixes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from heronkb.llm import collocations as co


def brute(rows, least=10, longest=3, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in able.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        rows_ = []
        for p, a in able.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        rows_.sort()
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(rows_[:top])]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in co.digest(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs, least=4) == brute([(r.lang, r.text) for r in docs.collect()], least=4)


@pytest.mark.parametrize(("block", "bits"), [(1_500_000, 27), (40, 27), (7, 8)])
def test_odd_texts_small_blocks_and_a_full_filter(spark, block, bits):
    """Blocks of a few words and a filter that lets nearly all pass change no count."""
    rng = random.Random(5)
    words = ["a", "B", "ß", "\x00", "\x1c", "der", "new york", "New", "York", "é x", "x.y", "?", "\x0b", "\t"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", "..."), ("de", " "), ("en", "same line here " * 400), ("xx", "only once")] + [("en", "twice told tale")] * 30
    docs = spark.createDataFrame([(1, *r, 0) for r in rows], "doc_id bigint, lang string, text string, rank int").repartition(2)
    for longest in (3, 4) if block == 40 else (3,):
        if longest == 3:
            assert found(docs, block_words=block, filter_bits=bits) == brute(rows)
        else:
            counts = {(r.lang, r.phrase): r.f for r in co.frequent(docs, longest=4, block_words=block).where("n_words = 4").collect()}
            whole = Counter()
            for lang, text in rows:
                for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
                    ws = re.findall("[^\x20\x09]+", piece)
                    whole.update(("und" if lang is None else lang, " ".join(ws[i : i + 4])) for i in range(len(ws) - 3))
            assert counts == {k: n for k, n in whole.items() if n >= 10}


def test_suffixes_are_sorted_and_intervals_count():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 4, 5):
        x = rng.integers(0, 4, 300).astype(np.int32)
        padded = np.concatenate([x, np.zeros(16, np.int32)])
        order = co.suffixes(padded, np.arange(300), depth)
        keys = [tuple(padded[i : i + depth]) for i in order]
        assert keys == sorted(keys)
        first, counts = co.intervals(padded, order, depth)
        assert {tuple(padded[i : i + depth]): n for i, n in zip(first, counts)} == Counter(keys)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(3_037_000_507, 9_000_000_000_000, 8_000_000_000_001), (10**13, 10**13, 10**13), (10, 10, 1000)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", co.score().alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_best_of_many_tiers(spark):
    rows = [("en", f"p{i}", i % 50, i % 7) for i in range(5000)] + [("de", "einzig", 1, 1)]
    docs = spark.createDataFrame(rows, "lang string, phrase string, score bigint, a bigint")
    got = [(r.lang, r.rank, r.phrase) for r in co.best(docs, 100).orderBy("lang", "rank").collect()]
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[2], -r[3], r[1]))[:100]
    assert got == [("de", 1, "einzig")] + [("en", i + 1, r[1]) for i, r in enumerate(want)]


def test_empty_table(spark):
    assert co.digest(spark.createDataFrame([], "lang string, text string")).count() == 0
