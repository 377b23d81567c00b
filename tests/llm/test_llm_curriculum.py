"""The curriculum against a plain calculation, numeric integration and hot keys."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from heronkb.llm import curriculum

WORD = re.compile("[^\x20\x09-\x0d]+")


def shared_out(sizes, weights, most):
    """Targets by sharing out again and again, until none is above its bound."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        out = [Fraction(most * s) if i in full else Fraction(left) * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i, s in enumerate(sizes) if i not in full and out[i] > most * s}
        if not above:
            return out
        full |= above


def plain(rows, most=3):
    """{(doc_id, size): sorted words taken} and {source: (size, target)}."""
    by_source = defaultdict(list)
    for key, text, source in rows:
        digest = hashlib.md5(f"{'' if key is None else key}|{text or ''}".encode()).hexdigest()
        by_source[source].append((int(digest[:15], 16), -1 if key is None else key, len(WORD.findall(text or "")), key))
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[2] for r in by_source[s]) for s in names]
    goals = shared_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], most)
    taken = defaultdict(list)
    for name, size, goal in zip(names, sizes, goals):
        left = int(goal)
        line = sorted(by_source[name], key=lambda r: r[:3])
        amounts = [0] * len(line)
        while left and size:
            for i, r in enumerate(line):
                n = min(left, r[2])
                amounts[i] += n
                left -= n
        for r, n in zip(line, amounts):
            taken[r[3], r[2]].append(n)
    return {k: sorted(v) for k, v in taken.items()}, dict(zip(names, zip(sizes, goals)))


def check(spark, rows, most=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, source string, size int, taken string")
    found, (taken, goals) = curriculum.mix(docs, most=most).collect(), plain(rows, most)
    got = defaultdict(list)
    for r in found:
        got[r.doc_id, r.size].append(r.taken)
        assert r.source_size == goals[r.source][0] and r.target == pytest.approx(float(goals[r.source][1]), rel=1e-12)
        assert r.taken == sum(t.words for t in r.takes) <= most * r.size
    assert {k: sorted(v) for k, v in got.items()} == taken
    return found


def test_whole_table_against_plain_calculation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(i if i % 5 else None, None if i % 11 == 0 else " \t\x0b".join(["w"] * (i % 17)), [None, "a", "é", "", "z"][i % 5]) for i in range(300)]
    rows += [(7, "same text", "a")] * 9 + [(8, "w " * 3000, "tiny"), (None, None, None), (9, "", "nothing in it")]
    check(spark, rows)
    check(spark, [(1, "", "a"), (2, None, "b")])
    assert curriculum.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_nearly_all_rows_equal(spark):
    rows = [(5, "five words are in here", "hot")] * 9_500 + [(i, "two words", "b") for i in range(300)] + [(i, "w " * i, "c") for i in range(200)]
    check(spark, rows)


def test_positions_invert_the_integral(spark):
    for schedule in (*curriculum.SCHEDULES, ((0, 0), (0.3, 2), (0.3 + 2**-20, 0), (0.6, 0), (1, 5))):
        found = spark.range(0, 1000).select((F.col("id") / 1000).alias("share")).withColumn("at", curriculum.position(F.col("share"), schedule)).collect()
        for r in found:
            upto = [(t, w) for t, w in schedule if t < r.at]
            after = next((t, w) for t, w in schedule if t >= r.at)
            if upto:
                (s, v), (t, w) = upto[-1], after
                upto.append((r.at, v + (w - v) * (r.at - s) / (t - s)))
            area = sum((t - s) * (v + w) / 2 for (s, v), (t, w) in zip(upto, upto[1:]))
            assert area == pytest.approx(r.share * curriculum.integral(schedule), abs=1e-9)
    for wrong in (((0, 1), (0.5, 1)), ((0, -1), (1, 3)), ((0, 0), (1, 0)), ((0, 1), (0, 2), (1, 1))):
        with pytest.raises(ValueError):
            curriculum.position(F.lit(0.5), wrong)


def test_mix_follows_the_schedules_over_time(spark):
    """In each tenth of training, a source's share of words is what its schedule says."""
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(6_000)]
    mixed = curriculum.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    order = curriculum.training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == pytest.approx(60_000, abs=3)
    for source, schedule in zip("abc", curriculum.SCHEDULES):
        own = [r for r in order if r.source == source]
        total = sum(r.words for r in own)
        for tenth in range(10):
            part = sum(r.words for r in own if tenth / 10 <= r.position < (tenth + 1) / 10)
            spots = [tenth / 10 + (k + 0.5) / 1000 for k in range(100)]
            weight = 0.0
            for x in spots:
                (s, v), (t, w) = next(z for z in zip(schedule, schedule[1:]) if z[0][0] <= x <= z[1][0])
                weight += (v + (w - v) * (x - s) / (t - s)) / 1000
            assert part == pytest.approx(total * weight / curriculum.integral(schedule), abs=25)


def test_rerun_agrees_under_another_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda d: sorted(map(str, curriculum.mix(d).collect()))
    assert rows(docs) == rows(docs.repartition(7, "n_chars"))
