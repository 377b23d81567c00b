"""Payloads keep their JSON types; merging takes what is below the merged sections; no section moves under itself."""

import json

import pytest
from pyspark.sql import functions as F

from heronkb.operators import editing, upkeep

COLUMNS = "doc_id bigint, section_id bigint, parent_id bigint, order_key double, level int, heading string, content string, rev bigint, manually_edited boolean"


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ('{"timings": {"extract": 12.5}, "n": 1, "ok": true}', '{"pages": 3}'),
        ('{"a": [1, {"b": null}], "s": "12", "z": null}', '{"s": 12, "a": {}}'),
        ('{"big": 12345678901234567890, "é": "ü\\n"}', '{"f": 1e-3}'),
        ("{}", "{}"),
    ],
)
def test_payload_types(spark, old, new):
    got = spark.createDataFrame([(old, new)], "x string, y string").select(upkeep.merge_payload(F.col("x"), F.col("y"))).first()[0]
    assert json.loads(got) == json.loads(old) | json.loads(new)


def test_payloads_that_are_no_objects(spark):
    rows = [("bad", '{"a":1}'), (None, '{"a":1}'), ('{"a":1}', "[1]"), ('{"a":1}', None), ("3", "4")]
    got = [json.loads(r[0]) for r in spark.createDataFrame(rows, "x string, y string").select(upkeep.merge_payload(F.col("x"), F.col("y"))).collect()]
    assert got == [{"a": 1}, {"a": 1}, {"a": 1}, {"a": 1}, {}]


def tree(spark):
    rows = [(1, 1, None, 0, "a"), (1, 2, 1, 1, "a1"), (1, 3, None, 2, "b"), (1, 4, 3, 3, "b1"), (1, 5, 4, 4, "b11"), (1, 6, None, 5, "c"), (2, 7, None, 0, "other")]
    return spark.createDataFrame([(d, s, p, float(k), 1, h, f"text {h}", 1, False) for d, s, p, k, h in rows], COLUMNS)


def test_merge_takes_what_is_below_the_others(spark):
    out = {r.section_id: r for r in editing.merge(tree(spark), [6, 1, 3]).collect()}
    assert sorted(out) == [1, 2, 7] and out[1].content == "text a\n\ntext b\n\ntext c" and out[1].rev == 2
    assert [out[i].order_key for i in (1, 2, 7)] == [0, 1, 0] and all(r.parent_id is None or r.parent_id in out for r in out.values())
    # A section that is merged into one below it by order but above it in the tree.
    out = {r.section_id: r for r in editing.merge(tree(spark), [4, 5]).collect()}
    assert sorted(out) == [1, 2, 3, 4, 6, 7] and out[4].content == "text b1\n\ntext b11"


@pytest.mark.parametrize("ids", [[1], [1, 99], [1, 7], []])
def test_merge_needs_two_sections_of_one_document(spark, ids):
    with pytest.raises(ValueError):
        editing.merge(tree(spark), ids)


def test_a_section_does_not_move_below_itself(spark):
    for target in (3, 4, 5, 99):
        with pytest.raises(ValueError):
            editing.move(tree(spark), 3, target)
    moved = {r.section_id: (r.parent_id, r.order_key) for r in editing.move(tree(spark), 4, 6).where("doc_id = 1").collect()}
    assert moved[4][0] == 6 and moved[5][0] == 4 and moved[4][1] > moved[6][1]
