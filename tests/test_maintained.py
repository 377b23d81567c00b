"""Views after edits equal views built anew, and untouched buckets keep their files."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronkb.operators import maintained
from heronkb.plans import views
from heronkb.operators.sections import split_sections
from heronkb.sources import commits

VIEWS = ("mentions", "entities", "edges", "chunks")


def state(spark, folder):
    return {v: Counter(map(tuple, maintained.read(spark, folder, v).collect())) for v in VIEWS}


@pytest.fixture
def folder(tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, order_index bigint, heading string, content string")


def test_edits_equal_a_rebuild_over_the_whole_table(spark, small, folder):
    found = split_sections(views.md_docs(spark, small)).select("doc_id", "order_index", "heading", "content")
    kept, fresh = folder(), folder()
    first = maintained.build(found.where("doc_id < 180"), kept)
    # Some documents get new texts, some go, some come, and one section is named though it stays.
    changed = found.where("doc_id between 20 and 24")
    after = changed.withColumn("content", F.concat("content", F.lit(" New Entity NTs-100 and The API"))).where("order_index <> 1")
    gone, came = found.where("doc_id in (40, 41)"), found.where("doc_id >= 180")
    same = found.where("doc_id = 60")
    maintained.apply(changed.unionByName(gone).unionByName(same), after.unionByName(came).unionByName(same), kept)
    now = found.where("doc_id not between 20 and 24 and doc_id not in (40, 41)").unionByName(after)
    maintained.build(now, fresh)
    assert state(spark, kept) == state(spark, fresh)
    # And back again.
    maintained.apply(after.unionByName(came), changed.unionByName(gone), kept)
    again = folder()
    maintained.build(found.where("doc_id < 180"), again)
    assert state(spark, kept) == state(spark, again)
    assert state(spark, kept)["entities"] == Counter(map(tuple, maintained.read(spark, kept, "entities", first).collect()))


def test_untouched_buckets_are_neither_read_nor_written(spark, folder):
    at = folder()
    base = maintained.build(made(spark, [(i, 0, "h", f"Pump Valve{i} Gear X{i}-7") for i in range(200)]), at)
    one = made(spark, [(5, 0, "h", "Pump Valve5 Gear X5-7")])
    after = maintained.apply(one, made(spark, [(5, 0, "h", "Pump Valve5 Gear")]), at)
    moved = {n for n in set(base.parts) | set(after.parts) if base.parts.get(n) != after.parts.get(n)}
    # One document with three entities at most on either side: a bucket for each of them, and for each edge that went or came.
    assert 0 < len(moved) <= 14 < len(base.parts) / 5 and all(base.parts[n] == after.parts[n] for n in base.parts if n not in moved)
    known = maintained.read(spark, at, "entities", after, [3])
    assert {f.rsplit("/", 1)[0] for f in known.inputFiles()} <= {after.parts.get("entities-3", "").replace("file:///", "file:/"), after.parts.get("entities-3")}
    assert maintained.entity(spark, at, "x5-7").count() == 0 and maintained.entity(spark, at, "x6-7").first().mention_count == 1


def test_a_name_whose_first_mention_went_is_found_again(spark, folder):
    at = folder()
    rows = [(1, 0, "", "Blue Pump"), (2, 0, "", "BLUE Pump"), (3, 0, "", "Blue PUMP")]
    maintained.build(made(spark, rows), at)
    assert maintained.entity(spark, at, "blue pump").first()[1:4] == ("Blue Pump", "concept", 3)
    maintained.apply(made(spark, rows[:1]), made(spark, []), at)
    assert maintained.entity(spark, at, "blue pump").first()[1:4] == ("BLUE Pump", "concept", 2)
    maintained.apply(made(spark, rows[1:]), made(spark, []), at)
    assert all(not c for c in state(spark, at).values())


def test_repeated_and_null_sections(spark, folder):
    at, fresh = folder(), folder()
    rows = [(1, 0, "Same Text", "Twice Told"), (1, 0, "Same Text", "Twice Told"), (None, None, None, None), (2, 1, None, "A B12")]
    maintained.build(made(spark, rows), at)
    maintained.apply(made(spark, rows[:1]), made(spark, [(3, 0, "", None)]), at)
    maintained.build(made(spark, [*rows[1:], (3, 0, "", None)]), fresh)
    assert state(spark, at) == state(spark, fresh)


def test_an_edit_of_a_state_that_moved_on_is_refused(spark, folder, monkeypatch):
    at = folder()
    base = maintained.build(made(spark, [(1, 0, "", "Blue Pump"), (2, 0, "", "Red Gear")]), at)
    maintained.apply(made(spark, [(1, 0, "", "Blue Pump")]), made(spark, []), at)
    monkeypatch.setattr(commits, "snapshot", lambda spark, folder, version=None, real=commits.snapshot, first=[True]: base if first and first.pop() else real(spark, folder, version))
    with pytest.raises(commits.Conflict):
        maintained.apply(made(spark, [(1, 0, "", "Blue Pump")]), made(spark, [(1, 0, "", "Blue Pump and Red Gear")]), at)
