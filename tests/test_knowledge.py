"""Retrieval, graph, memory, folders, editing, upkeep, files and streams."""

import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from heronkb.config import DEFAULT, Hooks
from heronkb.operators import editing, folders, graph, ingest, jobs, memory, retrieval, upkeep
from heronkb.sources import files, hooks
from heronkb.streaming import observe

TEXTS = [(1, "pumps move water in pipes"), (2, "safety rules for workers"), (3, "water safety water rules"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def asked(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id bigint, query string")


def test_bm25_by_hand(spark, docs):
    got = {r.doc_id: r.score for r in retrieval.lexical(docs, asked(spark, "water safety"), match_all=False).collect()}
    lengths = [5, 4, 4, 0, 0]
    avg = sum(lengths) / 5
    part = lambda tf, dl, df: math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {1: round(part(1, 5, 2), 6), 2: round(part(1, 4, 2), 6), 3: round(part(2, 4, 2) + part(1, 4, 2), 6)}
    assert [r.doc_id for r in retrieval.lexical(docs, asked(spark, "water safety")).collect()] == [3]
    assert retrieval.lexical(docs, asked(spark, "absent")).collect() == []


def test_fusion_prefers_what_both_found(spark):
    a = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (0, 3, 0.2)], "query_id bigint, doc_id bigint, score double")
    b = spark.createDataFrame([(0, 2, 0.8), (0, 4, 0.7), (0, 1, 0.1)], "query_id bigint, doc_id bigint, score double")
    best = retrieval.top(retrieval.fuse([retrieval.top(a, 3), retrieval.top(b, 3)]), 2).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [2, 1]


def test_modes_and_rerank(spark, docs):
    vectors = docs.select("doc_id", retrieval.hash_embedding(F.col("text")).alias("embedding"))
    q = asked(spark, "water pumps")
    qv = q.select("query_id", retrieval.hash_embedding(F.col("query")).alias("q"))
    assert retrieval.hybrid(docs, q, 1, mode="vector", vectors=vectors, query_vectors=qv).first().doc_id == 1
    back = retrieval.hybrid(docs, asked(spark, "rules"), 2, mode="bm25", hooks=Hooks(rerank=lambda _, xs: [float(len(x)) for x in xs])).orderBy("rank").collect()
    assert [r.doc_id for r in back] == [2, 3] or [r.doc_id for r in back] == [3, 2]
    assert back[0].doc_id == 2 or len(TEXTS[2][1]) >= len(TEXTS[1][1])


def test_injected_embedder(spark, docs):
    out = retrieval.embed(docs, hooks=Hooks(embed=lambda xs: [[float(len(x)), 1.0] for x in xs])).collect()
    assert {r.doc_id: r.embedding[0] for r in out}[2] == 24.0


def test_evaluation_caps_recall(spark):
    hits = spark.createDataFrame([(0, "Alpha one"), (0, "alpha two"), (0, "beta")], "query_id bigint, title string")
    golden = spark.createDataFrame([(0, "alpha"), (1, "gone")], "query_id bigint, relevant string")
    got = {r.query_id: (r.hits, r.returned, r.recall, round(r.precision, 3)) for r in retrieval.evaluate(hits, golden).collect()}
    assert got == {0: (2, 3, 1.0, 0.667), 1: (0, 0, 0.0, 0.0)}


def test_entities(spark):
    rows = spark.createDataFrame([(1, "Centrifugal Pump NTs-100 runs at 0.7 MPa. The API is open. Centrifugal Pump again"), (2, "API and Centrifugal Pump"), (3, None)], "doc_id bigint, text string")
    found = graph.mentions(rows)
    assert {(r.norm, r.kind) for r in found.where("doc_id = 1").collect()} >= {("nts-100", "code"), ("api", "acronym")}
    known = {r.norm: r.mention_count for r in graph.entities(found).collect()}
    assert known["api"] == 2
    pairs = {(r.norm_a, r.norm_b): r.weight for r in graph.edges(rows).collect()}
    assert all(a < b for a, b in pairs)
    assert [r.norm for r in graph.neighbours(graph.edges(rows), graph.entities(found), "api").collect()]
    assert {r.doc_id for r in graph.stream(found, asked(spark, "the pump of")).collect()} == {1, 2}


def log(spark, rows):
    return spark.createDataFrame(rows, "mem_id bigint, agent_id string, scope string, tier string, mkey string, title string, content string, importance double, created_at timestamp, last_accessed_at timestamp").withColumn("content_hash", F.sha2("content", 256))


def at(day, s=0):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, seconds=s)


def test_supersession_and_visibility(spark):
    rows = log(spark, [(1, "a", "shared", "semantic", "k", "", "old", 1.0, at(0), at(0)), (2, "a", "shared", "semantic", "k", "", "new", 1.0, at(1), at(1)), (3, "b", "agent", "semantic", "", "", "own", 1.0, at(2), at(2)), (4, "a", "agent", "semantic", "", "", "mine", 1.0, at(3), at(3))])
    assert {r.mem_id: r.superseded_by for r in memory.with_supersession(rows).collect()} == {1: 2, 2: None, 3: None, 4: None}
    assert [r.mem_id for r in memory.list_memory(rows, "a").collect()] == [4, 2]
    assert [r.mem_id for r in memory.list_memory(rows, "b", superseded=True).collect()] == [3, 2, 1]


def test_fading_and_cap(spark):
    rows = log(spark, [(1, "a", "shared", "working", "", "", "x", 0.3, at(0), at(0)), (2, "a", "shared", "semantic", "", "", "y", 0.3, at(0), at(0)), *[(10 + i, "a", "shared", "working", "", "", f"w{i}", 5.0, at(119, i // 2), at(119)) for i in range(6)]])
    gone = {r.mem_id: r.reason for r in memory.evictions(rows, F.lit("2024-04-30").cast("timestamp"), replace(DEFAULT, memory_working_cap=3)).collect()}
    assert gone == {1: "decayed below importance floor", 10: "working buffer over cap", 11: "working buffer over cap", 12: "working buffer over cap", 13: "working buffer over cap"}


def test_observe_consolidate_and_facts(spark):
    turns = spark.createDataFrame([(1, "a", 9, "same", at(0)), (2, "a", 9, "same", at(1)), (3, "a", 9, "key AKIA" + "B" * 16, at(2)), (4, "a", 9, "  ", at(3))], "mem_id bigint, agent_id string, session_id bigint, content string, created_at timestamp")
    working = memory.observe(turns)
    assert sorted(r.mem_id for r in working.collect()) == [1, 3]
    raw = memory.consolidate(working).first()
    assert raw.content == "## Session notes\n\n- same\n- key [redacted:aws-key]\n" and raw.facts == [] and raw.consolidated == 2
    told = memory.consolidate(working, Hooks(rewrite=lambda xs: ["## Summary\n- no\n## Key facts\n- one\n* two\n- (none)\n## Other\n- no" for _ in xs])).first()
    assert told.facts == ["one", "two"] and told.content.startswith("## Summary")
    assert memory.consolidate(working.limit(0)).collect() == []


def test_recall_reinforces(spark):
    rows = log(spark, [(1, "a", "shared", "semantic", "", "Pump", "about water", 9.95, at(0), at(0)), (2, "a", "shared", "semantic", "", "", "about fire", 1.0, at(0), at(0))])
    hits = memory.recall(rows, asked(spark, "pump fire"), "a")
    assert {r.mem_id for r in hits.collect()} == {1, 2}
    assert {r.mem_id: r.importance for r in memory.reinforced(hits, rows, F.lit("2024-02-01").cast("timestamp")).collect()} == {1: 10.0, 2: 1.1}
    kept, gone = memory.forget(rows, [1], "wrong")
    assert [r.mem_id for r in kept.collect()] == [2] and memory.audit(gone, "forget", F.lit("2024-02-01").cast("timestamp")).first().reason == "wrong"
    assert memory.remember(rows.limit(1).withColumn("content", F.lit("<private>x</private>y"))).first().content == "y"


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(1, None, "a", "A", ""), (2, 1, "a.b", "B", "note"), (3, None, "ab", "AB", "")], "folder_id bigint, parent_id bigint, path string, name string, description string")


def test_folders(spark, tree):
    filed = spark.createDataFrame([(1, 2, "t"), (2, 2, "s"), (3, None, "u")], "doc_id bigint, folder_id bigint, title string")
    counted = folders.with_counts(tree, filed)
    assert {r.path: (r.document_count, r.subtree_count) for r in counted.collect()} == {"a": (0, 2), "a.b": (2, 2), "ab": (0, 0)}
    assert folders.atlas_index(counted).first().markdown == "# Knowledge base Atlas\n\n## A — _documents: 0_\n  - B — _documents: 2_\n    note\n## AB — _documents: 0_\n"
    assert {r.path: r.has_children for r in folders.children(tree, None).collect()} == {"a": True, "ab": False}
    for root in ("a", "a.b"):
        with pytest.raises(ValueError):
            folders.delete_subtree(tree, filed, root)
    assert [r.path for r in folders.pre_order(folders.delete_subtree(tree, filed, "ab")).collect()] == ["a", "a.b"]
    with pytest.raises(ValueError):
        folders.move_subtree(tree, "a", "a.b.c")
    wanted = spark.createDataFrame([("A/B/New one",), ("A//Other",), ("",)], "path string")
    assert {(r.path, r.name, r.parent_path) for r in folders.ensure_paths(wanted, tree).collect()} == {("a.b.new_one", "New one", "a.b"), ("a.other", "Other", "a")}
    same = spark.createDataFrame([("p", "X", "x", 1), ("p", "x", "x", 2)], "parent_path string, name string, label string, created_at int")
    assert sorted(r.label for r in folders.numbered_labels(same).collect()) == ["x", "x_2"]


STATE = "doc_id bigint, section_id bigint, parent_id bigint, order_key double, level int, heading string, content string, rev bigint, manually_edited boolean"


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame([(1, 1, None, 0.0, 1, "A", "first half", 1, False), (1, 2, 1, 1.0, 2, "B", "b", 1, False), (1, 3, 2, 2.0, 3, "C", "c", 1, False), (1, 4, None, 3.0, 1, "D", "d", 3, True)], STATE)


def order(df):
    return [(r.heading, r.breadcrumb) for r in editing.resequence(df).orderBy("order_index").collect()]


def test_edits(spark, state):
    assert order(state) == [("A", "A"), ("B", "A > B"), ("C", "A > B > C"), ("D", "D")]
    new = editing.update(state, spark.createDataFrame([(2, "B!", 1)], "section_id bigint, content string, rev bigint"))
    assert new.where("section_id = 2").select("content", "rev", "manually_edited").first() == ("B!", 2, True)
    with pytest.raises(editing.Conflict):
        editing.update(state, spark.createDataFrame([(4, "x", 2)], "section_id bigint, content string, rev bigint"))
    put = spark.createDataFrame([(1, 9, 1, "N", "n", 2), (1, 8, None, "Z", "z", 1)], "doc_id bigint, section_id bigint, after_id bigint, heading string, content string, level int")
    assert order(editing.insert(state, put)) == [("Z", "Z"), ("A", "A"), ("N", "A > N"), ("B", "A > B"), ("C", "A > B > C"), ("D", "D")]
    assert order(editing.insert(state, put.where("section_id = 8"), at_end=True))[-1] == ("Z", "Z")
    assert order(editing.delete(state, [2])) == [("A", "A"), ("D", "D")]
    assert order(editing.move(state, 2, 4)) == [("A", "A"), ("D", "D"), ("B", "D > B"), ("C", "D > B > C")]
    with pytest.raises(ValueError):
        editing.move(state, 2, 2)
    cut = editing.split(state, 1, 6, 7)
    assert {r.section_id: r.content for r in cut.where("section_id in (1, 7)").collect()} == {1: "first", 7: "half"}
    assert [h for h, _ in order(cut)] == ["A", "B", "C", "A (continued)", "D"]
    whole = editing.merge(cut, [1, 7])
    assert whole.where("section_id = 1").first().content == "first\n\nhalf" and whole.where("section_id = 7").count() == 0


def test_conflicts(spark):
    shape = "doc_id bigint, order_index bigint, heading string, content string"
    cur = spark.createDataFrame([(1, 0, "A", "1"), (1, 1, "b ", "2"), (1, 2, "Gone", "3"), (1, 3, "a", "last")], shape)
    inc = spark.createDataFrame([(1, 0, "A", "last"), (1, 1, "B", "2!"), (1, 2, "New", "4")], shape)
    found = editing.diff(cur, inc)
    assert {r.heading: r.status for r in found.collect()} == {"a": "unchanged", "b ": "changed", "Gone": "removed", "New": "added"}
    choices = spark.createDataFrame([(1, "b ", "take_import"), (1, "New", "take_import"), (1, "Gone", "take_import"), (1, "a", "keep_manual")], "doc_id bigint, heading string, choice string")
    assert {(r.heading, r.action) for r in editing.resolve(found, choices).collect()} == {("b ", "updated"), ("New", "added")}


def test_reimport(spark):
    stored = spark.createDataFrame([(1, None, "f", "h", "v1", 0), (2, 3, "g", "h", "v0", 0), (3, 3, "m", "h", "v1", 2)], "doc_id bigint, folder_id bigint, filename string, content_hash string, pipeline_version string, manual_edits bigint")
    new = spark.createDataFrame([(None, "f", "h"), (None, "f2", "h"), (3, "g", "h"), (3, "m", "x")], "folder_id bigint, filename string, content_hash string")
    assert {r.filename: r.action for r in editing.reimport_actions(new, stored).collect()} == {"f": "unchanged", "f2": "new", "g": "replace", "m": "pending"}
    versions = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending"), (1, 3, "applied")], "doc_id bigint, version_no bigint, state string")
    assert editing.pending(versions).first().version_no == 2 and editing.next_version(versions, ["doc_id"]).first().next_version == 4


def test_jobs_and_garbage(spark):
    jobs = spark.createDataFrame([(1, "running", at(0), 0), (2, "running", at(0, 150), 0), (3, "running", at(0), 2), (4, "queued", at(0), 0)], "job_id bigint, status string, updated_at timestamp, attempts int")
    now = F.lit("2024-01-01 00:03:20").cast("timestamp")
    assert {r.job_id: r.status for r in upkeep.reclaimed(jobs, now).collect()} == {1: "queued", 3: "error"}
    one = spark.createDataFrame([('{"a": "1", "b": "2"}', '{"b": "3"}'), (None, '{"c": "1"}')], "x string, y string")
    assert [r[0] for r in one.select(upkeep.merge_payload(F.col("x"), F.col("y"))).collect()] == ['{"a":"1","b":"3"}', '{"c":"1"}']
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "object_key string")
    assert {tuple(r) for r in upkeep.garbage(upkeep.live_keys(keys("a", "b", ""), keys("b", "c")), keys("b", "z")).collect()} == {("z", "orphan"), ("a", "missing"), ("c", "missing")}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Head\n\x00text")
    (tmp_path / "in/b.HTML").write_text("<p>One</p>")
    (tmp_path / "in/c.pdf").write_bytes(b"p1|p2")
    got = sorted((r.path.rsplit("/", 1)[1], r.page_number, r.text) for r in files.read_files(spark, str(tmp_path / "in"), Hooks(extract=lambda c, _: c.decode().split("|"))).collect())
    assert got == [("a.md", 1, "# Head\ntext"), ("b.HTML", 1, "One"), ("c.pdf", 1, "p1"), ("c.pdf", 2, "p2")]
    sized = spark.createDataFrame([("x", 450)], "path string, n_pages int")
    assert [(r.first_page, r.last_page) for r in files.page_ranges(sized).collect()] == [(1, 200), (201, 400), (401, 450)]
    doc = spark.createDataFrame([("My Doc", "see ![f](http://h/x/fig.png)")], "title string, md string")
    files.export(doc, str(tmp_path / "out"))
    assert (tmp_path / "out/slug=my-doc").exists() and "assets/fig.png" in spark.read.text(str(tmp_path / "out")).first().value
    files.publish({"t": doc}, str(tmp_path / "kb"), "0001")
    assert files.published(spark, str(tmp_path / "kb")) == "0001"
    (tmp_path / "g.json").write_text('[{"query": "q", "relevant_doc_titles": ["A"], "relevant_section_headings": ["B"]}]')
    assert {r.relevant for r in files.golden_set(spark, str(tmp_path / "g.json")).collect()} == {"A", "B"}


def test_naming(spark):
    rows = spark.createDataFrame([("a.b.pdf", 'ok {"title": "T", "summary": "S"}'), ("noext", "broken")], "filename string, answer string")
    assert [(r.title, r.summary) for r in hooks.metadata(rows, "answer").collect()] == [("T", "S"), ("noext", "")]
    assert [r.title for r in hooks.metadata(rows).collect()] == ["a.b", "noext"]


def test_streams_equal_the_batch(spark, small):
    turns = observe.read_stream(spark, f"{small}/conversations.parquet", observe.TURNS)
    got = observe.drain(observe.observations(turns), "test").select("agent_id", "session_id", "content_hash").collect()
    batch = spark.read.parquet(f"{small}/conversations.parquet")
    want = memory.observe(memory.turns_of(batch).select((F.col("conv_id") * 100 + F.col("turn")).alias("mem_id"), F.col("role").alias("agent_id"), F.col("conv_id").alias("session_id"), "content", F.lit("2024-01-01").cast("timestamp").alias("created_at")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("agent_id", "session_id", "content_hash").collect()))


def test_stream_state_and_batches(spark, small, tmp_path):
    turns = observe.read_stream(spark, f"{small}/conversations.parquet", observe.TURNS)
    query = observe.append_to_log(turns, str(tmp_path / "log"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(f"{small}/conversations.parquet").count()
    sizes = observe.session_sizes(turns.select(F.col("conv_id").alias("session_id"))).writeStream.outputMode("update").format("memory").queryName("sizes").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    sizes.awaitTermination()
    assert spark.table("sizes").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/conversations.parquet").count()


def test_figures_and_answers(spark):
    from heronkb.sources import figures

    rows = spark.createDataFrame([(1, 1, 0, '{"fig_class": "chart", "description": "Sales by year"}', "cap"), (1, 1, 1, '{"fig_class": "logo", "description": "x"}', ""), (1, 2, 0, "broken", None)], "doc_id bigint, page_number int, figure int, answer string, caption string")
    made = figures.with_tokens(rows).withColumns(figures.described(F.col("answer")))
    assert [(r.token, r.informative) for r in made.orderBy("page_number", "figure").collect()] == [("[[FIGURE_0000]]", True), ("[[FIGURE_0001]]", False), ("[[FIGURE_0002]]", False)]
    blocks = made.withColumn("block", figures.block(F.lit("a/b.png"), F.col("caption"), F.col("description"), F.col("informative")))
    pages = spark.createDataFrame([(1, 1, "x[[FIGURE_0000]]y[[FIGURE_0001]]z"), (1, 3, "plain")], "doc_id bigint, page_number int, md string")
    got = {r.page_number: r.md for r in figures.put_figures(pages, blocks).collect()}
    assert got == {1: "x\n\n![cap](a/b.png)\n\n> **Figure:** Sales by year\n\ny\n\nz", 3: "plain"}
    reads = spark.createDataFrame([("short", "a longer and clean text"), ("a longer and clean text", "short"), ("x", ""), (None, "new")], "a string, b string")
    assert [r[0] for r in reads.select(figures.accept_repair(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    assert spark.range(1).select(figures.answered_languages(F.lit("DE, en, zz, de"))).first()[0] == ["de", "en"]
    assert figures.prompt("to {LANG}: {X}", LANG="en", X=1) == "to en: 1"


def test_demo_is_searchable(spark):
    from heronkb.operators import ingest
    from heronkb.sources import figures

    made = ingest.ingest(figures.demo_pages(spark).drop("folder_path"))
    hits = retrieval.top(retrieval.lexical(made["documents"], asked(spark, "blade month"), text="md"), 3).collect()
    assert [r.doc_id for r in hits] == [2] and made["sections"].count() == 9
    assert {r.norm for r in made["entities"].collect()} >= {"band saw bs-7", "bs-7"}


def test_edits_follow_each_other(spark):
    state = spark.createDataFrame([(1, 1, None, 0.0, 1, "A", "a", 1, False), (1, 2, None, 1.0, 1, "B", "b", 1, False)], "doc_id bigint, section_id bigint, parent_id bigint, order_key double, level int, heading string, content string, rev bigint, manually_edited boolean")
    put = lambda i, after: spark.createDataFrame([(1, i, after, f"N{i}", "x", 1)], "doc_id bigint, section_id bigint, after_id bigint, heading string, content string, level int")
    names = lambda df: [r.heading for r in editing.resequence(df).orderBy("order_index").collect()]
    one = editing.insert(state, put(8, 1))
    assert names(editing.insert(one, put(9, 8))) == ["A", "N8", "N9", "B"]
    assert names(editing.insert(one, put(9, 1))) == ["A", "N9", "N8", "B"]
    moved = editing.move(one, 2, None, 1)
    assert names(moved) == ["A", "B", "N8"] and names(editing.move(moved, 8, None, 1)) == ["A", "N8", "B"]
    parts = editing.rechunked(one, editing.insert(one, put(9, 8)))
    assert [(r.section_id, r.text) for r in parts.collect()] == [(9, "x")]


def test_versions_go_by_number_and_are_never_replaced(spark, tmp_path):
    folder = str(tmp_path / "kb")
    assert files.published(spark, folder) is None
    for v in ("v9", "v10"):
        files.publish({"t": spark.range(3)}, folder, v)
    assert files.published(spark, folder) == "v10"
    with pytest.raises(ValueError):
        files.publish({"t": spark.range(1)}, folder, "v9")


def test_an_unknown_tier_is_refused(spark):
    rows = log(spark, [(1, "a", "shared", "imaginary", "", "", "x", 1.0, at(0), at(0))])
    with pytest.raises(Exception, match="unknown tier"):
        memory.remember(rows).collect()


def test_queue_and_outbox(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    made = jobs.create(spark.createDataFrame([(1, 7, '{"filename": "a"}'), (2, 8, None)], "job_id bigint, doc_id bigint, payload string"), now)
    assert [(r.job_id, r.status) for r in jobs.claim(made, now).collect()] == [(1, "running")]
    after = {r.job_id: r for r in jobs.apply(made, spark.createDataFrame([(1, "done", '{"pages_total": "3"}')], "job_id bigint, status string, payload string"), now).collect()}
    assert (after[1].status, after[1].payload, after[2].status, after[2].payload) == ("done", '{"filename":"a","pages_total":"3"}', "queued", None)

    def send(aggregate, op, payload):
        if payload == "down":
            raise OSError
        return payload == "ok"

    box = spark.createDataFrame([(1, "webhook", "deliver", "ok", "pending", 0), (2, "webhook", "deliver", "unsafe", "pending", 0), (3, "asset", "delete", "down", "pending", 1), (4, "asset", "delete", "down", "pending", 5), (5, "asset", "delete", "ok", "done", 1)], "id bigint, aggregate string, op string, payload string, status string, attempts int")
    due = upkeep.outbox_due(box)
    assert {r.id: (r.status, r.attempts) for r in jobs.marked(box, jobs.deliver(due, send)).collect()} == {1: ("done", 1), 2: ("failed", 1), 3: ("pending", 2), 4: ("failed", 6), 5: ("done", 1)}


def test_log_rows_and_lookups(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, "x" * 2000), (2, None)], "workspace_id bigint, detail string")
    assert [len(r.detail) for r in jobs.audit_rows(rows, "edit", now).orderBy("workspace_id").collect()] == [1000, 0]
    assets = spark.createDataFrame([(2, 1, "source", "b"), (1, 1, "source", "a"), (3, 2, "figure", "c")], "id bigint, doc_id bigint, kind string, object_key string")
    assert [tuple(r) for r in jobs.source_assets(assets).collect()] == [(1, "a")] and jobs.asset_rows(assets).where("mime = ''").count() == 3
    docs = spark.createDataFrame([(1, "v0"), (2, None), (3, "v1")], "doc_id bigint, pipeline_version string")
    plan = lambda keys, **kw: {r.doc_id: r.state for r in jobs.reindex_plan(docs, assets, spark.createDataFrame([(k,) for k in keys], "object_key string"), **kw).collect()}
    assert plan(["a"]) == {1: "reindex", 2: "no stored original"}
    assert plan(["z"], only_stale=False) == {1: "original missing", 2: "no stored original", 3: "no stored original"}
    assert {r.id for r in jobs.lookup(assets, spark.createDataFrame([("a",), ("a",), (None,)], "object_key string"), "object_key").collect()} == {1}
    assert jobs.missing_tables(spark, ["no_such_table"]) == ["no_such_table"]
    edited = spark.createDataFrame([(1, 5, 2, "text")], "doc_id bigint, section_id bigint, rev bigint, content string")
    assert jobs.revision_rows(edited, now, "me").first().author == "me"


def test_transcripts_of_one_text(spark):
    rows = spark.createDataFrame([(1, "a: hello\r\n\r\n  b: there  c"), (2, ""), (3, None)], "session_id bigint, text string")
    assert [tuple(r) for r in memory.transcript_turns(rows).orderBy("turn").collect()] == [(1, 0, "a: hello"), (1, 2, "b: there"), (1, 3, "c")]


def test_atlas_versions_and_names(spark, tree):
    held = spark.createDataFrame([(1, 1, "T", "", 2)], "doc_id bigint, folder_id bigint, title string, summary string, section_count int")
    none = spark.createDataFrame([], "scope string, content_md string, version bigint")
    pages = folders.atlas_pages(tree, held, tree.where("folder_id = 1"))
    again = folders.put_atlas(folders.put_atlas(none, pages), pages.where("scope = 'index'"))
    assert {r.scope: r.version for r in again.collect()} == {"folder:1": 1, "index": 2}
    new = folders.rename(tree, spark.createDataFrame([(1, "New")], "folder_id bigint, name string"))
    assert new.where("folder_id = 1").first().name == "New" and new.count() == tree.count()


def test_models_are_asked_again_and_the_stronger_where_the_first_fails(spark):
    calls = []

    def flaky(xs):
        calls.append(len(xs))
        if len(calls) < 3:
            raise OSError
        return list(xs)

    assert hooks.asked(flaky, ["a"], 3, 0.0, None) == ["a"] and hooks.asked(lambda xs: [], ["a"], 2, 0.0, None) == [None]
    assert hooks.asked(lambda xs: time.sleep(0.5) or xs, ["a"], 1, 0.0, 0.05) == [None]
    text = "pump 12 moves water through long pipes " * 3
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "valve " + text)], "doc_id bigint, page_number int, text string")
    settings = replace(DEFAULT, hooks=Hooks(rewrite=lambda xs: [x if x.startswith("valve") else "nothing of it" for x in xs], escalate=lambda xs: ["# P\n\n" + x for x in xs]))
    got = {r.doc_id: r.md for r in ingest.structure(pages, settings).where("route = 'rewrite'").collect()}
    assert got == {1: "# P\n\n" + text.strip(), 2: ("valve " + text).strip()}
