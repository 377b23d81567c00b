"""Editing and versions without updates in place.

A section table is (doc_id, section_id, parent_id, order_key, level, heading, content, rev, manually_edited).
An edit returns the new table, its order keys numbered anew; ``log`` rows are appended by the caller and ``latest`` is the state. An edit
is a small DataFrame of requests, so many documents are edited in one job. Chunks, parts and indexes are
always derived from the latest sections and can't go stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import heading_key, strip

DEPTH = 50


class Conflict(ValueError):
    """A request was made against a revision that is no longer the latest."""


def latest(log: DataFrame, key: list[str], version: str = "rev") -> DataFrame:
    """The last row of each key: one aggregate with map-side combine, no sort."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("row")).select(*key, "row.*")


def next_version(log: DataFrame, key: list[str], version: str = "version_no") -> DataFrame:
    return log.groupBy(*key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def resequence(sections: DataFrame) -> DataFrame:
    """Adds order_index and breadcrumb by pre-order walk: rows sort by the order keys on their way from the root.

    The way up is followed at most 50 steps in a map of the document's sections.
    """
    doc = W.partitionBy("doc_id")
    known = F.map_from_entries(F.collect_list(F.struct("section_id", F.struct("parent_id", "order_key", "heading"))).over(doc))
    start = F.struct(F.col("section_id").alias("at"), F.array().cast("array<struct<k:double,i:bigint>>").alias("path"), F.array().cast("array<string>").alias("names"))

    def up(acc: Column, _: Column) -> Column:
        node = F.try_element_at(F.col("known"), acc["at"])
        step = F.struct(
            node["parent_id"].alias("at"),
            F.concat(F.array(F.struct(node["order_key"].cast("double").alias("k"), acc["at"].alias("i"))), acc["path"]).alias("path"),
            F.concat(F.array(node["heading"]), acc["names"]).alias("names"),
        )
        return F.when(acc["at"].isNull() | node.isNull(), acc).otherwise(step)

    walked = sections.withColumn("known", known).withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, up))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("w.path")).cast("bigint") - 1
    return walked.select(*sections.columns, place.alias("order_index"), F.array_join("w.names", " > ").alias("breadcrumb"))


def renumbered(sections: DataFrame) -> DataFrame:
    """The table with order keys 0, 1, 2, ... in the order of ``resequence``, so that a later edit finds room behind any section."""
    kind = sections.schema["order_key"].dataType
    return resequence(sections).withColumn("order_key", F.col("order_index").cast(kind)).select(*sections.columns)


def check_revisions(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (section_id, rev, ...) that are stale; null revisions are never stale."""
    return requests.alias("q").join(sections.select("section_id", F.col("rev").alias("now")), "section_id").where(F.col("q.rev") != F.col("now"))


def update(sections: DataFrame, requests: DataFrame, strict: bool = True) -> DataFrame:
    """requests: section_id, content, rev. Content replaced, revision raised, marked as edited by hand."""
    if strict and not check_revisions(sections, requests).isEmpty():
        raise Conflict("stale revision")
    new = requests.select("section_id", F.col("content").alias("new"))
    hit = F.col("new").isNotNull()
    joined = sections.join(new, "section_id", "left")
    return joined.withColumns({"content": F.coalesce("new", "content"), "rev": F.when(hit, F.col("rev") + 1).otherwise(F.col("rev")), "manually_edited": hit | F.col("manually_edited")}).select(*sections.columns)


def insert(sections: DataFrame, requests: DataFrame, at_end: bool = False) -> DataFrame:
    """requests: doc_id, section_id (new), after_id, heading, content, level.

    Behind a section, or first where ``after_id`` is null (last with ``at_end``). A deeper level makes it
    a child of the section before it, else a sibling.
    """
    before = sections.select(F.col("section_id").alias("after_id"), F.col("order_key").alias("k"), F.col("level").alias("l"), F.col("parent_id").alias("p"))
    ends = sections.groupBy("doc_id").agg(F.max("order_key").alias("last"))
    key = F.coalesce(F.col("k") + 0.5, F.col("last") + 0.5 if at_end else F.lit(-0.5))
    rows = requests.join(before, "after_id", "left").join(ends, "doc_id", "left")
    made = rows.select("doc_id", "section_id", F.when(F.col("level") > F.col("l"), F.col("after_id")).otherwise(F.col("p")).alias("parent_id"), key.alias("order_key"), "level", "heading", "content", F.lit(1).cast("bigint").alias("rev"), F.lit(True).alias("manually_edited"))
    return renumbered(sections.unionByName(made.select(*sections.columns)))


def delete(sections: DataFrame, section_ids: list[int], spare: int | None = None) -> DataFrame:
    """Without those sections and all below them, but for a section to be spared and what is below that, which come up as roots."""
    doc = W.partitionBy("doc_id")
    up = F.map_from_entries(F.collect_list(F.when(F.col("parent_id").isNotNull(), F.struct("section_id", "parent_id"))).over(doc))
    gone = F.array(*[F.lit(i).cast("bigint") for i in section_ids])
    above = lambda at: F.when(~at.eqNullSafe(F.lit(spare)), F.try_element_at(F.col("up"), at))
    step = lambda acc, _: F.struct(above(acc["at"]).alias("at"), (acc["gone"] | F.coalesce(F.array_contains(gone, acc["at"]), F.lit(False))).alias("gone"))
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), F.struct(F.col("section_id").alias("at"), F.lit(False).alias("gone")), step)
    parent = F.when((F.col("section_id") == F.lit(spare)) & F.col("parent_id").isin(section_ids), None).otherwise(F.col("parent_id"))
    return sections.withColumn("up", up).where(~walk["gone"]).withColumn("parent_id", F.col("parent_id") if spare is None else parent).select(*sections.columns)


def move(sections: DataFrame, section_id: int, new_parent: int | None, after: int | None = None) -> DataFrame:
    """Under another parent, behind a section if one is named."""
    if new_parent == section_id:
        raise ValueError("a section can't move under itself")
    if new_parent is not None and delete(sections, [section_id]).where(F.col("section_id") == new_parent).isEmpty():
        raise ValueError("a section can't move under one below itself, or one that isn't there")
    me = F.col("section_id") == section_id
    out = sections.withColumn("parent_id", F.when(me, F.lit(new_parent).cast("bigint")).otherwise(F.col("parent_id")))
    if after is None:
        return renumbered(out)
    place = F.max(F.when(F.col("section_id") == after, F.col("order_key"))).over(W.partitionBy("doc_id"))
    return renumbered(out.withColumn("order_key", F.when(me, F.coalesce(place + 0.5, "order_key")).otherwise(F.col("order_key"))))


def split(sections: DataFrame, section_id: int, at: int, new_id: int) -> DataFrame:
    """In two at a character offset, kept between 1 and the length less 1; the rest is a sibling "(continued)"."""
    me = F.col("section_id") == section_id
    cut = F.greatest(F.lit(1), F.least(F.lit(at), F.length("content") - 1))
    head = F.regexp_replace(F.substring("content", F.lit(1), cut), r"(?U)\s+$", "")
    tail = F.regexp_replace(F.substring("content", cut + 1, F.length("content")), r"(?U)^\s+", "")
    row = lambda **new: F.struct(*[(new.get(c, F.col(c))).alias(c) for c in sections.columns])
    both = F.array(row(content=head, rev=F.col("rev") + 1), row(section_id=F.lit(new_id).cast("bigint"), order_key=F.col("order_key") + 0.5, heading=F.concat("heading", F.lit(" (continued)")), content=tail, rev=F.lit(1).cast("bigint")))
    return renumbered(sections.select(F.explode(F.when(me, both).otherwise(F.array(row()))).alias("s")).select("s.*"))


def merge(sections: DataFrame, section_ids: list[int]) -> DataFrame:
    """Into the first of them by order, with a blank line between; the others go, and what is below them."""
    chosen = sections.where(F.col("section_id").isin(section_ids))
    ordered = F.array_sort(F.collect_list(F.struct("order_key", "section_id", "content")))
    made = chosen.groupBy("doc_id").agg(ordered.alias("all")).select(F.element_at("all", 1)["section_id"].alias("section_id"), F.size("all").alias("n"), strip(F.array_join(F.transform("all", lambda x: x["content"]), "\n\n")).alias("new"))
    kept = made.collect()  # the request's own sections
    if len(kept) != 1 or kept[0].n < 2:
        raise ValueError("at least two sections of one document")
    first, text = kept[0].section_id, kept[0].new
    rows = delete(sections, [i for i in section_ids if i != first], spare=first)
    me = F.col("section_id") == first
    return renumbered(rows.withColumns({"rev": F.when(me, F.col("rev") + 1).otherwise(F.col("rev")), "content": F.when(me, F.lit(text)).otherwise(F.col("content"))}).select(*sections.columns))


def diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_id, heading, status, current, incoming: a full outer join on normalised headings, the last of equals."""
    keyed = lambda df, name: df.groupBy("doc_id", heading_key(F.col("heading")).alias("key")).agg(F.max_by(F.struct("heading", "content"), "order_index").alias(name))
    both = keyed(current, "c").join(keyed(incoming, "i"), ["doc_id", "key"], "full_outer")
    status = F.when(F.col("c").isNull(), "added").when(F.col("i").isNull(), "removed").when(F.col("c.content").eqNullSafe(F.col("i.content")), "unchanged").otherwise("changed")
    return both.select("doc_id", F.coalesce("c.heading", "i.heading").alias("heading"), status.alias("status"), F.col("c.content").alias("current"), F.col("i.content").alias("incoming"))


def resolve(differences: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, heading, action, content for headings chosen as take_import; all else stays as it is."""
    taken = differences.join(choices.where("choice = 'take_import'").select("doc_id", "heading"), ["doc_id", "heading"], "left_semi")
    return taken.where("status in ('added', 'changed')").select("doc_id", "heading", F.when(F.col("status") == "added", "added").otherwise("updated").alias("action"), F.col("incoming").alias("content"))


def reimport_actions(incoming: DataFrame, stored: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What becomes of each incoming document (folder_id, filename, content_hash): new, unchanged, pending or replace."""
    old = stored.groupBy("folder_id", "filename").agg(F.min_by(F.struct(F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash"), "pipeline_version", "manual_edits"), "doc_id").alias("o"))
    both = incoming.alias("n").join(old.alias("e"), F.col("n.folder_id").eqNullSafe(F.col("e.folder_id")) & (F.col("n.filename") == F.col("e.filename")), "left")
    same = (F.col("o.old_hash") == F.col("n.content_hash")) & (F.col("o.pipeline_version") == settings.pipeline_version)
    action = F.when(F.col("o").isNull(), "new").when(same, "unchanged").when(F.col("o.manual_edits") > 0, "pending").otherwise("replace")
    return both.select("n.*", F.col("o.old_id").alias("existing_id"), action.alias("action"))


def update_documents(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: doc_id and any of title, folder_id; null leaves a field as it is. Documents not named stay."""
    fields = [c for c in ("title", "folder_id") if c in requests.columns]
    new = requests.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = docs.join(new, "doc_id", "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).select(*docs.columns)


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``doc_ids`` (doc_id)."""
    return {name: df.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for name, df in tables.items()}


def rechunked(before: DataFrame, after: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks of the sections that an edit made or changed; those of untouched sections stay valid."""
    from .sections import chunks

    old = before.select("doc_id", "section_id", F.col("heading").alias("h"), F.col("content").alias("c"))
    same = after.join(old, ["doc_id", "section_id"], "left").where(~(F.col("h").eqNullSafe(F.col("heading")) & F.col("c").eqNullSafe(F.col("content"))))
    return chunks(same, keys=("doc_id", "section_id"), content="content", size=settings.chunk_tokens, overlap=settings.chunk_overlap)


def create_versions(log: DataFrame, docs: DataFrame, state: str, as_of: Column) -> DataFrame:
    """Rows for the version log: the next number of each document in ``docs`` (doc_id, md), ``pending`` or ``current``."""
    known = next_version(log, ["doc_id"])
    return docs.join(known, "doc_id", "left").select("doc_id", F.coalesce("next_version", F.lit(1)).cast("bigint").alias("version_no"), F.lit(state).alias("state"), "md", as_of.alias("created_at"))


def discard_pending(versions: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The versions, pending ones of those documents marked as discarded."""
    named = versions.join(doc_ids.select("doc_id").distinct().withColumn("named", F.lit(True)), "doc_id", "left")
    gone = F.coalesce("named", F.lit(False)) & (F.col("state") == "pending")
    return named.withColumn("state", F.when(gone, "discarded").otherwise(F.col("state"))).select(*versions.columns)


def versions_of(log: DataFrame) -> DataFrame:
    """doc_id, version_no, state, created_at, n_chars: the list of versions, newest first inside a document."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("version_no"))).cast("bigint")
    return log.select("doc_id", "version_no", "state", "created_at", F.length("md").cast("bigint").alias("n_chars"), rank.alias("newest"))


def revisions_of(log: DataFrame) -> DataFrame:
    """doc_id, section_id, rev, author, source, ts, changed: each revision, and whether its text differs from the one before."""
    before = F.lag("content").over(W.partitionBy("doc_id", "section_id").orderBy("rev"))
    return log.select("doc_id", "section_id", "rev", "author", "source", "ts", (~before.eqNullSafe(F.col("content"))).alias("changed"))


def stale(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return docs.where(F.col("pipeline_version") != settings.pipeline_version)


def pending(versions: DataFrame) -> DataFrame:
    """The latest pending version of each document."""
    return latest(versions.where("state = 'pending'"), ["doc_id"], "version_no")


def manual_edits(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(F.count_if("manually_edited").alias("manual_edits"))
