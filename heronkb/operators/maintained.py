"""Views that follow edits: mentions, entities, edges and chunks are kept in buckets, of which an edit rewrites those it touches.

An edit is what the sections of the changed documents were and what they are. Both sides are turned into rows with a sign, equal
rows of the two cancel, and what is left says which buckets of each view change: mentions, entities and edges by norm, chunks
by document. Touched buckets are read, summed with the signed rows and written anew; entities come from the new
mentions of their bucket, so that a name whose first mention went is found again. All is one commit: readers see
the views of one state, two edits that touch a bucket can't both win, and other buckets are neither read nor written.

Edge cases: an edit may add documents (nothing before) or remove them (nothing after); sections are told apart by doc_id and
order_index, which may be null; sections that stay the same may be named or left out.

Scale: work is in proportion to the touched buckets. An edit's signed rows are written once, since several views need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from . import graph, sections

BUCKETS = 64
KEYS = ("doc_id", "order_index")
SCHEMAS = {
    "mentions": "doc_id bigint, order_index bigint, position bigint, norm string, name string, kind string, bucket int",
    "entities": "norm string, name string, kind string, mention_count bigint, bucket int",
    "edges": "norm_a string, norm_b string, weight bigint, bucket int",
    "chunks": "doc_id bigint, order_index bigint, ordinal bigint, text string, token_count bigint, bucket int",
}


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def _derived(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of the views that come straight from sections (doc_id, order_index, heading, content)."""
    units = rows.select(F.col("doc_id").cast("bigint"), F.col("order_index").cast("bigint"), "content", F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"))
    return {
        "mentions": graph.mentions(units, KEYS).withColumn("bucket", _bucket(F.col("norm"))),
        "edges": graph.edges(units).withColumn("bucket", _bucket(F.col("norm_a"))),
        "chunks": sections.chunks(units.drop("text")).withColumn("bucket", _bucket(F.col("doc_id"))),
    }


def _summed(rows: DataFrame, view: str) -> DataFrame:
    """Rows with their signs, or weights, summed; what cancels goes."""
    amount = "weight" if view == "edges" else "sign"
    keys = [c for c in rows.columns if c not in (amount, "sign")]
    out = rows.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("sign") if view == "edges" else F.col("sign")).alias(amount))
    return out.where(F.col(amount) != 0)


def _plain(view: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[view].split(", ")]


def _parts(at: commits.Snapshot, view: str) -> dict[int, str]:
    return {int(n.partition("-")[2]): n for n in at.parts if n.startswith(f"{view}-")}


def apply(before: DataFrame, after: DataFrame, folder: str) -> commits.Snapshot:
    """The views after an edit that turned the sections ``before`` into ``after`` (doc_id, order_index, heading, content)."""
    spark, base = after.sparkSession, commits.snapshot(after.sparkSession, folder)
    old, new, changes = _derived(before), _derived(after), {}
    for view in ("mentions", "edges", "chunks"):
        signed = new[view].withColumn("sign", F.lit(1)).unionByName(old[view].withColumn("sign", F.lit(-1)))
        at = commits.place(folder, "deltas")
        _summed(signed, view).write.parquet(at)
        delta = spark.read.parquet(at)
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())  # BUCKETS at most
        if not touched:
            continue
        known = read(spark, folder, view, base, touched)
        amount = "weight" if view == "edges" else "sign"
        both = (known if view == "edges" else known.withColumn("sign", F.lit(1).cast("bigint"))).select(*delta.columns).unionByName(delta)
        keys = [c for c in delta.columns if c != amount]
        total = both.groupBy(*keys).agg(F.sum(amount).alias(amount)).where(F.col(amount) > 0)
        # Equal rows, as repeated sections give, stay as many as they are.
        rows = total if view == "edges" else total.select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), "sign"))).drop("col")
        staged = commits.stage(rows.select(*_plain(view)), folder, "bucket")
        changes |= {f"{view}-{b}": staged.get(str(b)) for b in touched}
        if view == "mentions":
            live = [p for p in staged.values()]
            found = spark.read.schema(SCHEMAS["mentions"]).parquet(*live) if live else spark.createDataFrame([], SCHEMAS["mentions"])
            named = commits.stage(graph.entities(found, KEYS).withColumn("bucket", _bucket(F.col("norm"))), folder, "bucket")
            changes |= {f"entities-{b}": named.get(str(b)) for b in touched}
    return commits.commit(spark, folder, base, changes)


def build(found: DataFrame, folder: str) -> commits.Snapshot:
    """The views of all sections, into a new folder."""
    return apply(found.limit(0), found, folder)


def read(spark: SparkSession, folder: str, view: str, at: commits.Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A view as of a snapshot; of ``buckets`` only those files are opened."""
    at = at or commits.snapshot(spark, folder)
    parts = _parts(at, view)
    wanted = [n for b, n in parts.items() if buckets is None or b in buckets]
    return commits.read(spark, folder, SCHEMAS[view], at, wanted)


def entity(spark: SparkSession, folder: str, norm: str, at: commits.Snapshot | None = None) -> DataFrame:
    """One entity, from its bucket alone."""
    bucket = spark.range(1).select(_bucket(F.lit(norm))).first()[0]
    return read(spark, folder, "entities", at, [bucket]).where(F.col("norm") == norm)
