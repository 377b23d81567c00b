"""The queue, the outbox and the logs. Changes come as DataFrames and return new tables, so that a step run twice gives the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .upkeep import merge_payload

DETAIL_CHARS = 1000


def create(requests: DataFrame, as_of: Column) -> DataFrame:
    """Queued jobs for requests (job_id, doc_id, payload)."""
    return requests.select("job_id", "doc_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), "payload", as_of.alias("updated_at"))


def claim(jobs: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """The n queued jobs of the least ids, as running. One claimer at a time, such as a stream's batch."""
    return jobs.where("status = 'queued'").orderBy("job_id").limit(n).withColumns({"status": F.lit("running"), "updated_at": as_of})


def apply(jobs: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """All jobs after changes (job_id, and any of status, attempts, payload, one row a job): a null leaves a field as it is, payloads merge."""
    fields = [c for c in ("status", "attempts", "payload") if c in changes.columns]
    new = changes.select("job_id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in fields])
    merged = lambda c: F.when(F.col("new_payload").isNull(), F.col("payload")).otherwise(merge_payload(F.col("payload"), F.col("new_payload"))) if c == "payload" else F.coalesce(f"new_{c}", c)
    return jobs.join(new, "job_id", "left").withColumns({c: merged(c) for c in fields} | {"updated_at": F.when(F.col("hit"), as_of).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def deliver(due: DataFrame, send: Callable[[str, str, str], bool]) -> DataFrame:
    """id, result (sent, refused or failed) of ``send(aggregate, op, payload)`` for each outbox row: true is sent, false
    refused for good; an exception is a failure, to be tried again. A lost executor sends again: at least once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    out.append("sent" if send(row.aggregate, row.op, row.payload) else "refused")
                except Exception:  # noqa: BLE001  whatever fails is tried again
                    out.append("failed")
            yield pd.DataFrame({"id": batch["id"], "result": out})

    return due.select("id", "aggregate", "op", "payload").mapInPandas(run, "id bigint, result string")


def marked(outbox: DataFrame, results: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The outbox after an attempt (id, result): done, failed for good, or pending until the attempts are used up."""
    again = F.when(F.col("attempts") < settings.outbox_max_attempts, "pending").otherwise("failed")
    status = F.when(F.col("result").isNull(), F.col("status")).when(F.col("result") == "sent", "done").when(F.col("result") == "refused", "failed").otherwise(again)
    rows = outbox.join(results.select("id", "result"), "id", "left")
    return rows.withColumns({"status": status, "attempts": F.col("attempts") + F.when(F.col("result").isNull(), 0).otherwise(1)}).select(*outbox.columns)


def audit_rows(changes: DataFrame, action: str, as_of: Column, actor: str = "") -> DataFrame:
    """Rows for the audit log from changes (workspace_id, detail); a detail is cut to 1000 characters."""
    return changes.select("workspace_id", F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.left(F.coalesce("detail", F.lit("")), F.lit(DETAIL_CHARS)).alias("detail"), as_of.alias("at"))


def revision_rows(sections: DataFrame, as_of: Column, author: str = "") -> DataFrame:
    """Rows for the revision log from edited sections."""
    return sections.select("doc_id", "section_id", "rev", F.lit(author).alias("author"), F.lit("edit").alias("source"), as_of.alias("ts"), "content")


def asset_rows(assets: DataFrame) -> DataFrame:
    """Assets (id, doc_id, kind, object_key) with what they lack: section, class, type and hash."""
    extra = {"section_id": F.lit(None).cast("bigint"), "fig_class": F.lit(None).cast("string"), "mime": F.lit(""), "sha256": F.lit("")}
    return assets.select("id", "doc_id", "kind", "object_key", *[(F.coalesce(c, v) if c in assets.columns else v).alias(c) for c, v in extra.items()])


def source_assets(assets: DataFrame) -> DataFrame:
    """doc_id, object_key: the stored original of each document, of several that of the least id."""
    return assets.where("kind = 'source'").groupBy("doc_id").agg(F.min_by("object_key", F.struct("id", "object_key")).alias("object_key"))


def lookup(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows of wanted keys; null finds nothing."""
    return rows.join(keys.select(by).distinct(), by, "left_semi")


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    """Those names that the catalogue of the session doesn't know."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def reindex_plan(docs: DataFrame, assets: DataFrame, stored: DataFrame, only_stale: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, object_key, state: documents to be made anew from their originals, or why one can't be.

    ``stored`` lists the object keys that the store holds. A null version is out of date.
    """
    rows = docs.where(~F.col("pipeline_version").eqNullSafe(settings.pipeline_version)) if only_stale else docs
    there = stored.select("object_key").distinct().withColumn("there", F.lit(True))
    found = rows.select("doc_id").join(source_assets(assets), "doc_id", "left").join(there, "object_key", "left")
    state = F.when(F.coalesce("object_key", F.lit("")) == "", "no stored original").when(F.col("there").isNull(), "original missing").otherwise("reindex")
    return found.select("doc_id", "object_key", state.alias("state"))
