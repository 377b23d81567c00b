"""Duplicates, garbage, jobs, logs and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, OVERRIDABLE, Settings
from ..functions.text import let


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.col(text), 256))


def duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """content_hash, copies, ids (in order, joined by commas) of texts that occur more than once."""
    rows = docs.select("doc_id", F.sha2(F.col(text), 256).alias("content_hash"))
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.where("copies > 1").select("content_hash", "copies", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Without later copies: the least id of each text stays. Only ids and hashes are grouped; texts don't move."""
    rows = docs.select("doc_id", F.sha2(F.col(text), 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


def live_keys(*references: DataFrame) -> DataFrame:
    """Distinct object keys that any table refers to."""
    out = references[0].select("object_key")
    for more in references[1:]:
        out = out.union(more.select("object_key"))
    return out.where("object_key <> ''").distinct()


def garbage(live: DataFrame, stored: DataFrame) -> DataFrame:
    """object_key, state: orphan (stored, not referred to) or missing (the other way round)."""
    orphans = stored.join(live, "object_key", "left_anti").select("object_key", F.lit("orphan").alias("state"))
    return orphans.unionByName(live.join(stored, "object_key", "left_anti").select("object_key", F.lit("missing").alias("state")))


def asset_subtree(assets: DataFrame, docs: DataFrame, folders_inside: DataFrame) -> DataFrame:
    """Assets of documents that lie in some folders."""
    return assets.join(docs.join(folders_inside, "folder_id", "left_semi"), "doc_id", "left_semi")


def job_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def stage_means(jobs: DataFrame, last: int = 50) -> DataFrame:
    """stage, avg_ms over the latest jobs that have timings; the divisor is the number of those jobs, not of those with the stage."""
    timed = jobs.where(F.get_json_object("payload", "$.timings").isNotNull()).orderBy(F.desc("job_id")).limit(last)
    rows = timed.select(F.from_json(F.get_json_object("payload", "$.timings"), "map<string,double>").alias("t"))
    n = rows.agg(F.count("*").alias("n"))
    return rows.select(F.explode("t").alias("stage", "ms")).groupBy("stage").agg(F.sum("ms").alias("total")).crossJoin(n).select("stage", F.round(F.col("total") / F.col("n"), 3).alias("avg_ms"))  # n is one row


def expired(jobs: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    """Running jobs without a sign of life for longer than the lease."""
    return jobs.where((F.col("status") == "running") & (F.unix_micros("updated_at") < F.unix_micros(as_of) - settings.job_lease_seconds * 1_000_000))


def reclaimed(jobs: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    """Expired jobs as new log rows: queued again, or failed once the attempts are used up."""
    spent = F.col("attempts") + 1 >= settings.job_max_attempts
    return expired(jobs, as_of, settings).withColumns({"status": F.when(spent, "error").otherwise("queued"), "attempts": F.col("attempts") + 1, "updated_at": as_of})


def next_queued(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("job_id").limit(1)


def merge_payload(old: Column, new: Column) -> Column:
    """Shallow merge of JSON objects, the new keys winning; values keep their JSON types. What is no object counts as empty."""
    as_map = lambda x: F.coalesce(F.try_parse_json(x).try_cast("map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    merged = let(as_map(new), lambda n: F.map_concat(F.map_filter(as_map(old), lambda k, v: ~F.map_contains_key(n, k)), n))
    return F.to_json(merged)


def extract_confidence(jobs: DataFrame) -> DataFrame:
    """doc_id, confidence from each document's latest job; null where it is missing or no number."""
    value = F.get_json_object(F.max_by("payload", "job_id"), "$.extract_confidence")
    return jobs.where("doc_id is not null").groupBy("doc_id").agg(value.try_cast("double").alias("confidence"))


def recent(log: DataFrame, limit: int = 200, key: str = "id") -> DataFrame:
    return log.orderBy(F.desc(key)).limit(limit)


def outbox_due(outbox: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest pending rows; ``jobs.marked`` takes those out whose attempts are used up."""
    return outbox.where("status = 'pending'").orderBy("id").limit(limit)


def fan_out(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """One row for each event and subscriber: subscriptions are exploded and joined by name."""
    return events.join(hooks.select("hook_id", F.explode("events").alias("event")), "event").select("event_id", "event", "hook_id")


def unfinished_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages of a job that have no stored result yet."""
    return pages.join(results.select("job_id", "page_number"), ["job_id", "page_number"], "left_anti")


def usage(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.countDistinct("source").alias("sources"))


def workspace_settings(workspaces: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """workspace_id and every overridable setting: the workspace's own value, or the default."""
    own = {key: F.get_json_object("settings", f"$.{key}") for key in OVERRIDABLE}
    cast = lambda key, x: x if isinstance(getattr(settings, OVERRIDABLE[key]), str) else x.try_cast("double")
    return workspaces.select("workspace_id", *[F.coalesce(cast(k, x), F.lit(getattr(settings, OVERRIDABLE[k]))).alias(k) for k, x in own.items()])


def numbered_recent(log: DataFrame, by: list[str], n: int, key: str = "id") -> DataFrame:
    """The last n rows of each group."""
    return log.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(key)))).where(F.col("nth") <= n).drop("nth")
