"""Small relations that queries of the catalogue derive from the data tables, and the same in SQL.

The documents hold no Markdown, so their lines get heading marks by line number; folders come from the
geography tables, memory from conversations, jobs from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import transcript_line
from ..sources.tables import table

#: Times are counted from here, so that no query asks for the present.
EPOCH = 1_704_067_200


def md_docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, md: line i is a heading of level 1 where i mod 6 is 0, 2 where it is 3, 3 where i mod 12 is 10."""
    mark = lambda i: F.when(i % 6 == 0, "# ").when(i % 6 == 3, "## ").when(i % 12 == 10, "### ").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i), x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))


MD = r"""md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE WHEN (j - 1) % 6 = 0 THEN '# ' WHEN (j - 1) % 6 = 3 THEN '## ' WHEN (j - 1) % 12 = 10 THEN '### ' ELSE '' END || x), chr(10)) AS md FROM documents)"""

#: Sections of the view, by the lines that begin with a mark and the rule that a parent is the latest smaller level.
SECTIONS = (
    MD
    + r""",
marks AS (SELECT doc_id, regexp_extract_all(md, '(?m)^(#{1,6})\s+(.+?)\s*$') AS m, md FROM md),
cut AS (SELECT doc_id, m, string_split_regex(md, '(?m)^#{1,6}\s+.+?\s*$') AS b FROM marks),
raw_sections AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS order_index, CAST(length(regexp_extract(m[i], '^#+')) AS INTEGER) AS level, regexp_replace(regexp_replace(m[i], '^#+\s+', ''), '\s+$', '') AS heading,
         regexp_replace(regexp_replace(coalesce(b[i + 1], ''), '^\s+', ''), '\s+$', '') AS content
  FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM cut)),
lasts AS (
  SELECT *, max(CASE WHEN level = 1 THEN order_index END) OVER w AS l1, max(CASE WHEN level = 2 THEN order_index END) OVER w AS l2
  FROM raw_sections WINDOW w AS (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parented AS (SELECT *, CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN l1 ELSE greatest(l1, l2) END AS parent_order_index, CASE WHEN level = 3 AND l2 > coalesce(l1, -1) THEN l2 END AS via FROM lasts),
sections AS (
  SELECT p.doc_id, p.order_index, p.parent_order_index, p.level, p.heading, concat_ws(' > ', CASE WHEN p.level > 1 THEN a.heading END, v.heading, p.heading) AS breadcrumb, p.content
  FROM parented p LEFT JOIN raw_sections a ON a.doc_id = p.doc_id AND a.order_index = p.l1 LEFT JOIN raw_sections v ON v.doc_id = p.doc_id AND v.order_index = p.via)"""
)


def memory_turns(spark: SparkSession, sf: str) -> DataFrame:
    """mem_id, agent_id (role), session_id, content, created_at, and every fifth turn said a second time later."""
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("mem_id"), F.col("role").alias("agent_id"), F.col("conv_id").alias("session_id"), transcript_line(F.col("role"), F.col("text")).alias("content"), F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 60 + F.col("turn")).alias("created_at"), "turn"
    )
    again = rows.where("turn % 5 = 0").withColumns({"mem_id": F.col("mem_id") + 500, "created_at": F.expr("created_at + interval 30 seconds")})
    return rows.unionByName(again).drop("turn")


TURNS = r"""first_said AS (SELECT conv_id * 1000 + turn AS mem_id, role AS agent_id, conv_id AS session_id, regexp_replace(regexp_replace(regexp_replace(coalesce(role, '') || ': ' || coalesce(text, ''), '^[: ]+|[: ]+$', '', 'g'), '^\s+', ''), '\s+$', '') AS content, 1704067200 + conv_id * 60 + turn AS t, turn FROM conversations),
turns AS (SELECT mem_id, agent_id, session_id, content, t FROM first_said UNION ALL SELECT mem_id + 500, agent_id, session_id, content, t + 30 FROM first_said WHERE turn % 5 = 0)"""


def memory_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of all tiers from events: importance by value, keys by user and type, last access at the event."""
    e = table(spark, sf, "events")
    tier = F.element_at(F.array(*map(F.lit, ("working", "episodic", "semantic", "procedural"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("mem_id"),
        (F.col("user_id") % 20).cast("string").alias("agent_id"),
        F.when(F.col("event_id") % 3 == 0, "shared").otherwise("agent").alias("scope"),
        tier.alias("tier"),
        F.when(F.col("event_type") == "purchase", F.concat_ws("-", F.lit("key"), (F.col("user_id") % 50).cast("string"))).otherwise("").alias("mkey"),
        F.lit("").alias("title"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        (F.col("value").cast("double") / 100).alias("importance"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("last_accessed_at"),
        F.sha2(F.concat_ws(" ", "event_type", "props"), 256).alias("content_hash"),
    )


LOG = r"""log AS (SELECT event_id AS mem_id, CAST(user_id % 20 AS VARCHAR) AS agent_id, CASE WHEN event_id % 3 = 0 THEN 'shared' ELSE 'agent' END AS scope,
  (['working', 'episodic', 'semantic', 'procedural'])[CAST(event_id % 4 + 1 AS INTEGER)] AS tier, CASE WHEN event_type = 'purchase' THEN 'key-' || CAST(user_id % 50 AS VARCHAR) ELSE '' END AS mkey,
  event_type || ' ' || props AS content, CAST(value AS DOUBLE) / 100 AS importance, ts, epoch_us(ts) AS us FROM events),
kept AS (SELECT * FROM (SELECT *, CASE WHEN mkey <> '' THEN lead(mem_id) OVER (PARTITION BY agent_id, mkey ORDER BY ts, mem_id) END AS superseded_by FROM log))"""


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """folder_id, parent_id, path, name, description: regions with their nations below."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    label = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    top = r.select(F.col("r_regionkey").cast("bigint").alias("folder_id"), F.lit(None).cast("bigint").alias("parent_id"), label("r_name").alias("path"), F.col("r_name").alias("name"), F.lit("").alias("description"))
    below = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select((F.col("n_nationkey") + 100).cast("bigint").alias("folder_id"), F.col("r_regionkey").cast("bigint").alias("parent_id"), F.concat_ws(".", label("r_name"), label("n_name")).alias("path"), F.col("n_name").alias("name"), F.lit("").alias("description"))
    return top.unionByName(below)


def filed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents in their nation's folder; those with a negative balance lie in none."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") >= 0, (F.col("c_nationkey") + 100).cast("bigint")).alias("folder_id"), F.col("c_name").alias("title"))


FOLDERS = r"""folders AS (SELECT CAST(r_regionkey AS BIGINT) AS folder_id, CAST(NULL AS BIGINT) AS parent_id, regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g') AS path, r_name AS name FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(r_regionkey AS BIGINT), regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g') || '.' || regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
filed AS (SELECT c_custkey AS doc_id, CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey + 100 AS BIGINT) END AS folder_id, c_name AS title FROM customer)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """job_id, doc_id, status, updated_at, attempts, payload: events as jobs, two of three with timings."""
    v = F.get_json_object("props", "$.k").cast("double")
    timings = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"timings": {"extract": '), v.cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "embed": '), (v * 2).cast("string"))).otherwise(""), F.lit("}}"))).otherwise(F.concat(F.lit('{"extract_confidence": "'), (v / 100).cast("string"), F.lit('"}')))
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "queued").otherwise("done")
    return table(spark, sf, "events").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 500).alias("doc_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_id") % 3).alias("attempts"), timings.alias("payload"))


JOBS = r"""jobs AS (SELECT event_id AS job_id, user_id % 500 AS doc_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' ELSE 'done' END AS status, ts AS updated_at, event_id % 3 AS attempts,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v, event_id FROM events)"""

#: Fixed query texts for search.
QUERIES = ((1, "the of and"), (2, "tion ing the"), (3, "de la les"), (4, "der die und"), (5, "el la que"))
QUERIES_SQL = "q(query_id, query) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ") v(a, b))"


def search_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id bigint, query string")
