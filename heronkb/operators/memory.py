"""Tiered agent memory over an append-only log: the state is the latest view, changes are returned as new log rows.

Log columns: mem_id, agent_id, scope, tier, session_id, mkey, title, content, content_hash, importance,
created_at, last_accessed_at. Nothing is updated in place; every operation takes ``as_of`` where time counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Hooks, Settings
from ..functions.text import redact, strip, transcript_line
from . import retrieval

# Tiers in the order of a digest; the first two fade.
TIERS = ("working", "episodic", "semantic", "procedural")
TRANSIENT = ("working", "episodic")


def visible(agent_id: str) -> Column:
    return (F.col("scope") == "shared") | (F.col("agent_id") == agent_id)


def remember(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """New rows made storable: secrets masked in title and content, hash of what is stored, default scope.

    An unknown tier fails the job that stores the rows, so that none is lost unsaid.
    """
    content, title = redact(F.col("content")), redact(F.coalesce(F.col("title"), F.lit("")))
    refuse = F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(F.col("tier"), F.lit("null")))).cast("string")
    return rows.withColumns({"tier": F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(refuse), "content": content, "title": title, "content_hash": F.sha2(content, 256), "scope": F.coalesce("scope", F.lit(settings.memory_scope))})


def with_supersession(log: DataFrame) -> DataFrame:
    """Adds superseded_by: of one agent's rows under one key, each by the next. Rows without a key stand."""
    keyed = F.coalesce(F.col("mkey"), F.lit("")) != ""
    # Rows without a key get a partition of their own id, so that they don't meet in one task.
    own = F.when(keyed, F.col("mkey")).otherwise(F.concat(F.lit("\x00"), F.col("mem_id").cast("string")))
    after = F.lead("mem_id").over(W.partitionBy("agent_id", own).orderBy("created_at", "mem_id"))
    return log.withColumn("superseded_by", after)


def active(log: DataFrame) -> DataFrame:
    return with_supersession(log).where("superseded_by is null")


def list_memory(log: DataFrame, agent_id: str, *, tier: str | None = None, scope: str | None = None, superseded: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, with optional filters."""
    rows = (with_supersession(log) if superseded else active(log)).where(visible(agent_id))
    if tier:
        rows = rows.where(F.col("tier") == tier)
    if scope:
        rows = rows.where(F.col("scope") == scope)
    return rows.orderBy(F.desc("created_at"), F.desc("mem_id")).offset(offset).limit(limit)


def observe(turns: DataFrame, importance: float = 0.5) -> DataFrame:
    """Working rows, one for each agent, session and content: the earliest stays."""
    content = redact(F.col("content"))
    hashed = turns.where(strip(F.col("content")) != "").withColumns({"content": content, "content_hash": F.sha2(content, 256)})
    first = F.min_by(F.struct("mem_id", "content", "created_at"), F.struct("created_at", "mem_id"))
    out = hashed.groupBy("agent_id", "session_id", "content_hash").agg(first.alias("m"))
    return out.select("m.mem_id", "agent_id", "session_id", "m.content", "content_hash", "m.created_at", F.lit("working").alias("tier"), F.lit(importance).alias("importance"))


def turns_of(transcript: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    return transcript.withColumn("content", transcript_line(F.col(role), F.col(text)))


def transcript_turns(transcripts: DataFrame, text: str = "text") -> DataFrame:
    """Transcripts that are one text: each line that isn't blank is a turn, numbered from 0 by its line, as content."""
    rest = [c for c in transcripts.columns if c != text]
    lines = F.split(F.col(text), "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]")
    rows = transcripts.select(*rest, F.posexplode(lines).alias("turn", "line"))
    return rows.select(*rest, F.col("turn").cast("bigint").alias("turn"), strip(F.col("line")).alias("content")).where("content <> ''")


def facts_of(markdown: Column) -> Column:
    """Bullets under a heading about facts, decisions or takeaways; "(none)" is none.

    A heading starts a piece of the text, so each piece is either kept with its bullets or not.
    """
    lines = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda x: x != "")
    # From each heading to the next is one text; a mark that no line holds divides them.
    joined = F.array_join(F.transform(lines, lambda x: F.when(x.startswith("#"), F.concat(F.lit("\x00"), x)).otherwise(x)), "\n")
    pieces = F.filter(F.split(joined, "\x00"), lambda p: F.lower(F.substring_index(p, "\n", 1)).rlike(r"^#+.*(?:key fact|facts|decision|takeaway)"))
    bullets = F.flatten(F.transform(pieces, lambda p: F.filter(F.split(p, "\n"), lambda x: x.rlike(r"^[-*] "))))
    return F.filter(F.transform(bullets, lambda x: strip(F.substring(x, 3, 1 << 30))), lambda f: (f != "") & (F.lower(f) != "(none)"))


def consolidate(working: DataFrame, hooks: Hooks = DEFAULT.hooks) -> DataFrame:
    """agent_id, session_id, title, content, facts, consolidated, mem_ids: one episodic row for each session.

    Without a model the episode is the bullets under "Session notes" and there are no facts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "mem_id", "content")))
    rows = working.groupBy("agent_id", "session_id").agg(ordered.alias("obs"), F.count("*").alias("consolidated"))
    bullets = F.array_join(F.transform("obs", lambda o: F.concat(F.lit("- "), o["content"])), "\n")
    raw = F.concat(F.lit("## Session notes\n\n"), bullets, F.lit("\n"))
    out = rows.select("agent_id", "session_id", F.concat(F.lit("Session "), F.col("session_id").cast("string")).alias("title"), raw.alias("content"), bullets.alias("bullets"), "consolidated", F.transform("obs", lambda o: o["mem_id"]).alias("mem_ids"))
    if hooks.rewrite is None:
        return out.drop("bullets").withColumn("facts", F.array().cast("array<string>"))
    from ..sources.hooks import rewritten

    told = rewritten(out, "bullets", "told", hooks)
    done = F.coalesce(strip(F.col("told")), F.lit("")) != ""
    return told.withColumns({"facts": F.when(done, facts_of(F.col("told"))).otherwise(F.array().cast("array<string>")), "content": F.when(done, strip(F.col("told"))).otherwise(F.col("content"))}).drop("bullets", "told")


def promoted(episodes: DataFrame, log: DataFrame, as_of: Column, importance: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """What a consolidation stores: new rows (one episode a session, one semantic row a fact), and the working rows they
    supersede as (mem_id, superseded_by_key). ``episodes`` as ``consolidate`` gives them, ``log`` the memory so far.

    A fact that the agent knows already, by the hash of its text, isn't stored again.
    """
    key = F.concat(F.lit("episode:"), F.col("agent_id").cast("string"), F.lit(":"), F.col("session_id").cast("string"))
    shape = lambda df, tier, content, weight: df.select("agent_id", "session_id", F.lit(tier).alias("tier"), key.alias("from_key"), "title", content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.lit(weight).alias("importance"), as_of.alias("created_at"))
    stories = shape(episodes, "episodic", F.col("content"), 1.0)
    facts = episodes.select("agent_id", "session_id", F.lit("").alias("title"), F.explode("facts").alias("fact"))
    facts = shape(facts, "semantic", redact(F.col("fact")), importance).dropDuplicates(["agent_id", "content_hash"])
    known = log.where("tier = 'semantic'").select("agent_id", "content_hash").distinct()
    new = stories.unionByName(facts.join(known, ["agent_id", "content_hash"], "left_anti").select(*stories.columns))
    return new, episodes.select(F.explode("mem_ids").alias("mem_id"), key.alias("superseded_by_key"))


def decayed(as_of: Column, half_life_days: float = DEFAULT.memory_half_life_days) -> Column:
    """Importance halved for each half-life since the last access."""
    days = (F.unix_micros(as_of) - F.unix_micros("last_accessed_at")) / F.lit(86_400e6)
    return F.col("importance") * F.pow(F.lit(0.5), days / max(half_life_days, 0.0001))


def evictions(log: DataFrame, as_of: Column, settings: Settings = DEFAULT, agent_id: str | None = None) -> DataFrame:
    """mem_id, agent_id, tier, reason: faded transient rows, then working rows over each agent's cap.

    The cap counts all working rows of an agent at least as new, faded ones too, and rows of one moment
    together; it takes all agents, also where fading is limited to one.
    """
    rows = log.where("superseded_by is null") if "superseded_by" in log.columns else active(log)
    fades = F.col("tier").isin(*TRANSIENT) & (decayed(as_of, settings.memory_half_life_days) < settings.memory_min_importance)
    if agent_id is not None:
        fades = fades & (F.col("agent_id") == agent_id)
    working = F.when(F.col("tier") == "working", 1)
    newer = F.count(working).over(W.partitionBy("agent_id").orderBy(F.desc("created_at")).rangeBetween(W.unboundedPreceding, W.currentRow))
    over = (F.col("tier") == "working") & (newer > settings.memory_working_cap)
    reason = F.when(fades, "decayed below importance floor").when(over, "working buffer over cap")
    return rows.select("mem_id", "agent_id", "tier", "content_hash", reason.alias("reason")).where("reason is not null")


def reinforced(recalled: DataFrame, log: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    """mem_id, importance, last_accessed_at: what recalling changes, as rows for the log."""
    return log.join(recalled.select("mem_id").distinct(), "mem_id", "left_semi").select("mem_id", F.least(F.col("importance") + settings.recall_boost, F.lit(settings.importance_cap)).alias("importance"), as_of.alias("last_accessed_at"))


def recall(log: DataFrame, queries: DataFrame, agent_id: str, k: int = 8, *, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, tier: str | None = None, overfetch: int = DEFAULT.overfetch) -> DataFrame:
    """query_id, mem_id, score, rank: any query word matches title or content; vectors add an arm."""
    rows = active(log).where(visible(agent_id))
    if tier:
        rows = rows.where(F.col("tier") == tier)
    rows = rows.withColumn("text", F.concat_ws(" ", F.coalesce("title", F.lit("")), "content"))
    arms = [retrieval.top(retrieval.lexical(rows, queries, match_all=False, doc_id="mem_id"), k * overfetch)]
    if vectors is not None:
        seen = vectors.join(rows.select("mem_id"), "mem_id", "left_semi").withColumnRenamed("mem_id", "doc_id")
        arms.append(retrieval.nearest(seen, query_vectors, k * overfetch, "doc_id"))
    return retrieval.top(retrieval.fuse(arms), k).withColumnRenamed("doc_id", "mem_id")


def digest(rows: DataFrame) -> DataFrame:
    """agent_id, markdown: an agent's memory by tier, in the order of ``created_at`` falling."""
    head = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.left(F.substring_index("content", "\n", 1), F.lit(60)))
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    item = F.concat(F.lit("### "), head, F.lit("\n\n"), F.col("content"), F.lit("\n"))
    by_tier = rows.groupBy("agent_id", "tier", order.alias("place")).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("t"), (-F.col("mem_id")).alias("i"), item.alias("item")))).alias("items"))
    part = F.concat(F.lit("\n## "), F.initcap("tier"), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["item"]), "\n"))
    parts = F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))
    return by_tier.groupBy("agent_id").agg(F.concat(F.lit("# Memory — "), F.first("agent_id"), F.lit("\n\n"), F.array_join(F.transform(parts, lambda x: x["part"]), "\n")).alias("markdown"))


def audit(changed: DataFrame, action: str, as_of: Column, author: str = "system") -> DataFrame:
    """Rows of the audit log for changed memories."""
    return changed.select("mem_id", "agent_id", "tier", F.lit(action).alias("action"), F.lit(author).alias("author"), "reason", "content_hash", as_of.alias("at"))


def forget(log: DataFrame, mem_ids: list[int], reason: str = "") -> tuple[DataFrame, DataFrame]:
    """The log without some rows, and those rows for the audit."""
    gone = F.col("mem_id").isin(mem_ids)
    return log.where(~gone), log.where(gone).select("mem_id", "agent_id", "tier", F.lit(reason).alias("reason"), "content_hash")
