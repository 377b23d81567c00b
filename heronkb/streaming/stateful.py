"""Streams with state and timers: sessions that close by themselves, and a queue of jobs under leases.

State lies in the state store of the stream (RocksDB, in its checkpoint folder), so a stream that is stopped or loses an executor
goes on where it was. Time is that of the events; timers fire when the watermark passes them, and rows behind the watermark
are dropped. State is removed when a session closes or a job ends, so it grows with what is open alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Settings
from ..functions.text import redact, strip

EVENTS = "queue int, ts timestamp, seq bigint, kind string, job_id bigint, worker string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    """Timers need this state store; streams that started with another keep theirs, by their checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class Sessions(StatefulProcessor):
    """Collects the turns of a session, each content once, and sends one episode when it has been quiet for ``gap_ms``."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getMapState("said", "content_hash string", "mem_id bigint, content string, created_us bigint")
        self.last = handle.getValueState("last", "created_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = before = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["created_at", "mem_id"]).itertuples():
            us = int(r.created_at.value // 1000)
            if last is not None and us // 1000 > last + self.gap_ms:  # quiet for long enough, though the timer hasn't come round
                out.append(self._episode(key))
                last = None
            known = self.said.getValue((r.content_hash,)) if self.said.containsKey((r.content_hash,)) else None
            if known is None or (us, r.mem_id) < (known[2], known[0]):
                self.said.updateValue((r.content_hash,), (int(r.mem_id), r.content, us))
            last = max(last or 0, us // 1000)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap_ms)
            self.handle.registerTimer(last + self.gap_ms)
            self.last.update((last,))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield self._episode(key)

    def _episode(self, key: tuple) -> pd.DataFrame:
        turns = sorted((v[2], v[0], v[1]) for _, v in self.said.iterator())
        self.said.clear()
        content = "## Session notes\n\n" + "\n".join(f"- {c}" for _, _, c in turns) + "\n"
        return pd.DataFrame({"agent_id": [key[0]], "session_id": [key[1]], "title": [f"Session {key[1]}"], "content": [content], "consolidated": [len(turns)], "mem_ids": [[m for _, m, _ in turns]]})

    def close(self) -> None:
        pass


def episodes(turns: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One episodic row for each session that has been quiet for ``gap``, as ``memory.consolidate`` writes it without a model.

    turns: mem_id, agent_id (string), session_id, content, created_at. Turns may come ``delay`` late; later ones are dropped. A
    session that goes on after it was quiet is a new episode; what comes late joins the one that is open then. Blank turns say nothing.
    """
    spark = turns.sparkSession
    _with_store(spark)
    gap_ms = int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + interval {gap})").first()[0])
    content = redact(F.col("content"))
    rows = turns.where(strip(F.col("content")) != "").withColumn("content", content).withColumn("content_hash", F.sha2("content", 256))
    kind = turns.schema["session_id"].dataType.simpleString()
    return rows.withWatermark("created_at", delay).groupBy("agent_id", "session_id").transformWithStateInPandas(
        Sessions(gap_ms), f"agent_id string, session_id {kind}, title string, content string, consolidated bigint, mem_ids array<bigint>", "append", "EventTime"
    )


class OpenJobs:
    """A queue's open jobs for the length of one batch: the state as it was, heaps over it, and what changed."""

    def __init__(self, jobs: dict[int, tuple], lease_ms: int, attempts: int) -> None:
        self.jobs, self.lease_ms, self.attempts = jobs, lease_ms, attempts  # job: worker or None, tries, end of the lease
        self.free = [k for k, v in jobs.items() if v[0] is None]
        self.held = [(v[2], k) for k, v in jobs.items() if v[0] is not None]
        heapq.heapify(self.free)
        heapq.heapify(self.held)
        self.changed: set[int] = set()
        self.out: list[tuple] = []

    def _set(self, job: int, value: tuple | None) -> None:
        self.changed.add(job)
        if value is None:
            del self.jobs[job]
        else:
            self.jobs[job] = value
            heapq.heappush(*((self.free, job) if value[0] is None else (self.held, (value[2], job))))

    def _again(self, job: int, at: int, worker: str) -> None:
        """A try that was lost or failed: queued again, or given up."""
        tries = self.jobs[job][1] + 1
        dead = tries >= self.attempts
        self._set(job, None if dead else (None, tries, 0))
        self.out.append((at, "dead" if dead else "queued", job, worker, tries))

    def expire(self, now: int) -> None:
        """Leases that ended before now."""
        while self.held and self.held[0][0] < now:
            until, job = heapq.heappop(self.held)
            known = self.jobs.get(job)
            if known is not None and known[0] is not None and known[2] == until:  # else it was renewed or ended since
                self._again(job, until, known[0])

    def event(self, now: int, kind: str, job: int | None, worker: str) -> None:
        self.expire(now)
        if kind == "ask":
            while self.free:
                job = heapq.heappop(self.free)
                known = self.jobs.get(job)
                if known is not None and known[0] is None:
                    self._set(job, (worker, known[1], now + self.lease_ms))
                    self.out.append((now, "granted", job, worker, known[1]))
                    break
            return
        if job is None:
            return
        known = self.jobs.get(job)
        if kind == "enqueue":
            if known is None:
                self._set(job, (None, 0, 0))
        elif known is None or known[0] is None or known[0] != worker:
            self.out.append((now, "refused", job, worker, None if known is None else known[1]))  # it holds no lease any more
        elif kind == "heartbeat":
            self._set(job, (worker, known[1], now + self.lease_ms))
        elif kind == "done":
            self._set(job, None)
            self.out.append((now, "done", job, worker, known[1]))
        elif kind == "failed":
            self._again(job, now, worker)


class Leases(StatefulProcessor):
    """The open jobs of one queue. Its events come in order of time; each does what a transaction on the queue would."""

    def __init__(self, lease_ms: int, attempts: int) -> None:
        self.lease_ms, self.attempts = lease_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id bigint", "worker string, attempts int, until bigint")

    def _open(self) -> OpenJobs:
        return OpenJobs({k[0]: tuple(v) for k, v in self.jobs.iterator()}, self.lease_ms, self.attempts)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._open()
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            now.event(int(r.ts.value // 1_000_000), r.kind, None if pd.isna(r.job_id) else int(r.job_id), r.worker)
        return self._close(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._open()
        now.expire(expiredTimerInfo.getExpiryTimeInMs())
        return self._close(key, now)

    def _close(self, key: tuple, now: OpenJobs) -> Iterator[pd.DataFrame]:
        """Writes what changed back; each lease that stands has a timer just after its end."""
        for job in now.changed:
            value = now.jobs.get(job)
            if value is not None:
                self.jobs.updateValue((job,), value)
                if value[0] is not None:
                    self.handle.registerTimer(value[2] + 1)
            elif self.jobs.containsKey((job,)):
                self.jobs.removeKey((job,))
        if now.out:
            frame = pd.DataFrame(now.out, columns=["at", "what", "job_id", "worker", "attempts"])
            yield pd.DataFrame({"queue": key[0], "ts": pd.to_datetime(frame["at"], unit="ms"), "what": frame["what"], "job_id": frame["job_id"].astype("int64"), "worker": frame["worker"], "attempts": frame["attempts"].astype("Int32")})

    def close(self) -> None:
        pass


def leases(events: DataFrame, delay: str = "10 seconds", settings: Settings = DEFAULT) -> DataFrame:
    """queue, ts, what, job_id, worker, attempts: what became of the events (``EVENTS``) of each queue.

    Kinds are enqueue, ask (for the queued job of the least id), heartbeat, done and failed. A job is granted to one worker at a time,
    for ``job_lease_seconds`` from its last sign of life; a lease that ends, or a failure, uses up one of ``job_max_attempts``, after which the
    job is dead. A worker without the lease is refused; an event that lacks its job, or is of another kind, does nothing. Many workers may ask at once; jobs are spread by ``queue``, one task's
    state each, whose open jobs a batch with events for it reads. Events may come ``delay`` late, in a later batch than their successors; those that are later still are dropped.
    """
    _with_store(events.sparkSession)
    return events.withWatermark("ts", delay).groupBy("queue").transformWithStateInPandas(
        Leases(settings.job_lease_seconds * 1000, settings.job_max_attempts), "queue int, ts timestamp, what string, job_id bigint, worker string, attempts int", "append", "EventTime"
    )
