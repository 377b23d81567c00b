"""Streams with timers against the batch form and a plain model, over restarts."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronkb.operators import memory
from heronkb.streaming import observe, stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TURNS = "mem_id bigint, agent_id string, session_id bigint, content string, created_at timestamp"


class Stream:
    """Files that are added one after the other; each run goes on from the checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make = spark, folder, schema, make

    def feed(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        rows = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in"))
        self.kind = rows.schema
        rows.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/state").option("path", f"{self.folder}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/out").collect()


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_sessions_equal_the_batch_form_and_come_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["user", "assistant"]), s, rng.choice(["hello", f"turn {i}", " ", "key sk-abcdefghijklmnopqrstuvwx"]), at(s * 7200 + k * 60)) for s in range(6) for k in range(12) if (i := s * 100 + k) or True]
    stream = Stream(spark, str(tmp_path), TURNS, lambda t: stateful.episodes(t))
    by_time = sorted(rows, key=lambda r: r[4])
    parts = [by_time[i : i + 13] for i in range(0, len(by_time), 13)]
    for part in parts:
        rng.shuffle(part)
    stream.feed(*parts[:2])
    out = stream.feed(*parts[2:], [(9999, "end", 999, "over", at(10**6))], [(9998, "end", 998, "over", at(10**6 + 1))])
    batch = memory.consolidate(memory.observe(spark.createDataFrame(rows, TURNS))).collect()
    show = lambda r: (r.agent_id, r.session_id, r.title, r.content, r.consolidated, tuple(r.mem_ids))
    assert Counter(map(show, out)) == Counter(map(show, batch))
    # Nothing comes again, and a turn behind the watermark is dropped.
    assert len(stream.feed([(7, "user", 0, "far too late", at(30))], [(8, "end", 997, "over", at(10**6 + 2))])) == len(out)


def test_a_session_that_goes_on_is_a_new_episode(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), TURNS, lambda t: stateful.episodes(t, gap="5 minutes", delay="1 minute"))
    out = stream.feed([(1, "user", 1, "first", at(0))], [(2, "user", 2, "other", at(600))], [(3, "user", 1, "second", at(700))], [(4, "user", 3, "end", at(5000))], [(5, "user", 4, "end", at(5001))])
    assert sorted((r.session_id, tuple(r.mem_ids)) for r in out) == [(1, (1,)), (1, (3,)), (2, (2,))]


class Model:
    """The queue as one would write it in a single process."""

    def __init__(self, lease=90_000, tries=3):
        self.jobs, self.out, self.lease, self.tries = {}, [], lease, tries

    def again(self, job, now, worker):
        n = self.jobs[job][1] + 1
        if n >= self.tries:
            del self.jobs[job]
        else:
            self.jobs[job] = [None, n, 0]
        self.out.append((now, "dead" if n >= self.tries else "queued", job, worker, n))

    def expire(self, now):
        for until, job, worker in sorted((j[2], k, j[0]) for k, j in self.jobs.items() if j[0] and j[2] < now):
            self.again(job, until, worker)

    def event(self, now, kind, job, worker):
        self.expire(now)
        known = self.jobs.get(job)
        if kind == "ask":
            free = min((k for k, j in self.jobs.items() if j[0] is None), default=None)
            if free is not None:
                self.jobs[free] = [worker, self.jobs[free][1], now + self.lease]
                self.out.append((now, "granted", free, worker, self.jobs[free][1]))
        elif kind == "enqueue":
            self.jobs.setdefault(job, [None, 0, 0])
        elif not known or known[0] != worker:
            self.out.append((now, "refused", job, worker, known and known[1]))
        elif kind == "heartbeat":
            known[2] = now + self.lease
        elif kind == "done":
            del self.jobs[job]
            self.out.append((now, "done", job, worker, known[1]))
        else:
            self.again(job, now, worker)


def test_queue_against_the_model_over_a_restart(spark, tmp_path):
    rng = random.Random(11)
    models, events, t = {q: Model() for q in (0, 1, 2)}, [], 0
    for seq in range(260):
        t += rng.choice([0, 1000, 5000, 30_000])
        q, worker = rng.choice([0, 0, 1, 2]), rng.choice(["w1", "w2", "w3"])
        kind = rng.choice(["enqueue", "ask", "ask", "heartbeat", "done", "failed"])
        held = [k for k, j in models[q].jobs.items() if j[0]]
        job = rng.randint(1, 40) if kind == "enqueue" or not held else rng.choice(held)
        if kind in ("heartbeat", "done", "failed") and held and rng.random() < 0.8:
            worker = models[q].jobs[job][0]
        models[q].event(t, kind, job, worker)
        events.append((q, at(t / 1000), seq, kind, None if kind == "ask" else job, worker))
    end = t + 10**7
    for q, m in models.items():
        m.expire(end)
    events.append((9, at(end / 1000), 999, "ask", None, "nobody"))
    events.append((9, at(end / 1000 + 100), 1000, "ask", None, "nobody"))
    stream = Stream(spark, str(tmp_path), stateful.EVENTS, stateful.leases)
    parts = [events[i : i + 70] for i in range(0, len(events), 70)]
    stream.feed(*parts[:2])
    out = stream.feed(*parts[2:-1], parts[-1][:-1], parts[-1][-1:])
    got = Counter((r.queue, int(round(r.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)), r.what, r.job_id, r.worker, r.attempts) for r in out)
    want = Counter((q, T0.timestamp() * 1000 + now, what, job, worker, n) for q, m in models.items() for now, what, job, worker, n in m.out)
    assert got == want


def test_two_workers_never_hold_one_job_and_a_silent_one_loses_it(spark, tmp_path):
    rows = [(0, at(0), i, "enqueue", i, None) for i in (1, 2, 3)] + [(0, at(1), 10 + i, "ask", None, f"w{i % 2}") for i in range(5)]
    stream = Stream(spark, str(tmp_path), stateful.EVENTS, stateful.leases)
    out = stream.feed(rows)
    assert sorted((r.job_id, r.worker) for r in out if r.what == "granted") == [(1, "w0"), (2, "w1"), (3, "w0")]
    # w1 gives signs of life, w0 doesn't; then w0 is refused.
    beats = [(0, at(80), 20, "heartbeat", 2, "w1"), (0, at(160), 21, "heartbeat", 2, "w1"), (0, at(161), 22, "done", 1, "w0"), (0, at(162), 23, "ask", None, "w1")]
    out = stream.feed(beats)
    assert {(r.what, r.job_id, r.worker, r.attempts) for r in out} >= {("queued", 1, "w0", 1), ("queued", 3, "w0", 1), ("refused", 1, "w0", 1), ("granted", 1, "w1", 1)}
    assert not any(r.what == "queued" and r.job_id == 2 for r in out)
