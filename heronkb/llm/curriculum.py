"""Mixing sources by weight schedules that change over training.

Each source has a weight schedule: a piecewise linear density over progress 0 to 1, whose integral is its
weight. Weights share out as many words as the corpus has; a source is given at most ``most`` times its own words, and
what it can't take goes to the others by weight, until none is above. A source's documents stand in the order of a hash;
laid end to end, again and again, they meet its demand, so a document's place in that line is the share of the source's
demand that is met before it. Inverting the integral of the schedule at that share gives the training position: the
progress at which demand reaches the document. Sorting all documents by position (a range sort) is the curriculum.
The last pass over a source may stop inside a document, of which the first words are taken.

Edge cases: a null or empty text has size 0 and is not taken; null sources are one source, the last; rows with null or
repeated ids count each on their own; equal rows take any order among themselves; an empty table gives no rows;
other columns are ignored.

Scale: texts are read once and only narrow rows are shuffled. Fully equal rows are counted before, and the line of a source
is summed in three levels (6 bits of the hash, 6 more, and inside), so a source of any size is many tasks' work.
Sources are ranked in one task: one narrow row for each. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import checkpointed

Schedule = Sequence[tuple[float, float]]

#: (progress, weight) of the sources by rank, again and again: one that fades, a steady one and one that grows. Their integrals are 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
MOST = 3
_WORD = r"[^\x20\x09-\x0D]+"
_BITS, _BLOCK = 60, 4096


def integral(schedule: Schedule) -> float:
    return sum((t - s) * (v + w) / 2 for (s, v), (t, w) in zip(schedule, schedule[1:]))


def position(share: Column, schedule: Schedule) -> Column:
    """The progress by which this share of the schedule's integral has passed."""
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or integral(schedule) <= 0 or any(w < 0 for _, w in schedule):
        raise ValueError(f"a schedule goes from progress 0 to 1 with weights from 0 on: {schedule}")
    whole, area, out = float(integral(schedule)), 0.0, None
    for s, v, t, w in (map(float, (*a, *b)) for a, b in zip(schedule, schedule[1:])):
        if t <= s:
            raise ValueError(f"a schedule's progress grows: {schedule}")
        left = share * F.lit(whole) - F.lit(area)
        slope = (w - v) / (t - s)
        # The root of v x + slope x^2 / 2 = left in the form that doesn't cancel.
        root = F.lit(v) + F.sqrt(F.greatest(F.lit(v * v) + F.lit(2.0 * slope) * left, F.lit(0.0)))
        at = F.when(left <= 0, F.lit(s)).otherwise(F.least(F.lit(s) + F.try_divide(F.lit(2.0) * left, root), F.lit(t)))
        out = at if out is None else F.when(left > 0, at).otherwise(out)
        area += (t - s) * (v + w) / 2
    return out


def targets(sizes: DataFrame, *, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> DataFrame:
    """Adds kind (number of its schedule) and target to (none, src, source_size), one row for each source."""
    every = W.partitionBy()
    by_name = W.orderBy("none", "src")
    weights = F.array(*(F.lit(float(integral(s))) for s in schedules))
    ranked = sizes.withColumn("kind", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules)))).withColumn("weight", F.element_at(weights, F.col("kind") + 1))
    # In the order of cap to weight, those at their cap come first: each is one if the level that is left for it is as high.
    bounded = ranked.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    line = W.orderBy((F.col("cap") / F.col("weight")), "none", "src")
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(line.rowsBetween(W.currentRow, W.unboundedFollowing))
    judged = bounded.withColumn("full", F.col("cap") <= (F.col("total") - before) / behind * F.col("weight"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return judged.select("none", "src", "source_size", "kind", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (left / open_)).alias("target"))


def mix(docs: DataFrame, *, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, takes: one row for each document.

    ``takes`` has (epoch, words, position) for each time that the document is read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    digest_ = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), content).cast("binary"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.regexp_count(content, F.lit(_WORD)).cast("bigint").alias("size"), F.conv(F.left(digest_, F.lit(_BITS // 4)), 16, 10).cast("bigint").alias("hash"),
    )
    equal = checkpointed(rows.groupBy("none", "src", "hash", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("high", F.shiftright("hash", _BITS - 6)).withColumn("low", F.shiftright("hash", _BITS - 12).bitwiseAND(63)))

    words = F.sum(F.col("size") * F.col("n"))
    low = equal.groupBy("none", "src", "high", "low").agg(words.alias("words"))
    high = low.groupBy("none", "src", "high").agg(F.sum("words").alias("words"))
    sources = targets(high.groupBy("none", "src").agg(F.sum("words").alias("source_size")), schedules=schedules, most=most)
    before = lambda what, *keys, order: F.coalesce(F.sum(what).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    highs = high.select("none", "src", "high", before("words", "none", "src", order=["high"]).alias("from_high"))
    lows = low.select("none", "src", "high", "low", before("words", "none", "src", "high", order=["low"]).alias("from_low"))
    known = lows.join(highs, ["none", "src", "high"]).join(sources, ["none", "src"])
    keys = ["none", "src", "high", "low"]
    placed = equal.withColumn("inside", before(F.col("size") * F.col("n"), *keys, order=["hash", "doc_id", "size"])).join(known, keys)

    # Equal rows stand end to end; there may be any number, so they are written out in blocks.
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint").bitwiseOR(_BLOCK - 1), F.lit(_BLOCK).cast("bigint"))))
    each = blocks.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("n"), F.col("block") + _BLOCK) - 1)))

    wanted = F.floor("target").cast("bigint")
    each = each.withColumn("start", F.col("from_high") + F.col("from_low") + F.col("inside") + F.col("copy") * F.col("size"))
    each = each.withColumn("wanted", wanted).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("wanted DIV source_size")).otherwise(F.lit(0)))
    rest = F.col("wanted") - F.col("epochs") * F.col("source_size") - F.col("start")
    each = each.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), rest))).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))

    def take(epoch: Column) -> Column:
        share = F.try_divide((F.col("start") + epoch * F.col("source_size")).cast("double"), F.col("wanted").cast("double"))
        at = F.lit(None).cast("double")
        for kind, schedule in enumerate(schedules):
            at = F.when(F.col("kind") == kind, position(share, schedule)).otherwise(at)
        return F.struct(epoch.alias("epoch"), F.when(epoch < F.col("epochs"), F.col("size")).otherwise(F.col("rest")).alias("words"), at.alias("position"))

    takes = F.filter(F.array(*(take(F.lit(e).cast("bigint")) for e in range(most + 1))), lambda t: (t["words"] > 0) & (t["epoch"] <= F.col("epochs")))
    named = F.when(~F.col("none"), F.col("src")).alias("source")
    return each.select("doc_id", named, "size", "source_size", "target", "taken", takes.alias("takes"), "hash")


def training_order(mixed: DataFrame) -> DataFrame:
    """doc_id, source, epoch, words, position: one row each time that a document is read, range-sorted by position."""
    return mixed.select("doc_id", "source", "hash", F.inline("takes")).orderBy("position", "hash", "doc_id").drop("hash")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and when a document is first read (billionths of training), sorted by it; null if never."""
    rows = mix(docs).withColumn("first", F.get("takes", F.lit(0))["position"])
    return rows.orderBy(F.col("first").asc_nulls_last(), "hash", "doc_id").select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("first") * 1e9).cast("bigint").alias("first_position"))


def _position_sql(schedule: Schedule) -> str:
    whole, area, out = float(integral(schedule)), 0.0, None
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    for s, v, t, w in (map(float, (*a, *b)) for a, b in zip(schedule, schedule[1:])):
        left, slope = f"(share * {d(whole)} - {d(area)})", (w - v) / (t - s)
        root = f"({d(v)} + sqrt(greatest({d(v * v)} + {d(2.0 * slope)} * {left}, {d(0.0)})))"
        at = f"CASE WHEN {left} <= 0 THEN {d(s)} ELSE least({d(s)} + {d(2.0)} * {left} / {root}, {d(t)}) END"
        out = at if out is None else f"CASE WHEN {left} > 0 THEN {at} ELSE {out} END"
        area += (t - s) * (v + w) / 2
    return out


def sql(schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> str:
    kinds = " ".join(f"WHEN {i} THEN CAST({float(integral(s))!r} AS DOUBLE)" for i, s in enumerate(schedules))
    places = " ".join(f"WHEN {i} THEN {_position_sql(s)}" for i, s in enumerate(schedules))
    return f"""
WITH r AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || left(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), {_BITS // 4}) AS BIGINT) AS hash
  FROM documents),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY none, src ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM r),
s AS (SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY none, src),
k AS (SELECT *, (row_number() OVER (ORDER BY none, src) - 1) % {len(schedules)} AS kind FROM s),
w AS (SELECT *, CASE kind {kinds} END AS weight, source_size * {most} AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM k),
j AS (SELECT *, cap <= CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY cap / weight, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight AS is_full FROM w),
t AS (SELECT none, src, source_size, kind, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE weight * (CAST(total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS DOUBLE) / sum(CASE WHEN NOT is_full THEN weight END) OVER ()) END AS target FROM j),
m AS (SELECT p.*, t.source_size, t.kind, t.target, CAST(floor(t.target) AS BIGINT) AS wanted,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs FROM p JOIN t ON p.none = t.none AND p.src = t.src),
x AS (SELECT *, greatest(0, least(size, wanted - epochs * source_size - start)) AS rest,
        CASE WHEN wanted > 0 THEN CAST(start AS DOUBLE) / CAST(wanted AS DOUBLE) END AS share FROM m)
SELECT doc_id, size, source_size, target, CAST(epochs * size + rest AS BIGINT) AS taken,
       CASE WHEN epochs * size + rest > 0 THEN CAST(floor((CASE kind {places} END) * 1e9) AS BIGINT) END AS first_position
FROM x"""
