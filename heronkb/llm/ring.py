"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``virtual`` points on the ring. A key belongs to the arc that ends at the next point
clockwise; if that point's shard is full, it goes on clockwise to the first shard that has room. The
bound is exact: of n rows each shard takes floor(n / shards), the first n mod shards one more, so counts
differ by one at most (law ``rows``) and only the overflow leaves its arc's shard.

How it scales. All keys of an arc meet the same shards in the same order, so who overflows where is
settled by the number of keys on each arc: at most shards x virtual numbers, whatever the data. The
settlement says which ranks of an arc go to which shard; rows find theirs by a join on arc and rank.
Ranks are counted in two levels, (arc, salt) and then inside, so no task holds a whole arc or shard.
DataFrame operations only.

Edge cases: a null text has size 8 and the checksum of an empty one; null ids share a place on the
ring; rows with equal ids are told apart by content, fully equal rows take any order among themselves;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import checkpointed

SHARDS, VIRTUAL = 24, 64
_SLOT_BITS, _SALT_BITS = 14, 12


def points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place on the ring, shard) of all virtual nodes, clockwise."""
    place = lambda name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
    return sorted((place(f"shard {s} node {v}"), s) for s in range(shards) for v in range(virtual))


def arcs_of_slots(ring: list[tuple[int, int]]) -> list[int]:
    """For each equal slice of the ring, the first point clockwise from its start."""
    out, at = [], 0
    for slot in range(1 << _SLOT_BITS):
        while at < len(ring) and ring[at][0] >> (64 - _SLOT_BITS) < slot:
            at += 1
        out.append(at % len(ring))
    return out


def settle(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, ranks, shard, first slot): who goes where, shards filled clockwise up to their bound."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, left, taken, out = [0] * shards, dict(counts), dict.fromkeys(counts, 0), []
    for step in range(len(ring)):
        if not left:
            break
        for arc in sorted(left):
            shard = ring[(arc + step) % len(ring)][1]
            n = min(left[arc], room[shard])
            if n:
                out.append((arc, taken[arc], n, shard, filled[shard]))
                taken[arc] += n
                filled[shard] += n
                room[shard] -= n
                left[arc] -= n
            if not left[arc]:
                del left[arc]
    return out


def assign(docs: DataFrame, *, shards: int = SHARDS, virtual: int = VIRTUAL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard): one row for each document."""
    spark, ring = docs.sparkSession, points(shards, virtual)
    content = F.coalesce(F.col(text), F.lit(""))
    slices = F.split(F.lit(",".join(map(str, arcs_of_slots(ring)))), ",").cast("array<int>")
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _SLOT_BITS).cast("int")
    rows = checkpointed(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content).cast("bigint") + 8).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
        .withColumn("arc", F.element_at(slices, slot + 1))
        .withColumn("hash", F.xxhash64("text_crc32", "size", "doc_id"))
        # Rows of an arc stand in the order of their hash, so its first bits split them and change no result.
        .withColumn("salt", F.shiftrightunsigned("hash", 64 - _SALT_BITS).cast("int"))
    )
    counts = rows.groupBy("arc", "salt").agg(F.count("*").alias("n"))
    settled = settle({r.arc: r.n for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}, ring, shards)  # shards x virtual rows at most
    runs = spark.createDataFrame(settled, "arc int, first bigint, n bigint, shard int, first_slot bigint")
    before = W.partitionBy("arc").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("arc", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("arc", "salt").orderBy("hash", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(inside).cast("bigint") - 1).join(bases, ["arc", "salt"]).withColumn("nth", F.col("nth") + F.col("base"))
    # The settlement's size is bounded by the ring alone.
    placed = ranked.join(F.broadcast(runs), (ranked["arc"] == runs["arc"]) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("nth") - F.col("first")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the bound on counts is the law kept, so no grown shard is given."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
