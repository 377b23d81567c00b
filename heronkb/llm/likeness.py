"""Near-duplicates by exact Jaccard likeness of word shingles: the rule of the pipeline's SimHash stage.

Words and shingles are those of ``simhash`` (A-Z lower-cased, split at ASCII white space), ``SIZE`` words
each. Two documents are linked if their sets of shingles have a Jaccard likeness of ``LEAST`` or more,
and a class is what links reach. Sets are compared as 64-bit hashes; equal sets are one node.

First ``simhash.links``, the trie self-join over the fingerprints of all nodes, gives a forest of nodes
whose fingerprints differ in few bits, whether or not any band brings them together; its edges are
checked exactly and make the first classes. At 0.8 two fingerprints differ in about
10 of 64 bits, give or take 3, where a trie prunes nothing and all pairs would be compared; so the other
candidates are nodes that agree in a band of MinHash values: a pair at 0.8 is missed with a chance of
(1 - 0.8 ** ROWS) ** BANDS, 1.5 in 100,000. Of these, pairs in one class already are settled. First the
pairs whose sketches look like 0.8 or more are checked exactly, large buckets through a few of their
members chosen by a hash, since dense groups become one class by that. Then every other pair whose
sketches differ in at most ``MOST_OFF`` places (a pair at 0.8 differs in more with a chance of about 1 in
10,000) is checked exactly inside the join of its bucket, which gives out links only, never pairs.

Edge cases: null, empty and blank texts have the same empty set; repeated rows and null ids are as in
``simhash.keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrow import as_bytes, map_rows
from .components import connected_components
from .recovery import checkpointed, release
from .simhash import SEED, first_of_each, row_key, shingle_hashes

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 28, 5
#: Sketch: four bits of each MinHash value, sixteen in a number. At 0.8 places differ with a chance of 0.2 * 15 / 16.
LONGS, MOST_OFF, LIKELY_OFF = -(-BANDS * ROWS // 16), 44, 26
#: First rounds: (bands, members of a large bucket that all others meet). Buckets of up to ``_ALL`` meet all with all.
_ROUNDS = ((4, 1), (BANDS, 16))
_ALL, _STEP = 4, 1 << 12


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = list(shingle_hashes(text, size, SEED))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)


def minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (factors[:, None] * hashes[None, at : at + _STEP]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One key for each band of MinHash values."""
    kept = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(kept)]


def sketch(least: np.ndarray) -> list[int]:
    """The lowest four bits of each value, packed."""
    four = np.zeros(LONGS * 16, np.uint64)
    four[: len(least)] = least & np.uint64(15)
    packed = np.bitwise_or.reduce(four.reshape(LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)
    return packed.view(np.int64).tolist()


def places_off(a: list[Column], b: list[Column]) -> Column:
    """Number of four-bit places in which two sketches differ."""

    def one(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda s, x: s + x, (one(x.bitwiseXOR(y)) for x, y in zip(a, b)))


def sketches(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, row_key, node (a hash of the set), n (its size), fp (SimHash fingerprint), bands, sketch; no bands where the set is empty."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))

    def start():
        factors = _factors()

        def each(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "row_key": batch["row_key"], "node": [], "n": [], "fp": [], "bands": [], "sketch": []}
            for x in as_bytes(batch["text"]):
                parts = list(shingle_hashes(x, size, SEED))
                found = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                least = minima(found, factors)
                out["node"].append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED) - (1 << 63))
                out["n"].append(len(found))
                out["fp"].append(simhash.majority(parts))
                out["bands"].append(bands(least) if len(found) else [])
                out["sketch"].append(sketch(least))
            out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
            return out

        return each

    return map_rows(picked, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, row_key bigint, node bigint, n bigint, fp bigint, bands array<bigint>, sketch array<bigint>", start)


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """node, shingles for the rows named by ``wanted`` (node, row_key)."""
    rows = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("text")).join(wanted, "row_key").select("node", "text")

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            return {"node": batch["node"], "shingles": [shingle_set(x, size).view(np.int64) for x in as_bytes(batch["text"])]}

        return each

    return map_rows(rows, "node bigint, shingles array<bigint>", start).dropDuplicates(["node"])


def _as_alike(x: str, y: str, least: float) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both) >= least


def alike(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(_as_alike("x", "y", least)).select("a", "b")


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: the forest of the trie self-join over the nodes' fingerprints; nodes of one fingerprint hang on the least of them."""
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    forest = simhash.links(firsts.select("fp"))
    src, dst = firsts.select(F.col("fp").alias("src"), F.col("first").alias("a")), firsts.select(F.col("fp").alias("dst"), F.col("first").alias("b"))
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return forest.join(src, "src").join(dst, "dst").select("a", "b").unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, prints: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """node, component for every node that is alike another. ``prints``: the checkpointed sketches."""
    names = [f"s{i}" for i in range(LONGS)]
    nodes = prints.groupBy("node").agg(F.min(F.struct("row_key", "n", "fp", "bands", "sketch")).alias("one")).select("node", "one.*")
    keyed = nodes.select("node", "row_key", "n", F.posexplode("bands").alias("band", "bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    # A place on [0, 1) in each bucket: the members below first / many are those that all others meet.
    place = (F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("place")
    seats = checkpointed(keyed.join(crowded, "bucket").select("band", "bucket", "many", "node", "row_key", "n", place))
    trie = checkpointed(_trie_pairs(nodes.where("n > 0").select("node", "fp")))  # the one node without shingles has no partner
    met = trie.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row_key"), "node")
    known = seats.select("node", "row_key").unionByName(met.select("node", "row_key")).distinct()
    sets = checkpointed(_sets(docs, known, doc_id, text, size))
    marked = checkpointed(nodes.join(seats.select("node"), "node", "left_semi").select("node", *[F.col("sketch")[i].alias(x) for i, x in enumerate(names)]))
    seen = docs.sparkSession.createDataFrame([], "node bigint, component bigint")

    def live(bands: int) -> DataFrame:
        """Rows of the buckets in which classes still meet."""
        rows = seats.where(F.col("band") < bands).join(seen, "node", "left").select("bucket", "many", "node", "n", "place", F.coalesce("component", "node").alias("class"))
        split = rows.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
        return checkpointed(rows.join(split, "bucket", "left_semi").join(marked, "node"))

    def meeting(rows: DataFrame, first: int | None, most: int) -> tuple[DataFrame, Column]:
        """The rows that others meet, renamed, and the condition under which two rows are a candidate pair."""
        pivot = F.lit(True) if first is None else (F.col("many") <= _ALL) | (F.col("place") < F.lit(first) / F.col("many"))
        other = rows.select("bucket", *[F.col(c).alias(f"o_{c}") for c in rows.columns if c not in ("bucket", "many", "place")], pivot.alias("o_pivot"))
        fits = (F.col("class") != F.col("o_class")) & (F.least("n", "o_n") >= least * F.greatest("n", "o_n") - 1e-6)
        return other, fits & (pivot | F.col("o_pivot")) & (places_off([F.col(x) for x in names], [F.col(f"o_{x}") for x in names]) <= most)

    def link(new: DataFrame) -> DataFrame:
        joined = new.unionByName(seen.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        return checkpointed(connected_components(joined, "a", "b"))

    for k, (bands, first) in enumerate(_ROUNDS):
        rows = live(bands)
        other, near = meeting(rows, first, LIKELY_OFF)
        pairs = rows.join(other.where("o_pivot"), "bucket").where(near).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
        if k == 0:
            pairs = pairs.unionByName(trie)
        seen = link(alike(pairs.distinct(), sets, least))
        release(docs.sparkSession)
    rows = live(BANDS)
    other, near = meeting(rows, None, MOST_OFF)
    # Sets go only to the rows that have a candidate partner.
    rows = checkpointed(rows.alias("r").join(other, (F.col("r.bucket") == other["bucket"]) & near, "left_semi")).join(sets, "node")
    other, near = meeting(rows, None, MOST_OFF)
    found = rows.join(other, (rows["bucket"] == other["bucket"]) & (F.col("node") < F.col("o_node")) & near & _as_alike("shingles", "o_shingles", least))
    return link(found.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct())


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The documents, all columns kept, with one row of each class, as ``simhash.keep_one`` chooses it."""
    prints = checkpointed(sketches(docs, doc_id=doc_id, text=text, size=size))
    found = links(docs, prints, doc_id=doc_id, text=text, size=size, least=least)
    release(docs.sparkSession)
    members = prints.select("doc_id", "row_key", "node").join(found, "node", "left").select("doc_id", "row_key", F.coalesce("component", "node").alias("class"))
    return first_of_each(docs, members, doc_id=doc_id, text=text)
