"""Order MinHash fingerprints: likeness that falls with edit distance, not with set overlap alone.

Every k-mer (``k`` consecutive code points) is numbered among its equals from the left. For each of
``size`` hash functions the ``2`` least (k-mer, number) pairs are taken, put back into text order, and
the pair of k-mers is hashed to one component of the fingerprint. The likeness of two fingerprints is
the share of equal components.

Edge cases: a null text counts as empty; an empty text has a fingerprint of zeros; a text shorter than
``k`` is one k-mer; equal texts have equal fingerprints. Documents follow each other by descending id,
null ids last, equal ids by text, and the first follows the last, so a single document follows itself;
an empty table gives no rows; other columns are ignored.

Scale: texts are shuffled once, into ranges of ids, and sorted inside them; a range sees the first text
of the next one as a guest row. Nothing is done in one task, and only the ranges' bounds reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .words import Powers, mix

K, SIZE = 8, 64
_COLUMNS = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint32(0xFFFFFFFF)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Sketcher:
    def __init__(self, k: int = K, size: int = SIZE) -> None:
        self.k, self.size = k, size
        self.factors = (mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) >> np.uint64(32) | np.uint64(1)).astype(np.uint32)[:, None]
        self.rows, self.powers = np.arange(size), Powers()
        self.work = np.empty((size, _COLUMNS), np.uint32)

    def numbered(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k-mer, and of each k-mer with its number among its equals, in text order."""
        k = min(self.k, len(c))
        n = len(c) - k + 1
        up, down = self.powers.to(len(c) + 1)
        prefix = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * up[: len(c)], out=prefix[1:])
        h = mix((prefix[k:] - prefix[:n]) * down[:n])
        bits = np.uint64(n.bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        order = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        at = (order & low).astype(np.int64)
        new = np.concatenate(([True], (order[1:] & ~low) != (order[:-1] & ~low)))
        index = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[at] = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
        return h, (mix(h + nth * _STEP) >> np.uint64(32)).astype(np.uint32)

    def least(self, v: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Values and places of the two least of each hash function, ties to the left; ``first`` is the place of v[0]."""
        best = None
        for a in range(0, len(v), _COLUMNS):
            some = v[a : a + _COLUMNS]
            part = np.multiply(some, self.factors, out=self.work[:, : len(some)])
            one = part.argmin(axis=1)
            low = part[self.rows, one]
            if len(some) > 1:
                part[self.rows, one] = _TOP
                two = part.argmin(axis=1)
                found = np.stack((low, part[self.rows, two]), 1), np.stack((one, two), 1) + (first + a)
            else:
                found = low[:, None], one[:, None] + (first + a)
            best = self.merge(best, found)
        return best

    def merge(self, x: tuple[np.ndarray, np.ndarray] | None, y: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        if x is None or y is None:
            return x or y
        value, place = np.concatenate((x[0], y[0]), 1), np.concatenate((x[1], y[1]), 1)
        order = np.argsort(value, axis=1, kind="stable")[:, :2]
        return np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)

    def signature(self, best: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        place = np.sort(best[1], axis=1)
        late = h[place[:, -1]]
        return (mix(h[place[:, 0]] * _STEP + late if place.shape[1] > 1 else late) >> np.uint64(48)).astype(np.uint16)

    def of(self, c: np.ndarray) -> np.ndarray:
        if not len(c):
            return np.zeros(self.size, np.uint16)
        h, v = self.numbered(c)
        return self.signature(self.least(v, 0), h)

    def of_both(self, c: np.ndarray, edited: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a text and of an edited one that agree on the first ``shared`` code points.

        The k-mers inside the shared part have equal numbers in both and are looked at once.
        """
        inside = shared - self.k + 1
        if inside < 1:
            return self.of(c), self.of(edited)
        h, v = self.numbered(c)
        g, w = self.numbered(edited)
        both = self.least(v[:inside], 0)
        return self.signature(self.merge(both, self.least(v[inside:], inside)), h), self.signature(self.merge(both, self.least(w[inside:], inside)), g)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint: one row for each document, in place."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def start():
        sketcher = Sketcher(k, size)
        return lambda batch: {"doc_id": batch["doc_id"], "fingerprint": [as_text(sketcher.of(codes(x or ""))) for x in batch["text"].to_pylist()]}

    return map_rows(picked, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fingerprint string", start)


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, guest: rows by descending id inside partitions; each ends with the next one's first text as a guest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.split(F.lit(",".join(map(str, sorted(set(cuts))))), ",").cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull() | F.lit(not cuts), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))).alias("part")
    heads = sorted(rows.select("doc_id", part).groupBy("part").agg(F.max("doc_id").alias("head")).collect(), reverse=True, key=lambda r: r.part)
    after = [(heads[(i + 1) % len(heads)].head, r.part) for i, r in enumerate(heads)]
    # One row for each range.
    wanted = F.broadcast(spark.createDataFrame(after, "head bigint, part int"))
    guests = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min("text").alias("text")).select(F.lit(None).cast("bigint").alias("doc_id"), "text", "part", F.lit(1).alias("guest"))
    own = rows.select("doc_id", "text", part, F.lit(0).alias("guest"))
    return own.unionByName(guests).repartitionById(parts, F.col("part")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text", "guest")


def edit_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """The contract's columns: each text, its last third replaced by the next one's start, and the likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, size)
        last: tuple | None = None  # id, text, code points
        waiting: tuple | None = None  # the row before, which lacks its likeness to the next

        for batch in batches:
            out: dict = {name: [] for name in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}

            def put(row: tuple, nearness: float) -> None:
                for name, value in zip(out, (*row, nearness)):
                    out[name].append(value)

            for key, content, guest in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist()):
                if last is not None:
                    cut = len(last[1]) // 3
                    edited = last[1][: len(last[1]) - cut] + content[:cut]
                    own, other = sketcher.of_both(last[2], codes(edited), len(last[1]) - cut)
                    if waiting is not None:
                        put(waiting[0], likeness(waiting[1], own))
                    waiting = (last[0], len(last[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other)), own
                    if guest:
                        put(waiting[0], likeness(own, sketcher.of(codes(content))))
                        waiting = None
                last = None if guest else (key, content, codes(content))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=list(out))

    ordered = in_order(docs, doc_id, text)
    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
