"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams, skip-grams and word beginnings.

A-Z are lower-cased and words are maximal runs of ASCII letters, digits and code points from U+0080 on.
A text's features are the distinct hashes of its words, word pairs, pairs with one word skipped and word
beginnings of a few bytes (inflected forms of one stem share those), over whole texts. Each coordinate
has its own learning rate, and L1 leaves most weights at exactly zero, so what is broadcast is a short
list of (index, weight).

Learning. At most ``max_rows`` labelled documents, least by a hash of their id, are learned from, in the
order of that hash (a documented bound). Features are hashed where the documents lie; one task then gets
their indices only, and takes documents in that order while they have at most ``max_features`` indices
together (256 MB). Rows whose crc32(id as text) mod 3 is 1 are held out. Scoring reads every document
once, in place.

Edge cases: null and empty texts have no features and get the score of the intercept; null ids are
scored, never learned from; null labels are not learned from; of repeated labels all are learned from;
without labels every score is 0.5 and nothing is rejected; an empty table gives no rows; other columns
are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, map_rows, pass_rows
from .words import ALNUM, Hashed, Powers, blocks, mix

BITS, MAX_ROWS, MAX_FEATURES, THRESHOLD = 20, 12_000, 1 << 26, 0.7
STEMS = (5, 6, 7, 8)


class Ftrl(NamedTuple):
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 4


class Features:
    def __init__(self, bits: int = BITS) -> None:
        self.shift, self.powers = np.uint64(64 - bits), Powers()

    def _index(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64))) >> self.shift).astype(np.int32)

    def of(self, text: bytes | None) -> Iterator[np.ndarray]:
        """Indices of a text's features, with repeats, a block at a time."""
        kept: list[bytes] = []
        for block in blocks((text or b"").translate(ALNUM)):
            words = kept + block.split()
            kept = words[-2:]
            if not words:
                continue
            h = Hashed(words, self.powers)
            one, length = h.runs(1), h.ends - h.starts
            yield self._index(one, 1)
            yield self._index(h.runs(2), 2)
            yield self._index(one[:-2] * np.uint64(0x9E3779B97F4A7C15) + one[2:], 3)
            for k in STEMS:
                at = h.starts[length >= k]
                yield self._index((h.prefix[at + k] - h.prefix[at]) * h.down[at], 10 + k)

    def distinct(self, text: bytes | None) -> np.ndarray:
        parts = list(self.of(text))
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def train(rows: list[tuple[np.ndarray, int]], options: Ftrl, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and intercept; the intercept is a coordinate without L1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, options.l1)
    penalty[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(z[at]) - penalty[at], 0.0)
        return -np.sign(z[at]) * over / ((options.beta + np.sqrt(n[at])) / options.alpha + options.l2)

    for _ in range(options.epochs):
        for found, label in rows:
            at = np.append(found, size - 1)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / options.alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, options: Ftrl = Ftrl(), bits: int = BITS) -> DataFrame:
    """index, weight: the weights that are not zero, and the intercept at index -1."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    # Ids and labels of max_rows documents at most: small enough to send to every task.
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("place", "doc_id", "label", "text")

    def hashed() -> Callable[[pa.RecordBatch], dict]:
        features = Features(bits)
        return lambda batch: {"place": batch["place"], "label": batch["label"], "found": [features.distinct(x) for x in as_bytes(batch["text"])]}

    found = map_rows(texts, "place bigint, label int, found array<int>", hashed, "text", 1 << 21)
    first = found.repartition(1).sortWithinPartitions("place", "label", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        room = max_features
        for batch in batches:
            column = batch["found"]
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for a, b, label in zip(ends[:-1].tolist(), ends[1:].tolist(), batch["label"].to_pylist()):
                if b - a <= room:
                    rows.append((values[a:b].copy(), label))
                room -= b - a  # once over, nothing more is taken
        w, bias = train(rows, options, bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(w[at], bias))], names=["index", "weight"])

    return first.mapInArrow(run, "index bigint, weight double")


class Model:
    """Broadcastable weights."""

    def __init__(self, rows: list[tuple[int, float]], bits: int = BITS) -> None:
        self.bits, self.bias = bits, sum(w for i, w in rows if i < 0)
        self.index = np.array([i for i, _ in rows if i >= 0], np.int32)
        self.weight = np.array([w for i, w in rows if i >= 0])

    def scorer(self) -> Callable[[bytes | None], float]:
        dense = np.zeros(1 << self.bits)
        dense[self.index] = self.weight
        counts, features = dense != 0, Features(self.bits)

        def score(text: bytes | None) -> float:
            met = [x[counts[x]] for x in features.of(text)]
            total = self.bias + (float(dense[np.unique(np.concatenate(met))].sum()) if met else 0.0)
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))

        return score


def model(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fits and fetches the weights: at most one for each of the 2**bits coordinates, in practice a few thousand."""
    rows = [(r.index_, r.weight) for r in fit(docs, labels, **options).withColumnRenamed("index", "index_").collect()]
    return Model(rows, options.get("bits", BITS))


def score(docs: DataFrame, fitted: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def start():
        one = shared.value.scorer()
        return lambda batch: {"doc_id": batch["doc_id"], "score": [one(x) for x in as_bytes(batch["text"])]}

    return map_rows(picked, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double", start, "text", 1 << 22)


def drop_toxic(docs: DataFrame, fitted: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def start():
        one = shared.value.scorer()
        return lambda batch: batch.filter(pa.array([one(x) < threshold for x in as_bytes(batch[text])], pa.bool_()))

    return pass_rows(docs, start, text, 1 << 22)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, model(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
