"""The k best cosines of many queries, as matrix products over batches of vectors; rows are partitioned by Spark.

Products of unit vectors in single precision say which pairs can be among the k best, with a bound on their error; those
pairs alone get the cosine in double precision, summed in the order of the elements as ``retrieval.cosine`` does, so scores
are the same to the bit. They are rounded to six places, half up in decimals, and ranked with the key before anything is
cut, so equal scores keep the least keys.

Null vectors, ones with a null element, of another length than the query, or of zeros only have no cosine and no row.
Vectors that are not finite, or whose squares leave the range of doubles, are scored against every query exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vectors and queries whose products are held at once: 4 MB in single precision.
ROWS, QUERIES = 1024, 1024
#: Elements of pairs that are multiplied at once: 2 MB of doubles.
ELEMENTS = 1 << 18
#: Parts of candidates that wait at most, however small they are.
PARTS = 256
#: What is no number of millionths: not-a-number, infinities.
_NAN, _MOST = np.iinfo(np.int64).max, 1 << 62
_MICRO = 1_000_000


class Side:
    """Vectors of one length: doubles, norms, the same scaled to length one in single precision, and which are odd."""

    def __init__(self, at: np.ndarray, values: np.ndarray) -> None:
        self.at, self.values = at, values
        with np.errstate(all="ignore"):
            square = np.zeros(len(values))
            for column in values.T:
                square += column * column
            self.norm = np.sqrt(square)
            self.odd = ~((square > 1e-200) & (square < 1e200))
            unit = values / np.where(self.odd, 1.0, self.norm)[:, None]
        unit[self.odd] = 0.0
        self.unit = unit.astype(np.float32)

    def part(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.at, out.values, out.norm, out.odd, out.unit = self.at[a:b], self.values[a:b], self.norm[a:b], self.odd[a:b], self.unit[a:b]
        return out


def sides(column: pa.ListArray) -> dict[int, Side]:
    """Usable vectors by length; ``at`` is their place in the column."""
    lengths = pc.list_value_length(column)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without the elements of null rows
    if flat.null_count:
        holes = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
        ends = np.cumsum(sizes)
        whole = holes[ends] == holes[ends - sizes]
    else:
        whole = np.ones(len(sizes), bool)
    values, starts = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == n) & whole)
        if len(at) == len(sizes):
            matrix = values.reshape(-1, n).astype(np.float64)
        else:
            matrix = values[starts[at][:, None] + np.arange(n)].astype(np.float64)
        if len(at):
            out[n] = Side(at, matrix)
    return out


def micros(scores: np.ndarray) -> np.ndarray:
    """Millionths, half up in the decimals that a double is written with; not-a-number above all, as Spark orders it."""
    with np.errstate(all="ignore"):
        scaled = scores * _MICRO
        whole = np.floor(scaled)
        out = np.where(np.isfinite(scores), np.floor(scaled + 0.5), 0)
        halves = np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-5)
    for i in halves.tolist():
        out[i] = int(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    out = out.astype(np.int64)
    out[np.isnan(scores)], out[np.isposinf(scores)], out[np.isneginf(scores)] = _NAN, _MOST, -_MOST
    return out


def scores_of(millionths: np.ndarray) -> np.ndarray:
    odd = np.where(millionths == _NAN, np.nan, np.where(millionths > 0, np.inf, -np.inf))
    return np.where(np.abs(millionths) < _MOST, millionths / _MICRO, odd)


def exact(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the pairs, and which of them exist."""
    with np.errstate(all="ignore"):
        dot = np.empty(len(i))
        n = max(1, ELEMENTS // a.values.shape[1])
        for at in range(0, len(i), n):
            part = slice(at, at + n)
            dot[part] = np.add.accumulate(a.values[i[part]] * b.values[j[part]], axis=1)[:, -1]  # a sum would pair elements up
        size = a.norm[i] * b.norm[j]
        return dot / size, size != 0


def first_of(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, in order."""
    order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("micros", "descending"), ("key", "ascending")], null_placement="at_start")
    table = table.take(order)
    q = table["q"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return table.filter(pa.array(place < k))


class Best:
    """The k best of one block of queries so far; what may be among them waits until it is as much as they are, and is ranked then."""

    def __init__(self, queries: Side, k: int, key: pa.DataType) -> None:
        self.queries, self.k = queries, k
        self.table = pa.table({"q": pa.array([], pa.int32()), "micros": pa.array([], pa.int64()), "key": pa.array([], key)})
        self.least = np.full(len(queries.at), -np.inf)
        self.waiting: list[pa.Table] = []
        self.n_waiting = 0
        self.error = (queries.values.shape[1] + 8) * 1.2e-7

    def see(self, rows: Side, keys: pa.Array) -> None:
        near = self.queries.unit @ rows.unit.T
        bar = self.least
        if near.shape[1] > self.k and not np.isfinite(bar).all():
            normal = near[:, ~rows.odd]
            if normal.shape[1] >= self.k:
                kth = np.partition(normal, normal.shape[1] - self.k, axis=1)[:, normal.shape[1] - self.k].astype(np.float64)
                bar = np.maximum(bar, kth - self.error)
        can = near >= (bar - self.error - 2.0 / _MICRO)[:, None].astype(np.float32)
        can[:, rows.odd] = False
        can[self.queries.odd] = False
        can[:, rows.odd & (rows.norm != 0)] = True  # vectors of zeros have no cosine, unless the other's length is no number
        can[self.queries.odd & (self.queries.norm != 0)] = True
        some = np.flatnonzero(can.any(axis=1))  # after the first rows few queries gain anything
        if not len(some):
            return
        i, j = np.divmod(np.flatnonzero(can[some]), can.shape[1])
        i = some[i]
        score, there = exact(self.queries, i, rows, j)
        i, j, score = i[there], j[there], score[there]
        self.waiting.append(pa.table({"q": pa.array(i.astype(np.int32)), "micros": pa.array(micros(score)), "key": keys.take(pa.array(rows.at[j]))}))
        self.n_waiting += len(i)
        if self.n_waiting >= self.k * len(self.least) or len(self.waiting) >= PARTS:
            self.rank()

    def rank(self) -> None:
        """What waits takes its place, and the least scores rise."""
        self.table = first_of(pa.concat_tables([self.table, *self.waiting]), self.k)
        self.waiting, self.n_waiting = [], 0
        q, value = self.table["q"].to_numpy(), self.table["micros"].to_numpy()
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.empty(0, np.int64)
        full = last[np.bincount(q, minlength=len(self.least))[q[last]] == self.k]
        full = full[np.abs(value[full]) < _MOST]
        self.least[q[full]] = value[full] / _MICRO


def best(batches: Iterator[pa.RecordBatch], queries: dict[int, Side], ids: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, key, score: of the batches' rows (key, embedding) the k best for each query."""
    held: dict[int, list[Best]] = {}
    for batch in batches:
        for n, rows in sides(batch["embedding"]).items():
            if n not in queries:
                continue
            if n not in held:
                held[n] = [Best(queries[n].part(a, a + QUERIES), k, batch.schema.field("key").type) for a in range(0, len(queries[n].at), QUERIES)]
            for a in range(0, len(rows.at), ROWS):
                part = rows.part(a, a + ROWS)
                for one in held[n]:
                    one.see(part, batch["key"])
    for blocks in held.values():
        for one in blocks:
            one.rank()
            q, value = one.table["q"].to_numpy(), one.table["micros"].to_numpy()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(one.queries.at[q])), one.table["key"].combine_chunks(), pa.array(scores_of(value), from_pandas=False)], names=["query_id", "key", "score"])
