"""Benchmark decontamination: find the word windows of test items in documents, then cut spans or drop documents.

Rules. A-Z are lower-cased and words are maximal runs of ASCII letters, digits and code points from
U+0080 on. A window is ``n`` consecutive words of an item; an item of 1 to n-1 words is one window of
its own length, an item without words has none. Each document word inside any occurrence of a window
is hit.

Edge cases: a null or empty text has no words; a null item text or null item id gives no window and no
name respectively (windows of a null id still hit); repeated items and rows are judged each on its own;
an empty benchmark or table gives no hits or no rows; other columns of the inputs are ignored by
``scan`` and kept by ``drop_contaminated`` and ``cut_spans``.

Scale: the benchmark is broadcast in blocks of at most ``block_bytes`` of item text (measured first). A
block is sorted arrays, 20 bytes for each window, beside the joined words of its items. Documents are
read once for each block, which is once for any usual benchmark, and never move. All findings are made
on the original text, so results don't depend on the number of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import as_bytes, map_rows, pass_rows
from .words import ALNUM, Hashed, Powers, blocks

BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22


class Windows:
    """The windows of some items by length: sorted hashes, and for each its place in the joined words and its item."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int) -> None:
        powers = Powers()
        self.n, self.names = n, [k for k, _ in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        joined, at = [], 0
        for i, (_, text) in enumerate(items):
            words = (text or b"").translate(ALNUM).split()
            if words:
                size = min(n, len(words))
                hashed = Hashed(words, powers)
                starts, ends = hashed.starts[: len(words) - size + 1], hashed.ends[size - 1 :]
                parts[size].append((hashed.runs(size), (starts + at).astype(np.uint32), (ends - starts).astype(np.uint32), np.full(len(starts), i, np.int32)))
                joined.append(hashed.joined)
                at += len(hashed.joined)
        self.joined = b"".join(joined)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted(parts):
            columns = [np.concatenate(x) for x in zip(*parts.pop(size))]
            order = np.argsort(columns[0], kind="stable")
            self.tables[size] = tuple(x[order] for x in columns)

    def filters(self) -> dict[int, np.ndarray]:
        out = {}
        for size, (hashes, *_) in self.tables.items():
            out[size] = np.zeros(1 << _FILTER_BITS, bool)
            out[size][hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return out

    def owners(self, size: int, h: np.uint64, run: bytes) -> list[int]:
        """Items that have a window of exactly these words."""
        hashes, starts, lengths, items = self.tables[size]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        return [int(items[e]) for e in range(lo, hi) if self.joined[starts[e] : int(starts[e]) + int(lengths[e])] == run]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, windows: Windows) -> None:
        self.w, self.maybe, self.powers = windows, windows.filters(), Powers()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit word spans [start, end) merged and in order, and the items that occur."""
        total, found, items, kept = 0, [], set(), []
        for block in blocks((text or b"").translate(ALNUM)):
            fresh = block.split()
            words, base = kept + fresh, total - len(kept)
            total += len(fresh)
            kept = words[max(0, len(words) - self.w.n + 1) :]
            if not words:
                continue
            hashed = Hashed(words, self.powers)
            for size, (table, *_) in self.w.tables.items():
                h = hashed.runs(size)
                at = np.flatnonzero(self.maybe[size][h >> np.uint64(64 - _FILTER_BITS)])
                if len(at):
                    place = np.searchsorted(table, h[at])
                    at = at[table[np.minimum(place, len(table) - 1)] == h[at]]
                for i in at.tolist():
                    if owners := self.w.owners(size, h[i], hashed.run(i, size)):
                        items.update(owners)
                        found.append((base + i, base + i + size))
        return total, merged(found), items


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """Parts of the benchmark that hold about ``block_bytes`` of text each."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items for k in range(parts)]


def _scanners(spark: SparkSession, benchmark: DataFrame, n: int, item: str, text: str, block_bytes: int) -> list[Callable[[], Scanner]]:
    out = []
    for part in item_blocks(benchmark, item, text, block_bytes):
        rows = part.select("item", F.col("text").cast("binary").alias("text")).collect()  # block_bytes at most, as measured
        windows = spark.sparkContext.broadcast(Windows([(r.item, bytes(r.text) if r.text is not None else None) for r in rows], n))
        out.append(lambda w=windows: Scanner(w.value))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit words, [start, end)), items (ids as sorted strings): a row for each document row."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, twin bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def stage(make: Callable[[], Scanner], rows: DataFrame) -> DataFrame:
        def start():
            scanner = make()

            def each(batch: pa.RecordBatch) -> dict:
                out = {"doc_id": batch["doc_id"], "twin": batch["twin"], "n_words": [], "spans": [], "items": []}
                for x in as_bytes(batch["text"]):
                    total, spans, items = scanner.scan(x)
                    out["n_words"].append(total)
                    out["spans"].append([{"start": a, "end": b} for a, b in spans])
                    out["items"].append(sorted({scanner.w.names[i] for i in items if scanner.w.names[i] is not None}))
                return out

            return each

        return map_rows(rows, shape, start)

    makers = _scanners(docs.sparkSession, benchmark, n, item_id, item_text, block_bytes)
    if len(makers) == 1:
        return stage(makers[0], picked.withColumn("twin", F.lit(0).cast("bigint"))).drop("twin")
    # Rows with equal id and text have equal results, so each block's findings meet under the two.
    keyed = picked.withColumn("twin", F.xxhash64("text"))
    every = stage(makers[0], keyed)
    for make in makers[1:]:
        every = every.unionByName(stage(make, keyed))
    met = every.groupBy("doc_id", "twin").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    keys = keyed.select(F.col("doc_id").alias("left_id"), F.col("twin").alias("left_twin"))
    whole = keys.join(met, F.col("left_id").eqNullSafe(F.col("doc_id")) & (F.col("left_twin") == F.col("twin"))).select("doc_id", "n_words", "spans", "items")

    def join() -> Callable[[pa.RecordBatch], dict]:
        def each(batch: pa.RecordBatch) -> dict:
            spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row])] for row in batch["spans"].to_pylist()]
            return {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "spans": spans, "items": batch["items"]}

        return each

    return map_rows(whole, shape.replace("twin bigint, ", ""), join)


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])


def _word_bytes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    starts, ends = _word_bytes(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns kept, in which no window of any item occurs."""
    for make in _scanners(docs.sparkSession, benchmark, n, item_id, item_text, block_bytes):

        def start(make=make):
            scanner = make()
            return lambda batch: batch.filter(pa.array([not scanner.scan(x)[1] for x in as_bytes(batch[text])], pa.bool_()))

        docs = pass_rows(docs, start)
    return docs


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents and columns, with every occurrence of a window cut out of the text.

    All spans are found on the original text, block after block of a large benchmark, and cut at once.
    """
    makers = _scanners(docs.sparkSession, benchmark, n, item_id, item_text, block_bytes)
    columns, carried = docs.columns, "spans"
    while carried in columns:
        carried += "_"
    if len(makers) > 1:
        docs = docs.withColumn(carried, F.array().cast("array<struct<start:bigint,end:bigint>>"))
    for k, make in enumerate(makers):

        def start(make=make, last=k == len(makers) - 1):
            scanner = make()

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = as_bytes(batch[text])
                before = batch[carried].to_pylist() if len(makers) > 1 else [[]] * len(texts)
                spans = [merged([(s["start"], s["end"]) for s in old] + scanner.scan(x)[1]) for x, old in zip(texts, before)]
                if last:
                    name, values = text, pa.array([x if x is None or not s else cut(x, s) for x, s in zip(texts, spans)], pa.binary())
                else:
                    name, values = carried, pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], batch[carried].type)
                place = batch.schema.get_field_index(name)
                return batch.set_column(place, batch.schema.field(place), values.cast(batch.schema.field(place).type))

            return each

        docs = pass_rows(docs, start)
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: counts of words, hits and items, and the hash of the item ids."""
    found = scan(docs, benchmark)
    hits = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


#: The same by SQL: windows of documents joined with windows of items. For small tables.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
