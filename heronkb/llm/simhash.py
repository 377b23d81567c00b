"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle``
consecutive words joined by a space (fewer words: the whole sequence). A fingerprint bit is 1 if it is
set in more than half of the XXH64 hashes (seed 42) of all shingles, repeats included.

Edge cases: null, empty and blank texts have fingerprint 0 and link like any other; rows with a null id
take part, and a class made of null ids only has a null class id; repeated rows stay; an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.

How links are found at scale. Only distinct fingerprints are compared. Two of them with at most
``errors`` differing bits agree on at least ``exact`` of ``errors + exact`` bit blocks, so each goes to
one bucket for each choice of ``exact`` blocks, and every link lies inside some bucket. Buckets of more
than ``MOST`` fingerprints are dealt anew by further blocks, without loss. A bucket is
sorted into a binary trie; node pairs go down together and are given up once they differ in more bits
than allowed or already lie in one class. A bucket gives a spanning forest, never its pairs, and the
forests meet in distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, map_rows
from .components import connected_components
from .recovery import checkpointed
from .words import blocks

SHINGLE, ERRORS, EXACT, SEED = 4, 4, 2, 42
#: Fingerprints that one bucket may hold.
MOST = 1 << 17
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_PAIRS, _ROWS = 1 << 17, 1 << 18


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, a block of the text at a time."""
    digest, kept, any_yet = xxhash.xxh64_intdigest, [], False
    for block in blocks((text or b"").translate(_FOLD)):
        words = kept + block.split()
        kept = words[max(0, len(words) - size + 1) :]
        if len(words) >= size:
            any_yet = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - size].tolist()]
            yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)
    if kept and not any_yet:
        yield np.array([digest(b" ".join(kept), seed)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The number whose bits are those set in more than half of all hashes; 0 without hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, size, seed))


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row_key (a hash of id and text) and fp, the fingerprint as a signed 64-bit number."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(x, size, seed) for x in as_bytes(batch["text"])], np.uint64)
            return {"doc_id": batch["doc_id"], "row_key": batch["row_key"], "fp": found.view(np.int64)}

        return each

    return map_rows(picked, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, row_key bigint, fp bigint", start)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(errors: int, exact: int) -> list[int]:
    """The bits of each choice of ``exact`` out of ``errors + exact`` blocks."""
    parts = errors + exact
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in chosen) for chosen in combinations(list(zip(cuts, cuts[1:])), exact)]


def narrower(mask: int, errors: int) -> list[int]:
    """The mask with each of ``errors + 1`` blocks of its other bits: two numbers that agree on it and differ in at most
    ``errors`` bits agree on one of these too."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (errors + 1) for i in range(errors + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def buckets(distinct: DataFrame, errors: int, exact: int, most: int) -> DataFrame:
    """fp, choice, bits: every link lies inside some bucket (choice, bits), and no bucket is larger than ``most``.

    Larger ones, which fingerprints with many common bits make, are dealt anew by one more block of their
    other bits, as often as needed; nothing is dropped.
    """
    masks, at = block_masks(errors, exact), 0
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("bits")) for k, m in enumerate(masks)]))
    open_, settled = distinct.select("fp", key.alias("key")).select("fp", "key.choice", "key.bits"), None
    while True:
        crowded = checkpointed(open_.groupBy("choice", "bits").agg(F.count("*").alias("many")).where(F.col("many") > most).select("choice", "bits"))
        if crowded.isEmpty():
            return open_ if settled is None else settled.unionByName(open_)
        calm = open_.join(crowded, ["choice", "bits"], "left_anti").select("fp", "choice", "bits")
        settled = calm if settled is None else settled.unionByName(calm)
        finer = [narrower(m, errors) for m in masks[at:]]
        sub = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)).cast("bigint") for m in x]) for x in finer]), F.col("choice") - F.lit(at - 1))
        hot = open_.join(crowded, ["choice", "bits"], "left_semi").select("fp", "choice", F.posexplode(sub).alias("j", "mask"))
        at, old = len(masks), at
        masks += [m for x in finer for m in x]
        open_ = checkpointed(hot.select("fp", ((F.col("choice") - old) * (errors + 1) + F.col("j") + at).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits")))


class Forest:
    """Union-find over array positions, for arrays of pairs at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            changed = True
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            self.flatten()
        return changed

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def trie_links(bucket: np.ndarray, fp: np.ndarray, errors: int) -> np.ndarray:
    """Root position of each row. Rows are sorted by bucket, then fingerprint; links stay inside a bucket.

    Trie nodes are ranges of the sorted rows, and node pairs of all buckets go down a level at a time,
    at most about ``_PAIRS`` at once; the rest waits on a stack.
    """
    n = len(fp)
    forest = Forest(n)
    if n < 2:
        return forest.root
    same = bucket[1:] == bucket[:-1]
    close = np.flatnonzero(same & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= errors))
    forest.join(close, close + 1)
    lo = np.flatnonzero(np.concatenate(([True], ~same)))
    hi = np.append(lo[1:], n)
    many = hi - lo > 1
    changes = np.empty(0)

    def spread() -> None:
        nonlocal changes
        changes = np.concatenate(([0], np.cumsum(forest.root[1:] != forest.root[:-1])))

    spread()
    stack = [(63, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        bit, a, b, c, d, err = stack.pop()
        done = (changes[a] == changes[b - 1]) & (changes[c] == changes[d - 1]) & (forest.root[a] == forest.root[c])
        single = ~done & (b - a == 1) & (d - c == 1)
        if single.any():
            x, y = a[single], c[single]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= errors
            if forest.join(x[near], y[near]):
                spread()
        go = ~(done | single)
        a, b, c, d, err = a[go], b[go], c[go], d[go], err[go]
        if not len(a) or bit < 0:
            continue
        if len(a) > _PAIRS:
            half = len(a) // 2
            stack += [(bit, a[:half], b[:half], c[:half], d[:half], err[:half]), (bit, a[half:], b[half:], c[half:], d[half:], err[half:])]
            continue
        ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        own = a == c
        pair = ~own
        more = err + 1
        a2 = np.concatenate((a, m, a, m[pair]))
        b2 = np.concatenate((m, b, m, b[pair]))
        c2 = np.concatenate((c, k, k, c[pair]))
        d2 = np.concatenate((k, d, d, k[pair]))
        e2 = np.concatenate((err, err, more, more[pair]))
        keep = (a2 < b2) & (c2 < d2) & (e2 <= errors) & ~((a2 == c2) & (b2 - a2 == 1))
        stack.append((bit - 1, a2[keep], b2[keep], c2[keep], d2[keep], e2[keep]))
    return forest.root


def links(distinct: DataFrame, *, errors: int = ERRORS, exact: int = EXACT, most: int = MOST) -> DataFrame:
    """src, dst: a spanning forest of each bucket's links between the fingerprints ``fp``."""
    keyed = buckets(distinct, errors, exact, most).select("fp", F.xxhash64("choice", "bits").alias("bucket"), "choice", "bits")
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "choice", "bits", "fp").select("fp", "bucket", "choice", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        rows = 0

        def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp = columns[0].view(np.uint64)
            new = np.any([x[1:] != x[:-1] for x in columns[1:]], axis=0) if len(fp) else np.empty(0, bool)
            bucket = np.concatenate(([0], np.cumsum(new))) if len(fp) else fp
            order = np.lexsort((fp, bucket))
            fp, bucket = fp[order], bucket[order]
            root = trie_links(bucket, fp, errors)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[root[at]].view(np.int64))], names=["src", "dst"])

        def whole() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*kept)] if kept else [np.empty(0, np.int64)] * 4

        for batch in batches:
            kept.append([batch[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in ("fp", "bucket", "choice", "bits")])
            rows += batch.num_rows
            if rows >= _ROWS:  # the last bucket, of at most ``most`` rows, may go on
                columns = whole()
                last = np.all([x == x[-1] for x in columns[1:]], axis=0)
                cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
                if cut:
                    yield solve([x[:cut] for x in columns])
                kept, rows = [[x[cut:] for x in columns]], len(last) - cut
        yield solve(whole())

    return dealt.mapInArrow(run, "src bigint, dst bigint")


def classes_of(prints: DataFrame, *, errors: int = ERRORS, exact: int = EXACT, most: int = MOST) -> DataFrame:
    """fp, class, component_id for each distinct fingerprint of ``prints`` (doc_id, fp), which is read more than once.

    Nodes are ordered by their least id, nulls last, so a component's least node already carries its
    least id, and no class meets in one task to be told it.
    """
    firsts = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", F.struct(F.col("id").isNull().alias("last"), "id", "fp").alias("at")))
    forest = links(firsts.select("fp"), errors=errors, exact=exact, most=most)
    ends = forest.join(firsts.select(F.col("fp").alias("src"), F.col("at").alias("a")), "src").join(firsts.select(F.col("fp").alias("dst"), F.col("at").alias("b")), "dst")
    found = connected_components(ends, "a", "b").select(F.col("node.fp").alias("fp"), "component")
    least = F.coalesce("component", "at")
    return firsts.join(found, "fp", "left").select("fp", least["fp"].alias("class"), least["id"].alias("component_id"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, errors: int = ERRORS, exact: int = EXACT, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id: the least id of all documents that links reach, for each document row."""
    prints = checkpointed(fingerprints(docs, doc_id=doc_id, text=text, size=size, seed=seed))
    return prints.join(classes_of(prints, errors=errors, exact=exact), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, errors: int = ERRORS, exact: int = EXACT, seed: int = SEED) -> DataFrame:
    """The documents, all columns kept, with one row of each class: that of the least id, null ids last.

    Of rows that share id and text, the least by all columns in order stays. Texts are shuffled once, by
    the hash of id and text; the join and the choice among equals use that one order.
    """
    prints = checkpointed(fingerprints(docs, doc_id=doc_id, text=text, size=size, seed=seed))
    return first_of_each(docs, prints.join(classes_of(prints, errors=errors, exact=exact), "fp"), doc_id=doc_id, text=text)


def first_of_each(docs: DataFrame, members: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``keep_one`` keeps of the classes in ``members`` (doc_id, row_key, class)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("f")
    keep = members.groupBy("class").agg(first).select(F.col("f.row_key").alias("__key"), F.col("f.doc_id").alias("__kept"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row_key(doc_id, text).alias("__key"), F.col(f"`{doc_id}`").alias("__id"), whole)
    # Not a null-safe equality, which would become a join key and deal the texts anew before the grouping.
    same = F.coalesce(rows["__id"] == keep["__kept"], rows["__id"].isNull() & keep["__kept"].isNull())
    chosen = rows.join(keep, (rows["__key"] == keep["__key"]) & same, "left_semi")
    return chosen.groupBy("__key", "__id").agg(F.min("__row").alias("__row")).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
