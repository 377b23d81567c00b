"""Best-fit packing of documents into fixed-size token sequences, large items matched first.

Each document is tokenised and ``end_id`` follows; only documents longer than ``capacity`` are cut, into
pieces of ``capacity`` tokens of which the last may be shorter. Full pieces are sequences of their own.
Items above a third of the capacity come at most twice in a sequence and are matched greedily: the
largest takes the largest partner that still fits. All smaller items then go, largest first, to the
fullest sequence that has room, or open a new one.

Edge cases: a null text counts as empty, and an empty one is the end token alone; rows with a null or
repeated id are packed each on its own; an empty table gives an empty result; other columns are ignored.

Scale. The plan needs only how many items there are of each length, at most ``capacity`` numbers, so it
is made on the driver from the histogram whatever the number of documents, and says for each length
which of its items (by rank) go to which run of sequences, at which offset. The items find their place
in a join on length and rank. Ranks are counted in two levels, so that a length which a third of all
rows share is numbered by many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import kept, map_rows
from .recovery import checkpointed

CAPACITY, END_ID, SALT = 4096, 1, 64
_MEMORY, _TOGETHER = 400_000, 1 << 21
_RARE = "\x1c\x1d\x1e\x1f"
#: Latin letters and digits before a border, ASCII punctuation before one, or what is left up to white space.
#: Only letters that stay single letters when normalised and lower-cased: U+0130, for one, would end in a mark.
_PIECE = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]++(?=[\s!-&(-/:-@\[-`{-~]|\Z)|[!-&(-/:-@\[-`{-~]++(?=[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]|\s|\Z)|\S+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit numbers, with a memory of pieces already met.

    The tokenizer never joins across white space, nor across the border between a Latin letter or digit
    and ASCII punctuation other than an apostrophe, and it ignores case; so a text is the sum of the
    pieces between such borders. New pieces of letters are tokenised many at a time: each ends with a token
    that only ends words, which tells them apart again. Texts with a special token's string, or with one
    of the four control characters on which Python and the tokenizer disagree about white space, go to
    the tokenizer whole. The memory has two generations of ``_MEMORY`` pieces, of which the older is
    forgotten as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.odd = (*_RARE, *(t.content for t in self.model.get_added_tokens_decoder().values()))
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) >= _MEMORY:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = pieces.difference(known)
        known.update((w, old[w]) for w in new.intersection(old))
        words = [w for w in new if w.isalpha() and w not in known]
        if words:
            ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                known.update((w, data[a:b]) for w, a, b in zip(words, at, at[1:]))
        known.update((w, self._encode(w)) for w in new if w not in known)

    def _pieces(self, text: str) -> list[str] | None:
        if any(s in text for s in self.odd):
            return None
        try:  # in Latin-1, lower case is a matter of single letters
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return _PIECE.findall(text)

    def ids(self, text: str) -> bytes:
        return next(self.ids_of([text]))

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and size < _TOGETHER:
                part.append(texts[at])
                size, at = size + len(texts[at]), at + 1
            cut = [self._pieces(x) for x in part]
            self._learn(set().union(*filter(None, cut)))
            get = self.known.__getitem__
            yield from (self._encode(x) if xs is None else b"".join(map(get, xs)) for x, xs in zip(part, cut))


def word_tokens(path: str) -> WordTokens:
    """One memory for each Python worker, which outlives its tasks until one of another stage runs there."""
    return kept(f"words {path}", lambda: WordTokens(path))


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): one row for each piece of each document."""
    path, end = tokenizer or tokenizer_path(), array("I", [end_id]).tobytes()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def start() -> Callable[[pa.RecordBatch], dict]:
        words = word_tokens(path)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            contents = [x or "" for x in batch["text"].to_pylist()]
            for key, ids in zip(batch["doc_id"].to_pylist(), words.ids_of(contents)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out["doc_id"].append(key)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(array("I", part).tolist() if with_ids else None)
            return out

        return each

    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_rows(picked, shape + ", ids array<bigint>" * with_ids, start, "text", 1 << 22, keeps=f"words {path}")


class Plan:
    """Where the items of each length go: rows (length, first rank, items, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.capacity = capacity
        self.used = dict.fromkeys(counts, 0)  # items placed so far, by length
        self.gaps: list[int] = []  # sorted free sizes that some sequence has
        self.open: dict[int, list[tuple[int, int]]] = {}  # free size -> runs of (first sequence, how many)
        left = {k: v for k, v in counts.items() if v}
        self._match({k: v for k, v in left.items() if 3 * k > capacity})
        for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
            self._fit(length, left[length])

    def _put(self, length: int, first: int, n: int) -> None:
        """n items of a length at the start of the free part of n sequences with ``free`` known to the caller."""
        self.rows.append((length, self.used[length], n, first, self._offset))
        self.used[length] += n

    def _free(self, size: int, first: int, n: int) -> None:
        if size > 0:
            if size not in self.open:
                insort(self.gaps, size)
            self.open.setdefault(size, []).append((first, n))

    def _new(self, length: int, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        self._offset = 0
        self._put(length, first, n)
        return first

    def _match(self, left: dict[int, int]) -> None:
        """Greedy matching of large items: the largest with the largest that fits beside it."""
        sizes = sorted(left)
        while sizes:
            big = sizes[-1]
            at = bisect_left(sizes, self.capacity - big + 1) - 1
            if at < 0:
                n, mate = left[big], 0
            else:
                mate = sizes[at]
                n = left[big] // 2 if mate == big else min(left[big], left[mate])
                if n == 0:  # one item of this size is left; its next partner is smaller
                    mate = sizes[at - 1] if at else 0
                    n = 1
            first = self._new(big, n)
            if mate:
                self._offset = big
                self._put(mate, first, n)
            self._free(self.capacity - big - mate, first, n)
            for size in {big, mate} - {0}:
                left[size] -= n * (2 if big == mate else 1)
                if not left[size]:
                    sizes.remove(size)

    def _fit(self, length: int, n: int) -> None:
        """Best fit of n equal items: always the smallest free size that holds one."""
        while n:
            at = bisect_left(self.gaps, length)
            if at == len(self.gaps):
                each = self.capacity // length
                full, rest = divmod(n, each)
                for count, k in ((full, each), (1, rest)):
                    if count and k:
                        first, self.sequences = self.sequences, self.sequences + count
                        for i in range(k):
                            self._offset = i * length
                            self._put(length, first, count)
                        self._free(self.capacity - k * length, first, count)
                return
            size = self.gaps[at]
            first, many = self.open[size].pop()
            if not self.open[size]:
                del self.open[size], self.gaps[at]
            take = min(n, many)
            self._offset = self.capacity - size
            self._put(length, first, take)
            n -= take
            self._free(size - length, first, take)
            if many > take:
                self._free(size, first + take, many - take)


def place(items: DataFrame, *, capacity: int = CAPACITY, salt: int = SALT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...) that are read more than once."""
    spark = items.sparkSession
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # capacity rows at most
    shape = "length bigint, first bigint, n bigint, sequence bigint, offset bigint"
    runs = spark.createDataFrame(plan.rows, shape)
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("nth", F.row_number().over(inside).cast("bigint") - 1).join(bases, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("base"))
    hit = (ranked["length"] == runs["length"]) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n"))
    # The plan's size is bounded by the capacity alone, not by the data.
    found = ranked.join(F.broadcast(runs), hit)
    return found.select(*[ranked[c] for c in items.columns], (F.col("sequence") + F.col("nth") - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    cut = checkpointed(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, doc_id=doc_id, text=text, with_ids=with_ids))
    return place(cut, capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence in order, from ``pack(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
