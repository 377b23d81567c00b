"""Phrases whose words stand together more often than they stand apart, from word-id suffix arrays.

Each task numbers the words of its texts and sorts the suffixes of a block of word ids by prefix doubling; runs
of neighbours whose common prefix is n words or longer (LCP intervals) are the block's n-grams with their counts, which
are summed by (language, phrase) over all blocks. n grows from 1 to ``longest``: an n-gram can be frequent only if both
n-grams of one word less in it are, so of the texts only such places are sorted and sent.

A phrase is cut in two after each word; the cut with the least a * a / (left * right) counts, where a is the
phrase's count. A phrase that stands mostly inside a longer one (``share`` percent) is dropped.

Edge cases: a null or empty text has no words; a null language is ``und``; rows with null or repeated ids count each on
their own, since ids play no part; an empty table gives no rows; other columns are ignored.

Scale: counts are exact. The frequent n-grams are passed on to the next pass as a bit filter of fixed size
(2^``filter_bits`` bits, 16 MB); what it lets through wrongly is counted and falls below ``least``, so it costs time and no truth. A
block holds about ``block_words`` words, whatever the length of a text. The parts of candidates are found by joins on
(language, phrase) whose sides Spark can split, and the best of a language by tiers, so no task sees a whole language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import as_bytes
from .recovery import checkpointed
from .words import mix

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
BLOCK_WORDS, FILTER_BITS = 600_000, 27
_ROWS = 100_000
_TIERS = (4096, 64)
_MARK = b"."
#: A-Z to a-z, tabs to spaces, and all that ends a piece to one mark, which no word can hold.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_CUT = re.compile(rb"[ .]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words and marks of a folded text, about ``size`` bytes at a time."""
    at = 0
    while at < len(text):
        end = _CUT.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end].replace(_MARK, b" . ").split()
        at = end


def seed(lang: str) -> int:
    """Hashes of words depend on the language by this seed."""
    return xxhash.xxh64_intdigest(lang.encode())


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from those of their words, first words first."""
    return reduce(lambda h, w: mix(h * _ODD + w), hashes[1:], mix(hashes[0]))


def places(hashes: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for each phrase."""
    bits = (64 * len(filters)).bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


class Numbers(dict):
    """Gives each new word of a language the next number; 0 is the mark."""

    def __init__(self, lang: int, words: list[bytes], langs: list[int]) -> None:
        super().__init__({_MARK: 0})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class Block:
    """Words of a part of the corpus as numbers, pieces apart by zeros."""

    def __init__(self) -> None:
        self.words, self.langs, self.names = [b""], [0], {"": 0}
        self.of: dict[str, Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.of.get(lang)
        if numbers is None:
            numbers = self.of[lang] = Numbers(self.names.setdefault(lang, len(self.names)), self.words, self.langs)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)


def suffixes(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` numbers that follow each, by prefix doubling."""
    known, rank = 1, x.astype(np.int64)
    if depth == 1:
        return starts[np.argsort(x[starts], kind="stable")]
    while True:
        # Ranks by twice as many numbers: own rank, then that of the suffix that begins where the known part ends.
        after = np.zeros(len(x), np.int64)
        after[: len(x) - known] = rank[known:]
        key = rank * (int(rank.max()) + 1) + after
        known *= 2
        if known >= depth:
            return starts[np.argsort(key[starts], kind="stable")]
        _, rank = np.unique(key, return_inverse=True)


def intervals(x: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First member and size of the LCP intervals of ``n`` words or more."""
    if not len(order):
        return order, order
    same = np.ones(len(order) - 1, bool)
    for j in range(n):
        same &= x[order[1:] + j] == x[order[:-1] + j]
    first = np.flatnonzero(np.append(True, ~same))
    return order[first], np.diff(np.append(first, len(order)))


def counted(block: Block, n: int, keep: int, filters: np.ndarray | None) -> pa.RecordBatch | None:
    """(lang, phrase, count) of the block's n-grams that start before its last ``keep`` numbers."""
    x = np.concatenate([*block.parts, np.zeros(n, np.int32)])
    block.parts = [x[: block.size]]
    starts = np.arange(block.size - keep)
    if n > 1:
        seeds = [seed(name) for name in block.names]
        words = np.fromiter(map(xxhash.xxh64_intdigest, block.words, map(seeds.__getitem__, block.langs)), np.uint64, len(block.words))[x]
        known = chain([words[j : len(words) - n + 2 + j] for j in range(n - 1)])
        one, two = places(known, filters)
        bit = lambda at: (filters[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        passed = (bit(one) & bit(two)).astype(bool)
        del words, known, one, two
        starts = starts[passed[starts] & passed[starts + 1]]
    for j in range(n):
        starts = starts[x[starts + j] > 0]
    # Sorted are only the runs that are left, each with what follows it.
    needed = np.zeros(len(x) + n, bool)
    for j in range(n):
        needed[starts + j] = True
    new_place = np.cumsum(needed) - 1
    x, starts = np.append(x, np.zeros(n, np.int32))[needed], new_place[starts]
    first, counts = intervals(np.append(x, np.zeros(n, np.int32)), suffixes(x, starts, n), n) if len(starts) else (starts, starts)
    if not len(first):
        return None
    words = pa.array(block.words, pa.binary())
    phrase = [words.take(pa.array(x[first + j])) for j in range(n)]
    phrase = pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.binary())) if n > 1 else phrase[0]
    lang = pa.array(list(block.names), pa.string()).take(pa.array(np.array(block.langs, np.int32)[x[first]]))
    return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "count"])


def _partial(docs: DataFrame, n: int, filters: Broadcast | None, block_words: int) -> DataFrame:
    """(lang, phrase, count) by block; with n = 1 also the number of words of a language, under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, block, totals = None if filters is None else filters.value, Block(), {}

        def done(keep: int) -> Iterator[pa.RecordBatch]:
            found = counted(block, n, keep, bits) if block.size > keep else None
            for at in range(0, found.num_rows if found else 0, _ROWS):
                yield found.slice(at, _ROWS)

        for batch in batches:
            # One text at a time: a batch may hold 64 MB of them.
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
                for words in tokens((text.as_py() or b"").translate(_FOLD)):
                    block.add(lang, words)
                    if n == 1:
                        totals[lang] = totals.get(lang, 0) + int((block.parts[-1] > 0).sum())
                    if block.size > block_words:
                        # The last words are the beginnings of n-grams that go on in the next block.
                        yield from done(n - 1)
                        tail = np.concatenate([np.zeros(n, np.int32), *block.parts])[-(n - 1) :].tolist() if n > 1 else []
                        tail = [block.words[i] if i else _MARK for i in tail]
                        block = Block()
                        block.add(lang, tail)
                block.add(lang, [_MARK])
        yield from done(0)
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "phrase": [""] * len(totals), "count": list(totals.values())})

    return docs.mapInArrow(run, "lang string, phrase string, count bigint")


def _filter(frequent: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit filter of the phrases, of fixed size: only its words of 64 bits reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << filter_bits - 6, np.uint64)
        for batch in batches:
            hashes = np.fromiter(
                (reduce(_next, (xxhash.xxh64_intdigest(w, seed(lang)) for w in phrase.split(b" ")), None) for lang, phrase in zip(batch["lang"].to_pylist(), as_bytes(batch["phrase"]))), np.uint64, batch.num_rows
            )
            for at in places(hashes, bits):
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slot = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(bits[slot].view(np.int64))], names=["slot", "bits"])

    parts = frequent.select("lang", "phrase").mapInArrow(run, "slot int, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << filter_bits - 6, np.uint64)
    out[parts["slot"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return out


_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _next(h: int | None, word: int) -> int:
    """``chain`` for a single phrase."""
    return _mixed(word) if h is None else _mixed(h * int(_ODD) + word & _MASK)


def frequent(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS, filter_bits: int = FILTER_BITS, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, n_words, f: every phrase of up to ``longest`` words that occurs ``least`` times; the empty one counts all words."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    context, levels, filters = docs.sparkSession.sparkContext, [], None
    for n in range(1, longest + 1):
        summed = _partial(rows, n, filters, block_words).groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
        levels.append(checkpointed(summed.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(n).alias("n_words"), "f")))
        if n < longest:
            filters = context.broadcast(_filter(levels[-1].where("phrase <> ''"), filter_bits))
    return reduce(DataFrame.unionByName, levels)


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score(a: str = "a", left: str = "l", right: str = "r") -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 38 digits."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(38,0)) * {a} * {a}) DIV (CAST({left} AS DECIMAL(38,0)) * {right}) AS BIGINT)")


def collocations(found: DataFrame, *, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of ``frequent`` (written or checkpointed before) that stand for themselves."""
    phrases = found.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words", F.split("phrase", " ").alias("words"))
    cuts = phrases.select("lang", "phrase", "a", "words", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _joined(F.col("words"), F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(1).alias("side"), _joined(F.col("words"), F.col("cut") + 1, F.col("n_words") - F.col("cut")).alias("part")),
    )
    asked = cuts.select("lang", "phrase", "a", "cut", F.inline(sides))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("f"))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    cut = asked.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r")).withColumn("score", score())
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # Each phrase's shorter phrases of two words or more, with its count.
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), "n_words"), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.col("n_words") - 1, F.lit(2))), lambda k: F.when((i + k - 1 <= F.col("n_words")) & (k < F.col("n_words")), _joined(F.col("words"), i, k))))),
        lambda x: x.isNotNull(),
    )
    longer = phrases.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    return own.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Adds rank, and keeps the first ``top`` of each language: the best of parts, then the best of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = scored.withColumn("rank", F.lit(0))
    for parts in _TIERS:
        place = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def digest(docs: DataFrame, **options: int) -> DataFrame:
    """The contract's columns."""
    found = frequent(docs, **options)
    words = found.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return best(collocations(found)).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
one AS (SELECT lang, ws[i] AS phrase, 1 AS k FROM g),
more AS (SELECT lang, array_to_string(ws[i:i+k-1], ' ') AS phrase, k FROM g, (VALUES (2), (3)) AS v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM more) GROUP BY lang, phrase, k),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS score
      FROM u JOIN f AS l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.cut], ' ')
             JOIN f AS r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut+1:u.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, CAST(row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000"""
