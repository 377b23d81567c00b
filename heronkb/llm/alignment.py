"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokens of A and B are byte ranges of the same string. The ranges of B form a static interval index (their
sorted starts and ends); each range of A stabs it by bisection and gets the B tokens that it overlaps. A gap
between neighbours of A that no B token spans is a group boundary, so a group is the least run of bytes that
both cut alike. All pairs of an A and a B occurrence in a group are links; the count of an id pair is the
number of documents that hold it linked, over the whole corpus.

A text is taken with a space before it, which B adds by itself. Neither tokenizer joins across a space or line end that
follows a character that isn't white space, so a text is the sum of the units between such places, and each
worker remembers the units that it has met (``_MEMORY`` of them, or ``_CHARS`` characters; then it starts afresh). Whether B's
vocabulary allows this is read from the vocabulary; if not, a text is one unit.

Edge cases: a null or empty text, and one whose tokens don't spell it (U+2581 in it), has no tokens: zeros and an
empty string. Rows with a null or repeated id count each on their own; an empty table gives no rows; other columns
are ignored.

Scale: texts are tokenised once, in place, and each row's distinct linked pairs go to a table in the shared folder.
Counting them is a grouping with map-side sums. The counts are broadcast only if there are at most ``broadcast_pairs`` of
them (counted first); beyond that the same join is shuffled by pair, and Spark splits frequent pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_rows
from .packing import tokenizer_path
from .recovery import checkpointed, shared_folder

A_FILE, B_FILE, BROADCAST_PAIRS = "byte_bpe_50k.json", "piece_bpe_32k.model", 1_500_000
_MEMORY, _CHARS, _TOGETHER, _PAIRS = 320_000, 10_000_000, 1 << 19, 1 << 20
_B_BITS = 15
_SPACE = "▁"
#: White space, then all up to a space or a line end that follows something else; U+180E is white space in old tables only.
_UNIT = re.compile(r"[\s\u180e]*+[^\s\u180e]++(?:(?![ \n])[\s\u180e]++(?:[^\s\u180e]++|\Z))*+|[\s\u180e]++")
_OTHER = re.compile("[" + "".join(chr(c) for c in range(1 << 16) if chr(c).isspace() and chr(c) not in " \n") + "\u180e]")
_RUNS = ("  ", " \n", "\n ", "\n\n")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Units:
    """Aligned units: parallel arrays by unit number, and each unit's distinct linked pairs in one flat array."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.texts: list[bytes] = []
        self.totals = np.empty((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.first = np.zeros(1, np.int64)
        self.codes = self.times = np.empty(0, np.int64)
        self.chars = 0

    def keep(self, units: list[str], texts: list[bytes], totals: np.ndarray, owner: np.ndarray, codes: np.ndarray, times: np.ndarray) -> None:
        self.texts += texts
        self.totals = np.concatenate((self.totals, totals))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(units)))))
        self.codes, self.times = np.concatenate((self.codes, codes)), np.concatenate((self.times, times))
        self.chars += sum(map(len, units))


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << _B_BITS:
            raise ValueError(f"B has {len(pieces)} tokens; at most {1 << _B_BITS} are numbered")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_long, self.b_long = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.split = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        self.space = self.b.piece_to_id(_SPACE)
        self.a_shown, self.b_shown = (np.array([str(i) for i in range(len(xs))], object) for xs in (self.a_bytes, self.b_bytes))
        self.anchor = tuple(map(len, self._ids(" a")))
        self.units = Units()

    def cut(self, text: str) -> list[str]:
        """Units of space and text; a space in front of one is left out, or shown as U+2581 before a line end."""
        if not self.split:
            return [text]
        text = f" {text}"
        if text[-1] not in " \n" and not any(r in text for r in _RUNS) and not _OTHER.search(text):
            return text[1:].replace("\n", " \n").split(" ")
        return [u if u[0] != " " else u[1:] if u[1:2] != "\n" else _SPACE + u[1:] for u in _UNIT.findall(text)]

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with the space which B adds."""
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space], np.int64)
        return a, b

    def _spelt(self, a: np.ndarray, b: np.ndarray, content: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == content == b"".join(map(self.b_bytes.__getitem__, b.tolist()))

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each A token, group of each B token, byte at which each group ends."""
        a_ends, b_ends = np.cumsum(self.a_long[a]), np.cumsum(self.b_long[b])
        first = np.searchsorted(b_ends, a_ends - self.a_long[a], "right")
        after = np.searchsorted(b_ends - self.b_long[b], a_ends, "left")
        closed = np.append(after[:-1] <= first[1:], True)
        ends = a_ends[closed]
        return np.cumsum(closed) - closed, np.searchsorted(ends, b_ends, "left"), ends

    def _pairs(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, code, times) of the distinct linked pairs; owner: of each group."""

        def held(ids: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, n = np.unique(of << bits | ids, return_counts=True)
            return keys >> bits, keys & ((1 << bits) - 1), n

        ga, ia, na = held(a, of_a, 32)
        gb, ib, nb = held(b, of_b, 32)
        start = np.searchsorted(gb, np.arange(len(owner) + 1))
        each = (start[1:] - start[:-1])[ga]  # distinct B ids that face each distinct A id
        out, at, upto = [], 0, np.cumsum(each)
        while at < len(ga):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            n = each[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + start[ga[left]]
            out.append(summed(owner[ga[left]] << 32 | ia[left] << _B_BITS | ib[right], na[left] * nb[right]))
            at = to
        key, times = summed(*(np.concatenate(x) for x in zip(*out))) if out else (np.empty(0, np.int64),) * 2
        return key >> 32, key & 0xFFFFFFFF, times

    def learn(self, new: list[str]) -> None:
        """Adds units in the order of their numbers, as many at a time as can stand together."""
        at = 0
        while at < len(new):
            to = at + 1
            # One that ends in white space would join the next.
            while to < len(new) and new[to - 1] and not new[to - 1][-1].isspace() and new[to - 1][-1] != "\u180e":
                to += 1
            self._learn([f" {u}" if not self.split or u[:1] not in ("\n", _SPACE) else u.replace(_SPACE, " ") for u in new[at:to]])
            at = to

    def _learn(self, units: list[str]) -> None:
        """Units as they stand in texts. An anchor goes before them, since B adds a space to what it gets."""
        joined = "".join(units)
        a, b = self._ids(f" a{joined}")
        known = self._spelt(a, b, f" a{joined}".encode())
        if known:
            a, b = a[self.anchor[0] :], b[self.anchor[1] :]
            of_a, of_b, ends = self.groups(a, b)
            stops = np.cumsum([len(u.encode()) for u in units])
            owner = np.searchsorted(stops, ends, "left")
            known = len(ends) > 0 and np.isin(stops, ends).all()
        if not known:
            if len(units) > 1:
                for u in units:
                    self._learn([u])
            else:
                self.units.keep(units, [b""], np.array([[-1, 0, 0, 0]]), *(np.empty(0, np.int64),) * 3)
            return
        many, one = len(owner), len(units)
        in_a, in_b = np.bincount(of_a, minlength=many), np.bincount(of_b, minlength=many)
        by_unit = lambda n: np.bincount(owner, n, one).astype(np.int64)
        totals = np.stack([by_unit(in_a), by_unit(in_b), np.bincount(owner, minlength=one), by_unit(in_a * in_b)], 1)
        self.units.keep(units, self._shown(a, b, of_a, in_a, in_b, owner, one), totals, *self._pairs(a, b, of_a, of_b, owner))

    def _shown(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, owner: np.ndarray, one: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each unit, cut from the text of all of them."""
        n = len(a) + len(b)
        before = np.cumsum(in_b) - in_b
        place_a = np.arange(len(a)) + before[of_a]
        words, marks = np.empty(2 * n, object), np.full(n, ",", object)
        rest = np.ones(n, bool)
        rest[place_a] = False
        words[2 * place_a], words[2 * np.flatnonzero(rest)] = self.a_shown[a], self.b_shown[b]
        ends = np.cumsum(in_a + in_b) - 1
        marks[ends - in_b], marks[ends] = "|", ";"
        words[1::2] = marks
        parts = words.tolist()
        stops = 2 * (ends[np.searchsorted(owner, np.arange(one), "right") - 1] + 1)
        out, at = [], 0
        for stop in stops.tolist():
            out.append("".join(parts[at : stop - 1]).encode())
            at = stop
        return out

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, sha256 or '', codes, times) of each text."""
        if len(self.units.number) > _MEMORY or self.units.chars > _CHARS:
            self.units = Units()
        known, out = self.units, []
        numbered = []
        for text in texts:
            units = self.cut(text) if text and _SPACE not in text else []
            numbered.append(np.fromiter(map(known.number.__getitem__, units), np.int64, len(units)))
        self.learn(list(islice(known.number, len(known.texts), None)))
        for numbers in numbered:
            if not len(numbers) or (known.totals[numbers, 0] < 0).any():
                out.append((0, 0, 0, 0, "", (), ()))
                continue
            text = b";".join(map(known.texts.__getitem__, numbers.tolist()))
            numbers, n = summed(numbers, np.ones(len(numbers), np.int64))
            start, many = known.first[numbers], known.first[numbers + 1] - known.first[numbers]
            at = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
            codes, times = summed(known.codes[at], known.times[at] * np.repeat(n, many))
            out.append((*(n @ known.totals[numbers]).tolist(), hashlib.sha256(text).hexdigest(), codes, times))
        return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(values[order], new)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One memory for each Python worker, which outlives its tasks."""
    return Aligner(a_path, b_path)


def _picked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def groups(docs: DataFrame, *, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups: for each document its groups as (end, a, b), bytes of space and text and ids in order."""
    a_path, b_path = a or tokenizer_path(A_FILE), b or tokenizer_path(B_FILE)
    rows, kind = _picked(docs, doc_id, text)

    def start() -> Callable[[pa.RecordBatch], dict]:
        own = aligner(a_path, b_path)

        def of(content: str | None) -> list[dict]:
            if not content or _SPACE in content:
                return []
            a, b = own._ids(f" {content}")
            if not own._spelt(a, b, f" {content}".encode()):
                return []
            of_a, of_b, ends = own.groups(a, b)
            places = np.arange(len(ends) + 1)
            xs, ys = (np.searchsorted(of, places) for of in (of_a, of_b))
            return [{"end": int(ends[g]), "a": a[xs[g] : xs[g + 1]], "b": b[ys[g] : ys[g + 1]]} for g in range(len(ends))]

        return lambda batch: {"doc_id": batch["doc_id"], "groups": [of(x) for x in batch["text"].to_pylist()]}

    return map_rows(rows, f"doc_id {kind}, groups array<struct<end: bigint, a: array<int>, b: array<int>>>", start, "text", _TOGETHER)


def linked(docs: DataFrame, *, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a_id << 15 | b_id, and how many links): one row a document."""
    a_path, b_path = a or tokenizer_path(A_FILE), b or tokenizer_path(B_FILE)
    rows, kind = _picked(docs, doc_id, text)
    pair = pa.struct([("pair", pa.int32()), ("times", pa.int64())])

    def start() -> Callable[[pa.RecordBatch], dict]:
        own, nth = aligner(a_path, b_path), TaskContext.get().partitionId() << 36

        def each(batch: pa.RecordBatch) -> dict:
            nonlocal nth
            found = own.rows(batch["text"].to_pylist())
            out = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*(r[:5] for r in found))))
            codes, times = (np.concatenate([np.asarray(r[i], np.int64) for r in found]) for i in (5, 6))
            offsets = np.cumsum([0, *(len(r[5]) for r in found)])
            out["pairs"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(codes.astype(np.int32)), pa.array(times)], fields=list(pair)))
            out["row"], out["doc_id"] = np.arange(nth, nth + len(found)), batch["doc_id"]
            nth += len(found)
            return out

        return each

    return map_rows(rows, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<pair: int, times: bigint>>", start, "text", _TOGETHER)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, a_id, b_id, documents, best (no B id is in more documents with this A id), from rows of ``linked``."""
    counts = found.select(F.inline("pairs")).groupBy("pair").agg(F.count("*").alias("documents"))
    a = F.shiftright("pair", _B_BITS).alias("a_id")
    named = counts.select("pair", a, F.col("pair").bitwiseAND((1 << _B_BITS) - 1).alias("b_id"), "documents")
    # An A id has no more pairs than B has tokens.
    return named.withColumn("best", F.col("documents") == F.max("documents").over(W.partitionBy("a_id")))


def digest(docs: DataFrame, *, broadcast_pairs: int = BROADCAST_PAIRS, **options: str) -> DataFrame:
    """The contract's columns."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    linked(docs, **options).write.parquet(folder)
    found = spark.read.parquet(folder)
    counts = checkpointed(pair_counts(found).select("pair", "documents", "best"))
    counts = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts
    sums = (
        found.select("row", F.inline("pairs"))
        .join(counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return found.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
