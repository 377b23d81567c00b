"""Cross-tokenizer alignment against an alignment token by token, over whole tables and odd texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heronkb.llm import alignment
from heronkb.llm.packing import tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    a_bytes = {i: bytes(letters[c] for c in w) for w, i in a.get_vocab().items() if all(c in letters for c in w)}
    b_bytes = [p.replace("▁", " ").encode() if not b.is_byte(i) else bytes([int(p[1:-1], 16)]) for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]

    def both(text):
        """Lists of (byte at which it ends, id), or two empty ones."""
        if not text:
            return [], []
        out = []
        for ids, table in ((a.encode(f" {text}", add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)):
            if b"".join(table[i] for i in ids) != f" {text}".encode():
                return [], []
            at, ends = 0, []
            for i in ids:
                at += len(table[i])
                ends.append((at, i))
            out.append(ends)
        return out

    return both


def brute(rows, both):
    """The contract, token by token."""
    seen, docs = [], Counter()
    for key, text in rows:
        xs, ys = both(text)
        groups = []
        i = j = 0
        for cut in sorted({e for e, _ in xs} & {e for e, _ in ys}):
            ga, gb = [], []
            while i < len(xs) and xs[i][0] <= cut:
                ga.append(xs[i][1])
                i += 1
            while j < len(ys) and ys[j][0] <= cut:
                gb.append(ys[j][1])
                j += 1
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        docs.update(links.keys())
        shown = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        seen.append((key, len(xs), len(ys), groups, links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    for key, n_a, n_b, groups, links, sha in seen:
        yield key, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links.items()), sha


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_whole_table_against_brute_force(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(alignment.digest(docs)) == Counter(brute([(r.doc_id, r.text) for r in docs.collect()], tokens))


def test_odd_texts_against_brute_force(spark, tokens):
    rng = random.Random(7)
    letters = " \n\t\r\x1c\x1f᠎\xa0 　ab'sé.,1中文😀 ́\x85\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "\n", " \n", "a <|endoftext|> b", "<s> </s> <unk>", "we'll▁go", "x" * 5000, "é" * 3000, "same", "same", "中" * 500, "a  b   c\n\n\nd"]
    rows = [(i if i % 7 else None, x, "en") for i, x in enumerate(texts)] + [(3, "same", "de")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string").repartition(3)
    assert rows_of(alignment.digest(docs)) == Counter(brute([r[:2] for r in rows], tokens))


def test_shuffled_join_gives_what_the_broadcast_gives(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = docs.where("doc_id % 9 = 0")
    assert rows_of(alignment.digest(few, broadcast_pairs=0)) == rows_of(alignment.digest(few))


def test_forgetting_units_changes_nothing(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two\nthree", "vier.", "fünf", "sechs  "]) + str(rng.randint(0, 500)) for _ in range(60)) for _ in range(60)]
    a, b = (tokenizer_path(x) for x in (alignment.A_FILE, alignment.B_FILE))
    keep = lambda rows: [(r[:5], list(r[5]), list(r[6])) for r in rows]
    whole = keep(alignment.Aligner(a, b).rows(texts))
    monkeypatch.setattr(alignment, "_MEMORY", 50)
    monkeypatch.setattr(alignment, "_PAIRS", 7)
    own = alignment.Aligner(a, b)
    assert [x for t in texts for x in keep(own.rows([t]))] == whole
    own.split = False  # as with a vocabulary that joins across spaces
    own.units = alignment.Units()
    assert keep(own.rows(texts)) == whole


def test_groups_and_counts_are_real_outputs(spark):
    docs = spark.createDataFrame([(1, "tokenizers differ"), (2, "tokenizers agree"), (3, None)], "doc_id int, text string")
    found = {r.doc_id: r.groups for r in alignment.groups(docs).collect()}
    assert found[3] == [] and [g.end for g in found[1]][-1] == len(" tokenizers differ")
    assert all(len(g.a) and len(g.b) for gs in found.values() for g in gs)
    counts = alignment.pair_counts(alignment.linked(docs))
    assert counts.where("documents = 2").count() >= 1
    assert counts.groupBy("a_id").agg(F.max(F.col("best").cast("int")).alias("m")).where("m = 0").count() == 0


def test_empty_table(spark):
    assert alignment.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
