"""The pipeline's near-duplicate rule against all pairs."""

import random
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from heronkb.llm import likeness

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_all_pairs(rows):
    sets, up = {k: plain_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k for k in up if root(k) == k}


def test_near_copies_of_likeness_from_08_on(spark):
    rng, rows = random.Random(3), []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 400))]
        for edits in (0, 0, 1, 2, 3, 5, 8, 13):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    # A crowd past the size that is compared all with all, of which many are below 0.8 to each other.
    base = [f"c{i}" for i in range(200)]
    for _ in range(120):
        text = list(base)
        for _ in range(rng.randrange(2, 12)):
            text[rng.randrange(200)] = f"e{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), ""), (len(rows) + 1, "  "), (len(rows) + 2, None), (len(rows) + 3, "two words"), (len(rows) + 4, "Two  words")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in got.select("doc_id").collect()} == kept_by_all_pairs(rows)


def test_no_rows(spark):
    assert likeness.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_crowded_buckets_are_dealt_anew_without_loss(spark):
    from heronkb.llm import components, simhash

    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:  # most bits in common, so that a few buckets hold nearly all
        x = base
        for _ in range(rng.randrange(1, 14)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            up[root(a)] = root(b)
    signed = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    got = {}
    for r in components.connected_components(simhash.links(signed, most=150), "src", "dst").collect():
        got.setdefault(r.component, set()).add(r.node % (1 << 64))
    want = {}
    for x in fps:
        want.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_the_trie_finds_near_copies_that_no_band_brings_together(spark):
    from heronkb.llm.recovery import checkpointed

    words = [f"w{i}" for i in range(3000)]
    near = [*words[:1500], "other", *words[1501:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"x{i}" for i in range(900))), (4, ""), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    prints = likeness.sketches(docs).withColumn("bands", F.array(F.xxhash64("node")))  # a bucket of its own for each
    found = likeness.links(docs, checkpointed(prints), size=5).collect()
    assert len(found) == 2 and len({r.component for r in found}) == 1
