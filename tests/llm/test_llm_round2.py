"""Learning against a plain FTRL, cuts in blocks, context on both sides of a span, aliases of pages never crawled."""

import math
import random

import numpy as np
import pytest

from heronkb.llm import decontam, pii, toxicity, urlfilter


def plain_ftrl(rows, o):
    z, n, last = {}, {}, "bias"

    def weight(k):
        l1 = 0.0 if k == last else o.l1
        v = z.get(k, 0.0)
        if abs(v) <= l1:
            return 0.0
        return -math.copysign(abs(v) - l1, v) / ((o.beta + math.sqrt(n.get(k, 0.0))) / o.alpha + o.l2)

    for _ in range(o.epochs):
        for found, label in rows:
            keys = [*found, last]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for k in keys:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / o.alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


@pytest.mark.parametrize("seed", range(3))
def test_weights_against_a_plain_ftrl(seed):
    rng, rows = random.Random(seed), []
    for _ in range(200):
        y = rng.random() < 0.4
        rows.append((sorted({rng.randrange(200) for _ in range(10)} | ({250 + rng.randrange(4)} if y else set())), int(y)))
    o = toxicity.Ftrl(l1=0.5)
    w, bias = toxicity.train([(np.array(x, np.int32), y) for x, y in rows], o, bits=8)
    want = plain_ftrl(rows, o)
    assert bias == pytest.approx(want.pop("bias")) and {k for k, v in want.items() if v} == set(np.flatnonzero(w).tolist())
    assert all(w[k] == pytest.approx(v) for k, v in want.items())


def test_learning_keeps_to_its_bound(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i % 5} " + ("foul " if i % 3 == 0 else "fair ") * 3) for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    all_, none = toxicity.model(docs, labels), toxicity.model(docs, labels, max_features=0)
    assert len(all_.index) > 0 and len(none.index) == 0 and none.bias == 0.0
    assert all_.scorer()(b"foul foul foul") > 0.5 > all_.scorer()(b"fair fair fair")


def test_cuts_are_the_same_in_one_block_and_many(spark):
    docs = spark.createDataFrame([(1, "a b x y z c d e", "k"), (2, None, "k"), (3, "", "k"), (4, "x y z b c d", "k")], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["x y z", "b c d", "q r s", None])], "item_id bigint, text string")
    got = [sorted(map(tuple, decontam.cut_spans(docs, bench, n=3, block_bytes=b).collect())) for b in (1 << 20, 5, 1)]
    assert got[0] == got[1] == got[2] == [(1, "a b  c d e", "k"), (2, None, "k"), (3, "", "k"), (4, "", "k")]


def test_windows_are_small():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(10**5)}" for _ in range(1000)).encode()) for i in range(300)]
    w = decontam.Windows(items, 10)
    held = sum(x.nbytes for t in w.tables.values() for x in t)
    assert held == 20 * 300 * 991 and len(w.joined) <= sum(len(t) for _, t in items)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("123-45-6789 is my social security number", ["ssn"]),
        ("serial 123-45-6789", []),
        ("iban de89 3704 0044 0532 0130 00 with text", ["iban"]),
        ("part GB82 WEST 1234 5698 7654 32 of the serial", []),
        ("GB82 WEST 1234 5698 7654 32", ["iban"]),
        ("GB82 WEST 1234 5698 7654 3", []),
        ("GB82 WEST 1234 5698 7654 321", []),
    ],
)
def test_context_decides_added_spans(text, kinds):
    assert [s.kind for s in pii.spans_of(text) if s.kind not in pii.BASE] == kinds


def test_base_spans_can_be_held_to_their_score():
    text = "version 10.0.0.1 and server 10.0.0.2"
    scores = [s.score for s in pii.spans_of("release version 10.0.0.1" + " " * 60 + "the server 10.0.0.2")]
    assert scores == [0.3, 0.8] and len(pii.spans_of(text)) == 2
    assert len(pii.spans_of("release version 10.0.0.1" + " " * 60 + "the server 10.0.0.2", least_base=0.5)) == 1


def test_targets_never_crawled_carry_their_rules(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.info/x", "<link rel=canonical href='http://far.org/es/1'>"),
            (2, "http://b.info/x", '<meta http-equiv="refresh" content="0;url=\'//far.org/es/1\'">'),
            (3, "http://c.info/x", "<link rel=canonical href=y>"),
            (4, "http://c.info/y", "<link rel=canonical href=http://far.net/de/1><link rel=canonical href=http://far.org/es/2>"),
            (5, None, "<link rel=canonical href=http://far.org/es/1>"),
            (6, "http://d.info/x", None),
        ],
        "page_id bigint, url string, html string",
    )
    got = {r.page_id: r.verdict for r in urlfilter.digest(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
