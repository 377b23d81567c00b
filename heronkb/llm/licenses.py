"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A-Z are lower-cased, words are maximal runs of ASCII letters, digits and code points from U+0080 on, and
rules match the words joined by single spaces, so punctuation, case and line breaks don't matter. The
rules (``license_rules``) are written by hand: wording of the licenses, machine-readable identifiers,
grants, full names, and short names, which count only near a word for license; and denials ("not licensed
under ..."), which give no label. A rule runs only if its keyword occurs. Of overlapping detections the
higher priority comes first, then the longer, then the earlier rule; one that lies inside a kept
detection is dropped, so a denial silences the names in it. Four base phrases are counted at every place
they occur and their labels always stay.

Edge cases: a null text counts as empty and has no words, labels or detections (score 0); rows with null
or repeated ids are judged each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, map_rows
from .license_rules import RULES
from .words import ALNUM

#: Base phrases and their labels.
BASE = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}

#: Priority and score of each form.
FORMS = {"denial": (6, 0.0), "body": (5, 0.95), "tag": (4, 1.0), "grant": (3, 0.9), "title": (2, 0.8), "short": (1, 0.5)}
#: Words on either side in which a short name needs a word for license.
NEAR = 6


class Rule(NamedTuple):
    label: str
    form: str
    priority: int
    score: float
    keyword: bytes
    pattern: re.Pattern


class Hit(NamedTuple):
    label: str
    form: str
    start: int
    end: int
    priority: int
    score: float


def rules() -> list[Rule]:
    return [Rule(label, form, *FORMS[form], keyword.encode(), re.compile(f" {pattern}(?= )".encode())) for label, form, keyword, pattern in RULES]


_LICENSE = re.compile(rb" (?:sub|re)?licen[cs](?:e|es|ed|ing|or|ee)(?= )")
_BASE = re.compile(b" (" + b"|".join(BASE) + b")(?= )")


class Scanner:
    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[tuple[int, Rule]]] = {}
        for i, rule in enumerate(rules()):
            self.by_keyword.setdefault(rule.keyword, []).append((i, rule))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, int]], list[Hit]]:
        """Number of words, base places (label, first word), and the detections that are kept."""
        words = (text or b"").translate(ALNUM).split()
        line = b" " + b" ".join(words) + b" "
        rough = [(i, r) for k, group in self.by_keyword.items() if k in line for i, r in group]
        if not rough:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        word_at = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  the word after the space at this offset
        base = [(BASE[m[1]], word_at(m.start())) for m in _BASE.finditer(line)]
        found = []
        said: np.ndarray | None = None  # places of words for license
        for i, rule in rough:
            for m in rule.pattern.finditer(line):
                first, end = word_at(m.start()), word_at(m.end())
                if rule.form == "short":
                    if said is None:
                        said = np.array([word_at(x.start()) for x in _LICENSE.finditer(line)], np.int64)
                    if np.searchsorted(said, first - NEAR) == np.searchsorted(said, end + NEAR):
                        continue
                version = (m.groupdict().get("v") or b"").decode().replace(" ", "." if rule.label != "bsd" else "-")
                label = f"{rule.label}-{version}" if version else rule.label
                found.append((-rule.priority, first - end, i, Hit(label, rule.form, first, end, rule.priority, rule.score)))
        return len(words), base, [h for h in resolved(found) if h.form != "denial"]


def resolved(found: list[tuple[int, int, int, Hit]]) -> list[Hit]:
    """By (-priority, -length, rule): detections that don't lie inside one kept before, in order of place."""
    starts: list[int] = []  # of kept detections, none of which lies inside another, ascending
    ends: list[int] = []
    kept: list[Hit] = []
    for *_, hit in sorted(found, key=lambda x: (x[:3], x[3].start)):
        at = bisect_right(starts, hit.start)
        if at and ends[at - 1] >= hit.end:
            continue
        kept.append(hit)
        # What the new one covers can't cover anything it doesn't.
        last = bisect_right(ends, hit.end)
        first = bisect_left(starts, hit.start)
        starts[first:last], ends[first:last] = [hit.start], [hit.end]
    return sorted(kept, key=lambda h: (h.start, h.end))


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (label, start), detections: one row for each document."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def start():
        scanner = Scanner()

        def each(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n_words": [], "base": [], "detections": []}
            for x in as_bytes(batch["text"]):
                n, base, hits = scanner.scan(x)
                out["n_words"].append(n)
                out["base"].append([{"label": k, "start": at} for k, at in base])
                out["detections"].append([h._asdict() for h in hits])
            return out

        return each

    return map_rows(picked, f"doc_id {kind}, n_words bigint, base array<struct<label:string,start:bigint>>, detections array<struct<label:string,form:string,start:bigint,end:bigint,priority:int,score:double>>", start)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the detections that ``detect`` returns."""
    found = detect(docs)
    starts = F.transform("base", lambda x: x["start"])
    base = F.transform("base", lambda x: x["label"])
    own = F.transform("detections", lambda x: x["label"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("detections", lambda x: x["score"]), F.transform("base", lambda x: F.lit(0.6))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, own)).alias("labels"),
        score.alias("score"),
    )
