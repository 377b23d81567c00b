"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds are ``email``, ``ip``, ``card`` (13 to 19 digits that pass Luhn) and ``phone`` (9 to 15
digits), leftmost and non-overlapping within a kind; a proposal that fails its check is dropped and
nothing inside it is tried again. Every span has a score: a start value for its kind, raised by a fitting
or lowered by a contrary word within ``CONTEXT`` characters, the nearest one before it first. The method adds ``iban``
(length of its country, mod-97, either case) and ``ssn`` (number ranges); these stay if their score
reaches ``least_score``. Base spans stay if theirs reaches ``least_base``, 0 by default, as the contract
keeps them all.

Offsets are code points, end exclusive. Edge cases: a null text counts as empty and has no spans (and
stays null when masked); rows with null or repeated ids are judged each on its own; an empty table
gives no rows; other columns are ignored by ``find`` and kept by ``mask``. Patterns take time in
proportion to the text, also on very long runs of digits, dots or letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows, pass_rows

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LEAST_SCORE, LEAST_BASE, CONTEXT = 0.5, 0.0, 48

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[0-9]{2}(?=[ A-Za-z0-9])")
# Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")

#: Start score of each kind, and the context words that raise and lower it.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.4}
_RAISE = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "address", "host", "server", "login", "client"},
    "card": {"card", "visa", "credit", "debit", "payment", "mastercard", "cvv"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "contact", "whatsapp"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "bic"},
    "ssn": {"ssn", "social", "security"},
}
_LOWER = {"version", "isbn", "section", "part", "serial", "order", "example", "model", "tracking", "invoice"}
RAISED, LOWERED = 0.2, 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @: the run of local characters before it, not before the last match, and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = end = m.end()
        else:
            free = max(free, start if start < at else at + 1)
        at = text.find("@", end)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() >= free and (end := _iban_end(text, m.start(), IBAN_LENGTH.get(m[1].upper(), 0))):
            yield "iban", m.start(), end
            free = end
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def _iban_end(text: str, start: int, length: int) -> int:
    """Where an IBAN of so many characters ends, single spaces aside; 0 if there is none."""
    at, code = start, []
    while len(code) < length and at < len(text):
        c = text[at]
        if c.isascii() and c.isalnum():
            code.append(c)
        elif c != " " or text[at - 1] == " ":
            return 0
        at += 1
    after = text[at : at + 1]
    return at if length and len(code) == length and not (after.isascii() and after.isalnum()) and mod97("".join(code)) else 0


def _weight(words: Iterable[str], kind: str) -> float:
    """What the first word that says anything says."""
    return next((RAISED if w in _RAISE[kind] else -LOWERED for w in words if w in _RAISE[kind] or w in _LOWER), 0.0)


def _score(text: str, kind: str, start: int, end: int) -> float:
    """The nearest telling word before a span decides, else the nearest after it.

    A contrary word before it gives way to a fitting one after it, unless that one stands before the next number.
    """
    after = text[end : end + CONTEXT].lower()
    before = _weight(reversed(_WORD.findall(text[max(0, start - CONTEXT) : start].lower())), kind)
    behind = _weight(_WORD.findall(after), kind)
    if before < 0 < behind and not _DIGIT.search(after):
        before = behind
    return round(min(1.0, max(0.0, _PRIOR[kind] + (before or behind))), 2)


def spans_of(text: str | None, least_score: float = LEAST_SCORE, least_base: float = LEAST_BASE) -> list[Span]:
    """Spans by kind as listed, then start."""
    found = (Span(kind, a, b, _score(text, kind, a, b)) for kind, a, b in _proposals(text or ""))
    return sorted((s for s in found if s.score >= (least_base if s.kind in BASE else least_score)), key=lambda s: (KINDS.index(s.kind), s.start))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_score: float = LEAST_SCORE, least_base: float = LEAST_BASE) -> DataFrame:
    """doc_id, spans: one row for each document."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def start():
        return lambda batch: {"doc_id": batch["doc_id"], "spans": [[s._asdict() for s in spans_of(x, least_score, least_base)] for x in batch["text"].to_pylist()]}

    return map_rows(picked, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>", start)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text: str = "text", length: str | None = None, least_score: float = LEAST_SCORE, least_base: float = LEAST_BASE) -> DataFrame:
    """All documents and columns with spans masked; ``length`` names a column that holds the text's length, if any."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [x if x is None or not (s := spans_of(x, least_score, least_base)) else masked(x, s) for x in batch[text].to_pylist()]
            for name, values in ((text, new), (length, [None if x is None else len(x) for x in new])):
                if name is not None:
                    i = batch.schema.get_field_index(name)
                    batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            return batch

        return each

    return pass_rows(docs, start)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the spans that ``find`` returns, and the scores in the order of ``spans``."""
    found = find(docs)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
