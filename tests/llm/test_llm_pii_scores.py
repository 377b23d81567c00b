"""Spans that the method adds: context words of a neighbour, and plain regular expressions with checks."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronkb.llm import pii

kinds = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text)]


@pytest.mark.parametrize(
    "text", ["social security 123-45-6789, order 123-45-6780", "my SSN is 123-45-6789 (invoice 12)", "ssn 123-45-6789 section 4", "order 7: social security number 123-45-6789", "part 5: 123-45-6789 is her social security number", "123-45-6789 (ssn), model 4"]
)
def test_a_fitting_word_outweighs_the_next_number_s(text):
    assert ("ssn", "123-45-6789") in kinds(text)
    assert "123-45-6789" not in pii.masked(text, pii.spans_of(text))


def test_without_a_fitting_word_a_number_stays():
    assert kinds("order 123-45-6789") == [] and kinds("123-45-6789") == []
    assert kinds("order 123-45-6780, ssn 123-45-6789") == [("ssn", "123-45-6789")]


def plain_ssn(text):
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield m.span()


@given(st.text("0123456-9 .", max_size=60))
@settings(max_examples=600, deadline=None)
def test_ssn_against_a_plain_expression(text):
    got = [(s.start - 4, s.end - 4) for s in pii.spans_of(f"ssn {text}", least_score=0.0) if s.kind == "ssn"]
    assert got == [(a - 4, b - 4) for a, b in plain_ssn(f"ssn {text}")]


def iban(country, body):
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{body}"


@given(st.sampled_from(["DE", "GB", "NO", "FR", "MT"]), st.text("0123456789ABCXYZ", min_size=40, max_size=40), st.text("AB 1.", max_size=4), st.text("12 z.", max_size=4), st.booleans(), st.integers(0, 9))
@settings(max_examples=600, deadline=None)
def test_iban_against_its_own_construction(country, body, before, after, spaced, harm):
    code = iban(country, body[: pii.IBAN_LENGTH[country] - 4])
    shown = " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if spaced else code
    text = f"{before}{shown}{after}"
    free = not re.search("[A-Za-z0-9]$", before) and not re.match("[A-Za-z0-9]", after)
    got = [text[s.start : s.end] for s in pii.spans_of(text, least_score=0.0) if s.kind == "iban"]
    if free and not re.match(r" ?[A-Za-z0-9]", after) and not re.search(r"[A-Za-z0-9] ?$", before):
        assert got == [shown]
    # A wrong digit is found out.
    place = 4 + harm
    wrong = text.replace(shown, shown[: len(shown) - 1] + str((int(shown[-1]) + 1) % 10)) if shown[-1].isdigit() else None
    if wrong and place and free:
        assert not any(wrong[s.start : s.end].replace(" ", "").startswith(code[:-1]) for s in pii.spans_of(wrong, least_score=0.0) if s.kind == "iban")
