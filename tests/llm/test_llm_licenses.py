"""License rules: wording, denials, prose that names no license, and the resolver against a plain one."""

import random

import pytest

from heronkb.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice"""
BSD3 = BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"


def labels(text):
    return {h.label for h in licenses.Scanner().scan(text.encode())[2]}


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, {"mit"}),
        (BSD, {"bsd"}),
        (BSD3, {"bsd", "bsd-3-clause"}),
        (APACHE, {"apache-2.0"}),
        (ISC, {"isc"}),
        (GPL, {"gpl-3"}),
        ("// SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
        ("Released under the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("The GPL and the LGPL are licenses.", {"gpl", "lgpl"}),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa-4.0"}),
        ("Licensed under CC BY-SA 3.0", {"cc-by-sa-3.0"}),
    ],
)
def test_wording_and_names(text, want):
    assert labels(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "used with Ruby and provided by PHP",
        "a book published by MIT",
        "used by OpenSSL",
        "not licensed under the MIT License",
        "It is no longer distributed under the terms of the Apache License.",
        "We chose a database rather than the Elastic License.",
        "GPL stands for gallons per litre here.",
        "The boost in software, an eclipse of the public and a common development.",
        "He was granted permission to copy this book and to redistribute it with or without pictures.",
        "MPL, the maximum permissible level, is 2.0 mg.",
        "Python software, foundation stones and the academic freedom of the open database.",
        "The artist kept all rights; the public domain is old.",
        "",
        None,
    ],
)
def test_prose_gives_nothing(text):
    assert licenses.Scanner().scan(text if text is None else text.encode())[2] == []


def test_rules_hold_their_keywords_and_are_many():
    rules = licenses.rules()
    assert len(rules) >= 200 and len({(r.label, r.pattern.pattern) for r in rules}) == len(rules)


def plain_resolved(found):
    kept = []
    for *_, h in sorted(found, key=lambda x: (x[:3], x[3].start)):
        if not any(k.start <= h.start and h.end <= k.end for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: (h.start, h.end))


@pytest.mark.parametrize("seed", range(20))
def test_resolver_against_all_pairs(seed):
    rng, found = random.Random(seed), []
    for i in range(rng.randrange(120)):
        a = rng.randrange(60)
        b = a + rng.randrange(1, 15)
        p = rng.randrange(1, 7)
        found.append((-p, a - b, i, licenses.Hit(f"l{i}", "title", a, b, p, 0.5)))
    assert licenses.resolved(found) == plain_resolved(found)


def test_prefilter_loses_nothing():
    """Every rule's own matches contain its keyword: with and without the prefilter, detections are the same."""
    texts = [MIT, BSD3, APACHE, ISC, GPL, " ".join([MIT, GPL, "mit license and gnu agplv3 or bsd 3 clause license", APACHE])]
    whole = licenses.Scanner()
    whole.by_keyword = {b"": [(i, r) for i, r in enumerate(licenses.rules())]}
    for x in texts:
        assert whole.scan(x.encode()) == licenses.Scanner().scan(x.encode())
