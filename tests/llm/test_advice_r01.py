"""Findings of round 1: each test fails on the code that the finding is about."""

import itertools
import random
import re._constants as sre
import re._parser as parser

import pytest

from dizin.llm import decontaminate, licenses, simhash

rng = random.Random(11)


@pytest.mark.parametrize("asked", [decontaminate.ASKED, 2])
def test_index_in_several_passes(spark, monkeypatch, asked):
    monkeypatch.setattr(decontaminate, "ASKED", asked)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(14)]
    leak = [rng.choice(words) for _ in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    texts += [f"{texts[i]} {' '.join(leak[i : i + 14])} {texts[i + 9]}" for i in range(12)] + [None, "", f"{words[0]} alone"]
    items = [(1, " ".join(leak)), (2, f"{words[0]} alone"), (3, "nowhere at all")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    wins = {}
    for item, body in items:
        w = decontaminate.words_of(body)
        for at in range(max(1, len(w) - 9)):
            wins.setdefault(tuple(w[at : at + 10]), set()).add(str(item))
    want = {}
    for doc, body in enumerate(texts):
        w, hit, named = decontaminate.words_of(body), set(), set()
        for win, names in wins.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    named |= names
        want[doc] = (len(w), len(hit), sorted(named))
    assert sum(n > 0 for _, n, _ in want.values()) >= 13
    monkeypatch.setattr(decontaminate, "TERMS_AT_ONCE", 3)
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 200)
    got = decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts) and {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want


def samples(parsed):
    """A phrase for every alternative and option of a pattern; wildcards stand for nothing."""
    parts = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.IN:
            parts.append([chr(c) for kind, c in arg if kind is sre.LITERAL])
        elif op is sre.SUBPATTERN:
            parts.append(samples(arg[3]))
        elif op is sre.BRANCH:
            parts.append([x for b in arg[1] for x in samples(b)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[2][0][0] is not sre.ANY:
            parts.append(["", *samples(arg[2])] if not arg[0] else samples(arg[2]))
    return ["".join(x) for x in itertools.islice(itertools.product(*parts), 2000)]


def test_license_keywords_lose_nothing():
    ordered, tried = licenses.rules(), 0
    for rule in ordered:
        phrases = samples(parser.parse(rule.pattern.pattern))
        for phrase in phrases if len(phrases) <= 12 else {*phrases[:4], *rng.sample(phrases, 8)}:
            norm = f" {phrase.strip()} "
            want = licenses.detect(norm, ordered, gated=False)
            assert licenses.detect(norm, ordered) == want and want, norm
            tried += 1
    assert tried > len(ordered)


@pytest.mark.parametrize(("text", "labels"), [
    ("MPL 2.0", "mpl-2.0"), ("EPL 2.0", "epl-2.0"), ("published under MIT", "mit"), ("available under Apache 2.0", "apache-2.0"), ("MIT/Apache 2.0", "apache-2.0,mit"),
    ("Creative Commons Attribution 4.0", "cc-by-4.0"), ("provided under zlib", "zlib"), ("released under the Expat License", "mit"), ("mit dem Bus", ""),
    ("wir gehen mit dem hund copyright 2020", ""), ("all rights reserved mit freunden", "proprietary"), ("zlib and x11 are libraries", ""), ("dual licensed: MIT or Apache-2.0", "apache-2.0,mit"),
])
def test_licenses_without_other_words_of_licensing(text, labels):
    assert licenses.scan_text(text, licenses.rules())[5] == labels


GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
KEPT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
FORMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
ADVERTS = " * 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the group."
NEITHER = " * Neither the name of the group nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


@pytest.mark.parametrize(("text", "labels"), [
    (f"{GRANT}, subject to the following conditions: {KEPT} {AS_IS}", "mit"), (f"{GRANT}. {AS_IS}", "mit-0"),
    (f"{GRANT}: {KEPT} Except as contained in this notice, the name of the group shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software", "x11"),
    (FORMS, "bsd-2-clause"), (FORMS + NEITHER, "bsd-3-clause"), (FORMS + ADVERTS + NEITHER, "bsd-4-clause"),
    (f"{FEE}, provided that the above copyright notice and this permission notice appear in all copies.", "isc"), (f"{FEE}. THE SOFTWARE IS PROVIDED 'AS IS'", "0bsd"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "zlib"),
    ("# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an AS IS BASIS", "apache-2.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or later", "gpl,gpl-2.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "gpl,lgpl-2.1"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("http://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
])
def test_license_texts_need_no_name(text, labels):
    got = licenses.scan_text(text, licenses.rules())
    assert got[5] == labels and got[6] >= 0.99


def test_rows_are_judged_by_their_own_text(spark):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90)]
    one, two, leak = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(None, one, "a"), (None, one, "b"), (None, leak, "a"), (1, one, "a"), (2, two, "a"), (2, two, "b"), (2, leak, "a"), (3, leak, "a"), (4, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 3):
        left = simhash.deduplicate(docs.repartition(parts)).collect()
        got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left)
        assert got == sorted([(0, one), (0, leak), (2, two), (4, ""), (0, "")])
        first = set(map(tuple, left)) if parts == 1 else first
        assert set(map(tuple, left)) == first
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for r in rows if r[1] != leak), key=repr)
