import itertools
import re

from chorus.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


TEXTS = [None, "", "...", "MIT License", "the mit-license! and MIT\nLICENSE mit license", "summit license", "mit licenses",
         "cc by cc by-sa 4.0", "GNU General Public License, version 3 or later; Apache License 2.0.", "É mit  license É" * 3,
         "licensed under the terms of the GNU General Public License version 2", "All rights reserved.",
         "SPDX-License-Identifier: MPL-2.0", "nothing here " * 500 + "mit license " * 50, "accc by ccby"]


def test_base_counts_equal_brute_force(docs):
    got = licenses.scan(docs(list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]]), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_rules_suppress_what_they_contain(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs(list(enumerate(TEXTS)))).collect()}
    assert got[10]["labels"] == "gpl" and [tuple(s) for s in got[10]["spans"]] == [(0, 12, "gpl")]
    assert got[11]["labels"] == "proprietary" and got[12]["labels"] == "mpl" and got[12]["score"] == 1.0
    assert got[7]["labels"] == "cc-by,cc-by-sa"
    assert got[13]["n_detections"] == 50 and got[5]["labels"] == ""


def test_hundreds_of_rules_that_compile():
    table = licenses.rules()
    assert len(table) > 200 and all(re.compile(r[4]) for r in table)
    assert [r[2] for r in table] == sorted(r[2] for r in table)


def wordings(pattern):
    """Texts that a pattern of words, classes, optional parts and alternatives matches, every part once."""
    def alternatives(i):
        out, cur = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                out, cur, i = out + cur, [""], i + 1
                continue
            if pattern[i:i + 3] == "(?:":
                part, i = alternatives(i + 3)
                i += 1
            elif pattern[i] == "[":
                part, i = list(pattern[i + 1:pattern.index("]", i)]), pattern.index("]", i) + 1
            elif pattern[i] == "\\":
                part, i = ["2"], i + 2
            else:
                part, i = [pattern[i]], i + 1
            if i < len(pattern) and pattern[i] in "?*+":
                part, i = part[:] + ([] if pattern[i] == "+" else [""]), i + 1
            if len(cur) * len(part) > 2000:  # every part still occurs
                part = part * (len(cur) // len(part) + 1)
                cur = [a + b for a, b in zip(cur, part)]
            else:
                cur = [a + b for a, b in itertools.product(cur, part)]
        return out + cur, i
    return alternatives(0)[0]


def test_every_match_has_a_keyword_of_its_rule():
    for _, keywords, _, _, pattern, _ in licenses.rules():
        body = pattern.removesuffix("(?= )")
        for text in wordings(body):
            assert re.fullmatch(body, text), (pattern, text)
            if "," in text:  # no comma is left in the form the rules see
                continue
            assert any(f" {k}" in text for k in keywords), (keywords, text)


def test_gated_scan_equals_all_rules(docs):
    names = sorted({t.strip() for f in licenses.FAMILIES for t in wordings(f[2])})
    texts = [f"Released under {n} 4.0, see there" for n in names] + [
        "Released under Creative Commons Attribution 4.0", "Creative Commons Attribution-NonCommercial 4.0",
        "Creative Commons Attribution Non-Commercial ShareAlike", "the FreeBSD license", "Zero Clause BSD", "MIT and Apache and BSD", "common rights"]
    texts = ["Licensed under WTFPLv2.", *texts]
    rows = list(enumerate(texts))
    gated = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    label = lambda t: gated[texts.index(t)]["labels"]
    assert label(texts[-7]) == "cc-by" and label(texts[-6]) == "cc-by-nc" and label(texts[-5]) == "cc-by-nc-sa"
    assert label(texts[-4]) == "bsd-2-clause" and label(texts[-3]) == "0bsd" and label(texts[-2]) == label(texts[-1]) == ""
    assert gated[0]["labels"] == "wtfpl"
    # by hand, all rules ungated: the kept matches of each text
    for i, text in rows:
        norm = " " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "
        hits = [(norm[:m.start() + 1].count(" ") - 1, norm[:m.end() + 1].count(" ") - 1, prio, not base, j, lab, score, base)
                for j, (lab, _, prio, score, pat, base) in enumerate(licenses.rules()) for m in re.finditer(pat, norm)]
        hits.sort(key=lambda h: (h[0], -h[1], h[2], h[3], h[4]))
        kept = {h[5] for n, h in enumerate(hits) if h[7] or not any(o[2] <= h[2] and o[1] >= h[1] for o in hits[:n])}
        want = ",".join(sorted(kept)), max((h[6] for h in hits), default=0.0)
        assert (gated[i]["labels"], gated[i]["score"]) == want, text


def test_every_signature_is_found_in_its_own_text(docs):
    assert len(licenses.SIGNATURES) >= 60
    rows = []
    for label, pattern in licenses.SIGNATURES:
        for text in wordings(pattern)[:2]:
            rows.append((len(rows), label, "Foo.\n * " + ",\n * ".join(x.capitalize() for x in text.split()) + ". Bar"))
    got = {r["doc_id"]: r for r in licenses.scan(docs([(i, t) for i, _, t in rows])).collect()}
    for i, label, text in rows:
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, (label, text)


BODIES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction ..."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
     1. Redistributions of source code must retain the above copyright notice, this list of conditions and ..."""),
    ("bsd-4-clause", "3. All advertising materials mentioning features or use of this software must display the following"),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
     on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"""),
    ("lgpl", "// You should have received a copy of the GNU Lesser General Public\n// License along with this library."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"),
    ("zlib", "3. This notice may not be removed. Altered source versions must be plainly marked as such, and must not be"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def test_bodies_of_licences_and_ordinary_texts(docs):
    ordinary = ["Er kommt mit. Die Lizenz liegt bei, mit Common Sense und Rights.", "the software is provided as a download", "this license plate",
                "the library of common documentation in the European domain", "permission to use the kitchen"]
    texts = [t for _, t in BODIES] + ordinary
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(BODIES))] == [label for label, _ in BODIES]
    assert all(got[i] == "" for i in range(len(BODIES), len(texts)))


def test_the_gate_finds_what_contains_finds(docs):
    keys = {k for r in licenses.rules() for k in r[1]}
    pattern = re.compile(licenses.gate(keys))
    for text in (" cc0 cc by sa bsd 0bsd freebsd ", " gnu general public gnu library x ", " this licen this license agreement wtfplv2 ", "  ", " accc bydb "):
        longest = set(m[1] for m in pattern.finditer(text))
        assert {k for k in keys if any(x.startswith(k) for x in longest)} == {k for k in keys if f" {k}" in text}, text


def test_repeated_rows_null_ids_no_rows(docs):
    got = licenses.scan(docs([(1, "mit license"), (1, "mit license"), (None, "mit license")])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and all(r["labels"] == "mit" for r in got)
    assert licenses.scan(docs([])).count() == 0
