"""Single signatures and joined licenses, words that are no license, and labels of a whole table against all rules without gates."""

import re

import pytest

from tidemark.llm import license_scan as ls

CASES = {
    "LICENSE: CC-BY-4.0": "cc-by-4.0",
    "License: GPL-2.0-or-later": "gpl-2.0-or-later",
    "gpl-3.0-only": "gpl-3.0-only",
    "AGPL-3.0-or-later": "agpl-3.0-or-later",
    "EUPL-1.2": "eupl-1.2",
    "MIT-licensed code": "mit",
    "see https://www.apache.org/licenses/LICENSE-2.0 now": "apache-2.0",
    "under the terms of the GNU GPL as published, either version 2": "gpl-2.0",
    "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl,gpl-3.0",
    "dual-licensed under MIT and GPLv2": "gpl-2.0,mit",
    "licensed under the Apache License, Version 2.0 or the MIT license": "apache,apache-2.0,mit",
    "under the PHP License and the Python license": "php,python-2.0",
    "Licensed under BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: MIT": "mit",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "provided under python scripts": "",
    "covered under php": "",
    "das ist mit licence": "",
    "under the sun and python": "",
    "a bare apache, a mit, a python": "",
}


def plain(text):
    """Labels by every rule, without keywords or other gates; what lies in a detection before it of the same priority or a higher one goes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(ls.WORD, low)
    line, hits = f" {' '.join(words)} ", []
    for number, label, _, expression, priority, _ in RULES:
        hits += [(m.start(), -m.end(), -priority, number, label) for m in expression.finditer(line)]
    hits.sort()
    kept = {h[4] for i, h in enumerate(hits) if not any(g[2] <= h[2] and g[1] <= h[1] for g in hits[:i])}
    base = {label for label, p in ls.BASE.items() if any(tuple(words[i : i + len(p)]) == p for i in range(len(words)))}
    return ",".join(sorted(kept | base))


RULES = [(n, label, k, re.compile(e), p, c) for n, label, k, e, p, c in ls.rules()]


def test_signatures_are_many_and_each_its_own():
    made = ls.signatures()
    assert len({e for _, _, e in made}) == len(made) > 200
    assert all(k in re.findall(r"[a-z0-9]+", e) for _, k, e in made)  # the keyword is a word that the expression asks for


def test_cases(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in ls.scan(df).collect()} == dict(enumerate(CASES.values()))


@pytest.mark.parametrize("label, expression", [(label, e) for label, _, e in ls.signatures() if re.fullmatch(r"[a-z0-9 ]+", e)][::7])
def test_a_signature_alone_gives_its_label(label, expression):
    assert label in plain(f"x {expression} y").split(",") or any(x.startswith(label) for x in plain(f"x {expression} y").split(","))


def test_labels_of_a_whole_table_equal_all_rules_without_gates(spark, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.labels for r in ls.scan(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()} and len({x for x in got.values() if x}) > 2
