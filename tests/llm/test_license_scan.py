import re

from tablesteps.llm import license_rules as R
from tablesteps.llm import license_scan as L

from .helpers import corpus, docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [
        (i, label)
        for phrase, label in L.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def test_base_places_against_brute_force(spark):
    rows = corpus(4, 60) + [
        (500, "CC BY CC BY; cc-by. MIT license/Mit License"),
        (501, "GNU General Public License gnu general\npublic license"),
        (502, "Apache License Apache License éMIT license mit_license MIT-license"),
        (503, "by cc licence mit"),
    ]
    out = L.scan(docs(spark, rows), ["doc_id"]).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def labels(text):
    return set(L.Scanner().scan(text.encode())[5])


def test_priority_and_containment():
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == {"GPL-3.0-or-later"}
    assert labels("Licensed under CC BY-NC-SA 4.0.") == {"CC-BY-NC-SA-4.0", "cc-by"}
    assert labels("the Apache License, Version 2.0") == {"Apache-2.0", "apache"}
    assert labels("GNU Lesser General Public License v2.1") == {"LGPL-2.1-only"}
    assert labels("BSD 3-Clause License and the Unlicense") == {"BSD-3-Clause", "Unlicense"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == {"MIT"}
    assert labels("a license to drive, by mit and gpl") == {"GPL"}
    assert labels("nothing here") == set()


def test_resolve_keeps_the_strongest_disjoint():
    found = [(50, 0, 10, "a"), (80, 2, 8, "b"), (50, 9, 20, "c"), (50, 9, 12, "d"), (80, 2, 8, "b")]
    assert [x[3] for x in L.resolve(found)] == ["b", "c"]


def test_rules_are_sound():
    rules = R.compiled()
    assert len(rules) > 300 and len({(r.label, r.pattern.pattern) for r in rules}) == len(rules)
    assert all(r.keyword.decode() in r.pattern.pattern.decode() for r in rules)  # the prefilter loses nothing


def test_empty_table_and_odd_columns(spark):
    assert L.scan(docs(spark, []), ["doc_id"]).collect() == []
    df = odd_docs(spark, [(1, "MIT License"), (2, None), (3, ""), (1, "MIT License"), (4, "mit license " * 5000)])
    out = L.scan(df, df.columns)
    assert out.columns[: len(df.columns)] == df.columns
    assert sorted((r["a.b"], r.n_base, r.score) for r in out.collect()) == [
        (0, 1, 0.6), (1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.6), (4, 5000, 0.6),
    ]
