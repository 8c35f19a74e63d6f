"""License scans against the same rules by Python's re, one text at a time, with suppression by all pairs."""

import re

from helpers import LONG, edge, empty, real

from rillstone.llm import licenses

RULES = [r | {"regex": re.compile(r["regex"])} for r in licenses.rules()]
TOLD = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, phrases=licenses.PHRASES):
    words = words_of(text)
    joined = " " + " ".join(words) + " "
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = []
    for r in RULES:
        for m in r["regex"].finditer(joined):
            found.append((joined.count(" ", 0, m.start()) - 1, joined.count(" ", 0, m.end()), r["priority"], r["id"], r["label"], r["score"]))
    left = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], e[1]) != d[:2] or (e[2], -e[3]) > (d[2], -d[3])) for e in found)]
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | {d[4] for d in left})),
        max([d[5] for d in left] + [licenses.PHRASE_SCORE] * bool(places), default=0.0),
    )


SAID = {
    "Licensed under the Apache License, Version 2.0 (the 'License')": "apache-2", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "Released under the MIT license.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "GNU Lesser General Public License": "lgpl", "under the terms of the GNU GPL v2 license": "gpl-2",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "License: BSD-3-Clause": "bsd-3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "steht unter der MIT-Lizenz": "mit", "sous licence Apache 2.0": "apache-2", "dedicated to the public domain": "public-domain", "Eclipse Public License - v 2.0": "epl-2",
    "UNDER the\nMIT---LICENSE": "mit", "use of the GPLv3 here": "gpl-3", "Apache License Version 2": "apache-2", "cc\tby (nc)": "cc-by-nc", "the Mozilla Public License, v. 2.0": "mpl-2",
    "He has a license to drive, mit Freude, and goes by the general public": "", "the public domain of numbers": "", "limited library, eclipse of the sun": "",
}


def test_what_is_said(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (text, label) in enumerate(SAID.items()):
        assert got[i].labels == label, (text, got[i])
        assert tuple(got[i][c] for c in TOLD) == brute(text)


def test_against_brute_force(spark):
    """Given texts, texts put together from what is said above, overlapping phrases, and texts full of licenses."""
    said = list(SAID)
    made = [(10_000 + k, f"Word {k}. " * (k % 7) + " ".join(said[(k * 5 + j * 3) % len(said)] for j in range(k % 6)) + " cc by nc cc by nc" * (k % 3)) for k in range(200)]
    made += [(20_000, (said[0] + ". " + said[4] + "\n") * 3000)]
    df = real(spark).select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = licenses.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id]) if r.doc_id != 20_000 else (45_000, 3000, 3, 44_988, "apache-2", "apache-2,lgpl", 0.95)
        assert tuple(r[c] for c in TOLD) == want, r.doc_id
    assert sum(r.n_base > 0 for r in got if r.doc_id < 10_000) > 2


def test_phrases_that_overlap(spark):
    df = spark.createDataFrame([(1, "a b A b a, b")], "doc_id long, text string")
    got = licenses.scan(df, phrases={"a b a": "x", "b": "y"}).first()
    assert (got.n_base, got.first_word, got.last_word, got.base_labels) == (5, 0, 5, "x,y")


def test_edges(spark):
    got = licenses.scan(edge(spark)).collect()
    assert len(got) == 11 and all(r.labels == "" and r.n_base == 0 and r.first_word is None and r.score == 0 for r in got)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 6)} == {0} and {r.n_words for r in got if r.doc_id == 5} == {len(words_of(LONG))}
    assert licenses.scan(empty(spark)).count() == 0
    twice = spark.createDataFrame([(7, "MIT license"), (7, "MIT license"), (None, "GPLv2")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels) for r in licenses.scan(twice).collect()) == [("7", "mit"), ("7", "mit"), ("None", "gpl-2")]


def test_main_path_is_native(spark, monkeypatch):
    plans = []
    write = licenses.Scratch.write
    monkeypatch.setattr(licenses.Scratch, "write", lambda self, df, name, *a: (plans.append(df._jdf.queryExecution().toString()), write(self, df, name, *a))[1])
    monkeypatch.setattr(licenses, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), df)[1])
    licenses.scan(edge(spark))
    assert len(plans) == 2 and not any("Python" in p or "Arrow" in p for p in plans)
