"""License scans against every unit and template, without pruning."""

import re

import pytest

import cases
from kpiloom.llm import licenses as lic


def plain(text, threshold=lic.THRESHOLD):
    text = text or ""
    units = list(dict.fromkeys([*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]))
    out = []
    for u in units:
        a = set(lic.bigrams_of(u))
        for name, t in sorted(lic.TEMPLATES.items()):
            b = set(lic.bigrams_of(t))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                out.append((name, round(2 * len(a & b) / (len(a) + len(b)), 9)))
    return out


def texts():
    out = [None, "", "\n\n", "word", "All rights reserved.", "ALL RIGHTS RESERVED", "rights reserved", lic.TEMPLATES["mit-text"], cases.LONG]
    for t in lic.TEMPLATES.values():
        w = t.split()
        out += [t, f"some text\n{t}\nmore", t.replace(" ", "\n", 3), " ".join(w[: len(w) * 4 // 5]), " ".join(w[1:]), t + " and some more words here", f"{t}\n\n{t}\n{t}"]
        out += [" ".join(w[k:k + max(2, len(w) * 2 // 3)]) for k in range(0, len(w), 3)]
    return out


def test_against_all_pairs(spark):
    docs = cases.documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts())])
    got = {r["id"]: [(m["license"], round(m["dice"], 9)) for m in r["matches"]] for r in lic.scan(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts())}


@pytest.mark.parametrize("threshold", [0.6, 0.95])
def test_bounds_hold_at_other_thresholds(spark, threshold):
    docs = cases.documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts())])
    got = {r["id"]: len(r["matches"]) for r in lic.scan(docs, threshold=threshold).collect()}
    assert got == {k: len(plain(t, threshold)) for k, t in enumerate(texts())}


def test_awkward_and_empty_tables(spark):
    docs = cases.documents(spark)
    assert lic.scan(docs).count() == docs.count() and lic.scan(docs.limit(0)).collect() == []


def test_best_of_equals_is_the_first_by_name(spark):
    docs = cases.documents(spark, [(1, f"{lic.TEMPLATES['mit']}\n{lic.TEMPLATES['apache-2.0']}", "en", "a"), (2, "none", "en", "a")])
    got = {r["id"]: r["b"] for r in lic.scan(docs).select("id", lic.best("matches")["license"].alias("b")).collect()}
    assert got == {1: "apache-2.0", 2: None}


def plain_inside(text, templates):
    """{license: best dice} over all windows of at most the upper bound of bigrams."""
    w = lic.words_of(text or "")
    grams = [" ".join(x) for x in zip(w, w[1:])]
    out = {}
    for name, t in templates.items():
        own = set(lic.bigrams_of(t))
        high = lic.size_bounds(len(own))[1]
        best = max((2 * len(own & set(grams[a:b])) / (len(own) + len(set(grams[a:b]))) for a in range(len(grams))
                    for b in range(a + 1, min(len(grams), a + high) + 1)), default=0)
        if best >= lic.THRESHOLD:
            out[name] = round(best, 9)
    return out


def test_notices_inside_lines(spark):
    said = {"Released under the MIT License. See LICENSE for details.": "mit", "This project is licensed under the MIT License.": "mit-notice",
            "Some words. Licensed under the Apache License,\nVersion 2.0, as they say": "apache-2.0", "we chose the GNU Lesser General Public License version 3 here": "lgpl-3.0",
            "Copyright 2020 Someone. All rights reserved. No copies!": "all-rights-reserved", "dedicated under CC0 1.0 Universal to all": "cc0-1.0",
            "a b Permission is hereby granted " * 3: None, "under the old bridge of the town by software": None, "": None}
    long = [f"own words here and {t} and own words there" for t in lic.NOTICES.values()]
    every = [*said, *long, None, "under"]
    docs = cases.documents(spark, [(k, t, "en", "a") for k, t in enumerate(every)])
    rows = {r["id"]: r for r in lic.scan(docs, templates=lic.NOTICES, windows=True).select("id", "matches", lic.best("matches")["license"].alias("b")).collect()}
    assert {t: rows[k]["b"] for k, t in enumerate(said)} == said
    for k, t in enumerate(every):
        best = {}
        for m in rows[k]["matches"]:
            best[m["license"]] = max(best.get(m["license"], 0), round(m["dice"], 9))
        want = plain_inside(t, lic.NOTICES)
        assert set(best) == set(want) and all(best[x] <= want[x] for x in best), t
    assert all(rows[len(said) + k]["b"] for k in range(len(long)))
