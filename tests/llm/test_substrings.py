"""Sliding spans against one pass over all documents."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from kpiloom.llm import substrings as sub


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n\t\r\xa0\x1c", max_size=60), st.integers(1, 4))
def test_places_and_words_of_sentences_agree(text, most):
    assert [text[s:e].split() for s, e in sub.sentences(text, most)] == sub.sentence_words(text, most)


def plain_places(words):
    """Runs that lose their length or their words when either end goes."""
    n = len(words)
    enough = lambda k, end: end - k >= sub.RUN and sum(map(len, words[k:end])) >= sub.MIN_WORDS
    firsts = [next(((k, e) for e in range(k, n + 1) if enough(k, e)), None) for k in range(n)]
    lasts = [next(((k, e) for k in range(e, -1, -1) if enough(k, e)), None) for e in range(n + 1)]
    return sorted({x for x in firsts + lasts if x})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=30))
def test_places_of_runs(sizes):
    assert sub.run_places(sizes) == plain_places([["w"] * n for n in sizes])


def plain(docs):
    """(id, n_removed, text) of each document, first places by id."""
    seen, out = {}, []
    order = sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in docs})
    for r in docs:
        words = sub.sentence_words(r["text"] or "")
        at = order.index((r["doc_id"] is None, r["doc_id"] or 0))
        for k, end in plain_places(words):
            flat = tuple(w for x in words[k:end] for w in x)
            seen[flat] = min(seen.get(flat, at), at)
    for r in docs:
        text, gone, own = r["text"], set(), set()
        words = sub.sentence_words(text or "")
        at = order.index((r["doc_id"] is None, r["doc_id"] or 0))
        for k, end in plain_places(words):
            flat = tuple(w for x in words[k:end] for w in x)
            if seen[flat] != at or flat in own:
                gone |= set(range(k, end))
            own.add(flat)
        if text:
            places = sub.sentences(text)
            keep = sorted(set(range(len(places))) - gone)
            assert len(places) == len(words)
            left = list(text)
            for k in gone:
                for i in range(places[k - 1][1] if k - 1 in gone else places[k][0], places[k][1]):
                    left[i] = ""
            text = "".join(left)
            assert [text and w for k in keep for w in words[k]] == text.split() or not gone
        out.append((r["doc_id"], len(gone), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("of", ["awkward", "table"])
def test_against_one_pass(spark, of):
    docs = cases.documents(spark) if of == "awkward" else cases.table(spark, "documents")
    got = [tuple(r) for r in sub.dedup(docs).collect()]
    assert sorted(got, key=repr) == plain(docs.collect())


def test_shared_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"p{k}" + ("." if k % 13 == 12 else "") for k in range(60)) + "."
    rows = [(k, f"Own start {k} of this text. {passage} Own end {k} of this text.", "en", "a") for k in range(1, 30)]
    got = {r["id"]: r["text"] for r in sub.dedup(cases.documents(spark, rows)).collect()}
    assert got[1] == rows[0][1]
    assert all("p3" not in got[k] and f"Own start {k}" in got[k] and f"Own end {k}" in got[k] for k in range(2, 30))


def test_one_long_sentence(spark):
    long = " ".join(f"q{k}" for k in range(55))
    rows = [(1, f"{long}\nfirst own text", "en", "a"), (2, f"some own words\n{long}", "en", "a"), (3, "clean words only. Nothing else.", "en", "a")]
    got = {r["id"]: r["text"] for r in sub.dedup(cases.documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "some own words\n", 3: rows[2][1]}


def test_sentences_of_one_word(spark):
    loud = " ".join(f"WORD{k}!!" for k in range(60))
    rows = [(1, f"own start here\n{loud}\nown end", "en", "a"), (2, f"other begin there\n{loud}\nother finish", "en", "a")]
    got = {r["id"]: r["text"] for r in sub.dedup(cases.documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "other begin there\n\nother finish"}


def test_empty_table(spark):
    assert sub.dedup(cases.documents(spark).limit(0)).collect() == []


def test_passages_that_start_inside_a_sentence(spark):
    rows, want = [], {}
    for n in range(51, 151, 9):
        passage = [f"p{n}x{k}" for k in range(n)]
        for copy in range(3):
            own = [f"o{n}c{copy}x{k}" for k in range(90)]
            head = 5 + 11 * copy + n % 7
            rows.append((10 * n + copy, " ".join(own[:head] + passage + own[head:]), "en", "a"))
            want[10 * n + copy] = (own[:head] + passage + own[head:]) if copy == 0 else own
    rows.append((1, "", "en", "a"))
    want[1] = []
    rows.append((2, None, "en", "a"))
    got = {r["id"]: r["text"] for r in sub.dedup(cases.documents(spark, rows), passage=sub.PASSAGE).collect()}
    assert got.pop(2) is None
    assert {k: x.split() for k, x in got.items()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=80), max_size=6), st.integers(2, 12))
def test_windows_around_repeated_anchors_are_all_repeated_windows(texts, passage):
    text, word, h = sub.anchors(texts, passage)
    counts = {x: h.tolist().count(x) for x in h.tolist()}
    near = [[] for _ in texts]
    for t, w, x in zip(text.tolist(), word.tolist(), h.tolist()):
        if counts[x] > 1:
            near[t].append(w)
    words = [x.split() for x in texts]
    every = [(t, k, tuple(w[k:k + passage])) for t, w in enumerate(words) for k in range(len(w) - passage + 1)]
    seen = {}
    for t, k, x in every:
        seen.setdefault(x, []).append((t, k))
    at, first, hashes, own = sub.windows(texts, near, passage)
    made = {(t, k): (bytes(x), o) for t, k, x, o in zip(at.tolist(), first.tolist(), hashes, own.tolist())}
    by_hash = {}
    for t, k, x in every:
        if len(seen[x]) > 1:
            assert made[t, k][1] == (k - min(b for a, b in seen[x] if a == t) < passage)
            by_hash.setdefault(made[t, k][0], set()).add(x)
    assert all(len(x) == 1 for x in by_hash.values()) and len(by_hash) == sum(len(x) > 1 for x in seen.values())


def test_a_period_stays_once(spark):
    rows = [(1, " ".join(f"w{k % 7}" for k in range(300)), "en", "a")]
    assert sub.dedup(cases.documents(spark, rows), min_words=1000, passage=51).first()["text"].split() == rows[0][1].split()[:56]


def plain_words(docs, passage):
    """(id, words left) of each document: runs and windows go by first places, a window with what overlaps its first place in a text."""
    rank = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    order, first, rows = sorted({rank(r) for r in docs}), {}, []
    for r in docs:
        sizes = sub.sentence_words(r["text"] or "")
        words = [w for x in sizes for w in x]
        ends = [0]
        for x in sizes:
            ends.append(ends[-1] + len(x))
        spans = [(ends[k], ends[e], "run") for k, e in plain_places(sizes)] + [(k, k + passage, "window") for k in range(len(words) - passage + 1)]
        found = [(s, e, kind, (kind, *words[s:e])) for s, e, kind in spans]
        at = order.index(rank(r))
        for *_, x in found:
            first[x] = min(first.get(x, at), at)
        rows.append((r["doc_id"], at, words, found))
    out = []
    for key, at, words, found in rows:
        own, gone = {}, set()
        for s, e, kind, x in found:
            near = s - own.setdefault(x, s) < (passage if kind == "window" else 1)
            if first[x] != at or not near:
                gone |= set(range(s, e))
        out.append((key, [w for k, w in enumerate(words) if k not in gone]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("of", ["awkward", "shuffled", "table"])
def test_runs_and_passages_against_brute_force(spark, of):
    if of == "table":
        docs = cases.table(spark, "documents")
    else:
        rows = [r for r in cases.AWKWARD if len(r[1] or "") < 10_000]
        if of == "shuffled":  # passages of other sentences, in orders of their own, with ids that repeat or are null
            dice = random.Random(7)
            parts = [" ".join(f"s{k}w{j}" for j in range(9 + k % 8)) + "." for k in range(40)]
            for n in range(60):
                start, size = dice.randrange(30), dice.randrange(3, 11)
                text = [*parts[start:start + size], *(dice.choice(parts) for _ in range(3)), *parts[start:start + size - 1]]
                rows.append((dice.choice([None, n, n // 2]), " ".join(text)[dice.randrange(40):], "en", "a"))
        docs = cases.documents(spark, rows)
    got = [(r["id"], (r["text"] or "").split()) for r in sub.dedup(docs, passage=sub.PASSAGE).collect()]
    assert sorted(got, key=repr) == plain_words(docs.collect(), sub.PASSAGE)


def test_stretches():
    at = lambda s, e: (s << 32) + e
    found = [(at(0, 30), 5), (at(10, 40), 5), (at(40, 60), 5), (at(10, 45), None), (at(61, 130), 5), (at(40, 80), 6), (-9, None)]
    assert sub.stretches(found, 51) == [(0, 60), (61, 130)]
