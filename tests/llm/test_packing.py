"""Packing: the search against an exhaustive one, places against the whole tokenizer."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from kpiloom.llm import packing
from kpiloom.llm.tokens import Encoder, vocabulary


def optimum(lengths, capacity):
    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        best = len(left)

        def fill(first, gap, rest):
            nonlocal best
            best = min(best, 1 + least(rest))
            for k in range(first, len(rest)):
                if rest[k] <= gap and (k == 0 or k == first or rest[k] != rest[k - 1]):
                    fill(k, gap - rest[k], rest[:k] + rest[k + 1:])

        fill(0, capacity - left[0], left[1:])
        return best

    return least(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_search_finds_the_optimum(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    found = packing.complete(counts, 12, nodes=4000, width=50)
    placed = [x for f, n in found for x in f * n]
    assert sorted(placed) == sorted(lengths) and all(sum(f) <= 12 for f, _ in found)
    assert packing.lower_bound(counts, 12) <= sum(n for _, n in found) == optimum(lengths, 12)


def test_search_beats_best_fit_decreasing():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 7: 1, 2: 1, 8: 1}
    best = packing.complete(counts, 16, nodes=5000)
    assert sum(n for _, n in best) <= sum(n for _, n in packing._best_fit(counts, 16))


ODD = ["Hello, WORLD!! it's 3rd 'tis “quoted”…  naïve ÀÉ ªº µ ß 123 4.5. ... a.b, c,, x;: don't we'll \x1c a\x1cb  nb\xa0sp   ΣΑΣ İstanbul "
       "<|endoftext|> <|im_end|> 日本語 é \tq\r\n\x85z", "", " ", "\n\n", "a" * 60 + ". " + "b" * 5000, "ª. º, ǅ. ŉ x́ ́y"]


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(vocabulary())
    texts = ODD + [r[1] or "" for r in cases.AWKWARD]
    for tool in (Encoder(vocabulary()),) * 2:  # the second time from the cache
        for raw, text in zip(tool.encode(texts), texts):
            assert np.frombuffer(raw, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abÀéßÿµΣİ .,!?'\n\xa0\x1c1", max_size=30))
def test_any_text_encodes_as_a_whole(text):
    assert np.frombuffer(TOOL.encode([text])[0], dtype="<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


TOOL, WHOLE = Encoder(vocabulary()), Tokenizer.from_file(vocabulary())


def check(spark, docs, capacity):
    rows = packing.pack(docs, capacity=capacity, with_ids=True).collect()
    got, sequences = [], {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        got.append((r["id"], r["piece"], r["start"], tuple(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = []
    for d in docs.collect():
        ids = WHOLE.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        want += [(d["doc_id"], n, s, tuple(ids[s:s + capacity])) for n, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r["length"] for r in rows]
    return len(sequences), packing.lower_bound({x: lengths.count(x) for x in set(lengths)}, capacity)


def test_places_of_documents(spark):
    assert check(spark, cases.documents(spark), 64)[0] >= 1
    used, bound = check(spark, cases.table(spark, "documents"), 2048)
    assert used <= bound + 1


def test_ranks_in_many_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    check(spark, cases.documents(spark, [(k, "same words", "en", "a") for k in range(100)] + [(1, "same words", "en", "a")]), 16)


def test_empty_table(spark):
    assert packing.pack(cases.documents(spark).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 60))
def test_incumbent_is_textbook_best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(capacity - x)
    found = packing._best_fit({x: lengths.count(x) for x in set(lengths)}, capacity)
    assert sorted(x for f, n in found for x in f * n) == sorted(lengths)
    assert sorted(capacity - sum(f) for f, n in found for _ in range(n)) == sorted(gaps)


@pytest.mark.parametrize("counts", [{2: 3000}, {2: 100_000}, {1: 5000}, {1621: 28, 1485: 11, 3: 4832, 2: 8988}])
def test_sequences_of_very_many_pieces(counts):
    found = packing.complete(counts)
    placed = Counter()
    for f, n in found:
        assert sum(f) <= packing.CAPACITY
        placed.update({x: f.count(x) * n for x in set(f)})
    assert placed == counts and sum(n for _, n in found) == packing.lower_bound(counts, packing.CAPACITY)
