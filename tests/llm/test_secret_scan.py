"""Trigram queries never lose a match; spans against plain expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from kpiloom.llm import secret_scan as ss

SAMPLES = [
    'My PASSWORD = "abcdefgh1" and api_key:12345678, apiKEY: short; Passwd:aaaaaaaa', "AKIA1234567890ABCD AKIA12 xAKIA1234567890123",
    "deadbeef" * 4 + " " + "0" * 31 + " " + "f" * 64, "-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 20,
    "xoxb-1234567890ab", "AIza" + "B" * 35, "sk_live_" + "9" * 20, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "postgres://user:pass@host/db",
    "ſecret: 12345678 toKen=abcdefgh1 ſecret", "secret:" + " " * 1000 + "x" * 8, "", "token",
]


def plain(text):
    found = []
    for n, r in enumerate(ss.RULES):
        for m in re.finditer(r.pattern, text, r.flags):
            if r.accept is None or r.accept(m):
                found.append((m.start(), n, m.end()))
    return [(ss.RULES[n].kind, s, e) for s, n, e in sorted(found)]


def test_samples():
    assert ss.scan_texts(SAMPLES) == [plain(t) for t in SAMPLES]
    assert {k for t in SAMPLES for k, _, _ in plain(t)} == {r.kind for r in ss.RULES}


def test_base_rules_as_stated():
    text = " ".join(SAMPLES)
    hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    got = ss.scan_texts([text])[0]
    assert [x[1:] for x in got if x[0] == "hex"] == hexes and [x[1:] for x in got if x[0] == "access"] == access


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aApPiI_kKeEyY:=tokn\"' 1ſKé", max_size=40))
def test_index_loses_nothing(text):
    assert ss.scan_texts([text, "api_key=12345678"]) == [plain(text), plain("api_key=12345678")]


@pytest.mark.parametrize("pattern, matches", [
    (r"abc|abd", ["abc", "abd"]), (r"(foo|ba[rz])+x?qux", ["fooqux", "barxqux", "bazfooqux"]), (r"a.c", ["abc"]), (r"[a-z]{3}", ["xyz"]),
    (r"hello\s+world", ["hello world"]), (r"(?:ab)?cde", ["cde", "abcde"]), (r"x(?=yz)yzw", ["xyzw"]), (r"É[éa]bcd", ["Éabcd"]), (r"q*", [""]),
])
def test_query_holds_for_every_match(pattern, matches):
    query = ss.trigram_query(pattern, re.IGNORECASE)
    for text in matches + [m.upper() for m in matches]:
        assert re.fullmatch(pattern, text, re.IGNORECASE)
        assert ss.Segment([f"..{text}.."]).ask(query).tolist() == [0]


def test_queries_leave_documents_out():
    segment = ss.Segment(["nothing here", "pass the word", "a password here"])
    assert segment.ask(ss.trigram_query(ss.RULES[0].pattern, ss.RULES[0].flags)).tolist() == [2]
    assert ss.trigram_query(ss.RULES[2].pattern) is ss.ALL


@pytest.mark.parametrize("of", ["awkward", "table", "empty"])
def test_every_row(spark, of):
    docs = cases.table(spark, "documents") if of == "table" else cases.documents(spark)
    docs = docs.limit(0) if of == "empty" else docs
    got = [(r["id"], [tuple(s) for s in r["spans"]]) for r in ss.scan(docs).collect()]
    assert sorted(got, key=repr) == sorted(((r["doc_id"], plain(r["text"] or "")) for r in docs.collect()), key=repr)
