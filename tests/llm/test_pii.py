"""Base spans against the plain expressions; labels and classifier on planted spans."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from kpiloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[0::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1250@.+- ()_%é", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_planted_texts():
    text = "a@b.co_x@d.e x 4111 1111-1111 1111, 192.168.0.1 300.1.1.1 1.2.3.4.5.6.7.8 +1 (735) 555-5082 +12 00000255.1.1.1 4111111111111111"
    assert pii.base_spans(text) == plain_spans(text)
    assert {k for k, _, _ in pii.base_spans(text)} == set(PLAIN)


def test_long_runs_cost_little():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "+1" + "(" * 100_000 + "@" * 100_000
    pii.decide(text, pii.Model())


def planted(n, seed):
    """(text, true spans) with real data and look-alikes."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        real = rng.random() < 0.6
        digits = f"{rng.randint(200, 989)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        mail = f"user{rng.randint(1, 99)} [at] mail [dot] {'com' if real else 'qqq'}"
        lead = rng.choice(["please call phone", "tel contact"] if real else ["order ref", "part serial version"])
        lead2 = rng.choice(["write mail to", "contact"] if real else ["article id", "ref"])
        kind, span, before = rng.choice([("phone", "1" + digits[1:], lead), ("email", mail, lead2)])
        if kind == "phone":
            span = digits if not real else "44" + digits[2:]
        text = f"Some words here {before} {span} and more words."
        out.append((text, [(kind, text.index(span), text.index(span) + len(span))] if real else []))
    return out


def test_classifier_separates_held_out_spans(spark):
    train = [(k, t, "en", "a") for k, (t, _) in enumerate(planted(600, 1))]
    model = pii.fit(cases.documents(spark, train))
    right = sum([s[:3] for s in pii.decide(t, model)] == want for t, want in planted(300, 2))
    assert right >= 0.9 * 300
    assert model.reliability["cue", 1, 1] > model.reliability["cue", 0, 1]
    assert model.reliability["counter_cue", 0, -1] > model.reliability["counter_cue", 1, -1]


def test_every_row_and_base_spans_stay(spark):
    docs = cases.table(spark, "documents")
    model = pii.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert [x for x, s in zip(spans, r["spans"]) if s["base"]] == plain_spans(texts[r["id"]])
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_masked_texts_hold_no_base_spans(spark):
    rows = [(1, "mail a@b.com or +1 (735) 555-5082, card 4111 1111 1111 1111.", "en", "a"), (2, None, "en", "a"), (3, "clean text", "en", "a"), (3, "clean text", "en", "a")]
    docs = cases.documents(spark, rows)
    masked = pii.mask(docs, pii.fit(docs))
    assert masked.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"]) for r in masked.collect() if r["text"])
    assert texts == [(1, "mail [EMAIL] or [PHONE], card [CARD]."), (3, "clean text"), (3, "clean text")]
    assert masked.where("text is null").count() == 1


def test_awkward_and_empty_tables(spark):
    docs = cases.documents(spark)
    model = pii.fit(docs)
    assert pii.find(docs, model).count() == docs.count()
    assert pii.fit(docs.limit(0)).weights == {} and pii.find(docs.limit(0), model).collect() == []
