"""Quality rules against a plain Python version."""

import re
from collections import Counter

import pytest

import cases
from kpiloom.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def judged(docs, limit=0.5):
    """kept of each document, by the moments prior worked out row by row."""
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(measured(d["text"])["base_failed"])
    n = sum(map(len, by.values()))
    m = sum(map(sum, by.values())) / n
    spread = max(0.0, sum(sum(x) ** 2 / len(x) for x in by.values()) - n * m * m)
    size = n - sum(len(x) ** 2 for x in by.values()) / n
    between = (spread - (len(by) - 1) * m * (1 - m)) / size if size > 0 else 0
    strength = min(max(m * (1 - m) / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
    bad = {h for h, x in by.items() if (sum(x) + m * strength) / (len(x) + strength) > limit}
    return [not measured(d["text"])["base_failed"] and d["source"] not in bad for d in docs]


@pytest.mark.parametrize("of", ["awkward", "table"])
def test_measures_and_verdicts(spark, of):
    docs = cases.documents(spark) if of == "awkward" else cases.table(spark, "documents")
    rows = docs.collect()
    key = lambda r: repr(sorted(r.items(), key=repr))
    want = sorted((dict(id=d["doc_id"], host=d["source"], kept=k, **measured(d["text"])) for d, k in zip(rows, judged(rows))), key=key)
    got = sorted((r.asDict() for r in quality.quality(docs).collect()), key=key)
    assert got == want


def test_many_repeated_windows_by_either_way(spark):
    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{text} {text}"), (2, f"{text} tail {text[:60]}"), (3, "a b c d e " * 30)], "doc_id int, text string")
    got = {r["doc_id"]: r["measures"]["n_repeat_words"] for r in quality.measure(docs).collect()}
    assert got == {r["doc_id"]: measured(r["text"])["n_repeat_words"] for r in docs.collect()}
    assert got[1] == 800


def test_host_with_failures_takes_its_good_documents_along(spark):
    good = cases.PROSE
    rows = [(k, "too short" if k % 10 else good, "en", "bad") for k in range(200)] + [(1000 + k, good + f" {k}", "en", f"h{k % 20}") for k in range(400)]
    rows += [(5000, "short", "en", "tiny")]
    docs = cases.documents(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["source"] for r in kept.select("source").collect()} == {f"h{k}" for k in range(20)}
    assert kept.count() == 400


def test_empty_table(spark):
    docs = cases.documents(spark).limit(0)
    assert quality.quality(docs).collect() == [] and quality.keep_good(docs).collect() == []
