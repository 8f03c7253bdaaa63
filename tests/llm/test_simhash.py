"""SimHash against all pairs."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from kpiloom.llm import simhash


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < k else [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB éÉ\t\n\x0b\x1cz", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def expected(rows, radius):
    fps = [plain_fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    low = cases.components(len(fps), pairs)
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if low[j] == low[k] and rows[j]["doc_id"] is not None]
        out.append((r["doc_id"], fps[k], min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("of", ["awkward", "table"])
def test_components(spark, of):
    docs = cases.documents(spark) if of == "awkward" else cases.table(spark, "documents")
    got = [(r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == expected(docs.collect(), 2)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_join_what_all_pairs_join(spark, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 62, 12).tolist()
    fps = sorted({s ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for s in seeds for _ in range(12)} | {0, 1, 3})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fingerprint long")
    got = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(rows, radius).collect()]
    at = {f: k for k, f in enumerate(fps)}
    assert all((u ^ v).bit_count() <= radius for u, v in got)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    assert cases.components(len(fps), [(at[u], at[v]) for u, v in got]) == cases.components(len(fps), pairs)


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = {(c if c is not None else ("null", f)) for _, f, c in expected(docs.collect(), 2)}
    assert len(rows) == len(groups)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(g for g in groups if not isinstance(g, tuple))


def test_rows_without_ids_keep_one_for_each_text(spark):
    docs = cases.documents(spark, [(None, cases.PROSE, "en", "a"), (None, cases.PROSE, "en", "a"), (None, "other words here now", "en", "a")])
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted([cases.PROSE, "other words here now"])


def test_empty_table(spark):
    docs = cases.documents(spark).limit(0)
    assert simhash.near_duplicates(docs).collect() == [] and simhash.drop_near_duplicates(docs).collect() == []
