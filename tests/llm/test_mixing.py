"""Raking against numpy, draws against hashlib."""

import hashlib

import numpy as np

import cases
from kpiloom.llm import mixing


def test_raked_weights_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, (6, 3, 4)).astype(float)
    tokens[0] *= 50  # a hot source
    cells = [(f"s{i}", f"l{j}" if j else None, f"t{k}", int(tokens[i, j, k])) for i in range(6) for j in range(3) for k in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    rows = mixing.probabilities(df, budget_share=0.5).collect()
    p = np.zeros(tokens.shape)
    for r in rows:
        p[int(r["source"][1]), int(r["lang"][1]) if r["lang"] else 0, int(r["topic"][1])] = r["p"]
    w = tokens / tokens.sum()
    targets = [np.power(w.sum(axis=tuple(a for a in range(3) if a != axis)), 0.7) for axis in range(3)]
    for _ in range(mixing.ROUNDS):
        for axis, t in enumerate(targets):
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * (t / w.sum(axis=tuple(a for a in range(3) if a != axis))).reshape(shape)
    f = w / tokens
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(1, mid * f) * tokens).sum() < 0.5 * tokens.sum() else (lo, mid)
    assert np.allclose(p, np.minimum(1, lo * f), rtol=1e-6)
    assert abs((p * tokens).sum() / tokens.sum() - 0.5) < 1e-6


def test_given_targets_win(spark):
    df = spark.createDataFrame([("a", "x", "t", 900), ("b", "x", "t", 100)], "source string, lang string, topic string, tokens long")
    p = {r["source"]: r["p"] for r in mixing.probabilities(df, targets={"source": {"a": 0.5, "b": 0.5}}, budget_share=0.1).collect()}
    assert abs(p["a"] * 900 - p["b"] * 100) < 1e-6 and abs(p["a"] * 900 + p["b"] * 100 - 100) < 1e-6


def test_draws_and_sample_agree(spark):
    docs = cases.documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        u = int(hashlib.md5(f"mix-1:{'' if r['id'] is None else r['id']}".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert r["kept"] == (u < r["p"]) and 0 < r["p"] <= 1
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]) for r in kept.collect())) == sorted(repr(r["id"]) for r in rows if r["kept"])


def test_everything_stays_when_the_budget_allows(spark):
    docs = cases.documents(spark)
    assert mixing.sample(docs, budget_share=1).count() == docs.count()


def test_empty_table(spark):
    docs = cases.documents(spark).limit(0)
    assert mixing.mix(docs).collect() == [] and mixing.sample(docs).collect() == []


def test_copies_meet_all_targets_where_cells_are_scarce(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 1000, (6, 3, 4)).astype(float)
    tokens[0] *= 50
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(6) for j in range(3) for k in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    rows = mixing.probabilities(df, repeat=True, rounds=20).collect()
    assert max(r["p"] for r in rows) > 1
    total = tokens.sum()
    assert abs(sum(r["p"] * r["tokens"] for r in rows) / total - mixing.BUDGET_SHARE) < 1e-9
    for axis, dim in enumerate(mixing.DIMS):
        want = np.power(tokens.sum(axis=tuple(a for a in range(3) if a != axis)) / total, mixing.ALPHA)
        got = np.zeros(len(want))
        for r in rows:
            got[int(r[dim][1])] += r["p"] * r["tokens"]
        assert np.allclose(got / got.sum(), want / want.sum(), rtol=1e-6), dim


def test_copies_and_sample_agree(spark):
    docs = cases.documents(spark, [(k, cases.PROSE + ("!!" if k % 40 == 0 else ""), "en", "a") for k in range(400)])
    rows = mixing.mix(docs, repeat=True, targets={"topic": {"promotion": 0.5, "prose": 0.5}}, budget_share=0.5).collect()
    for r in rows:
        u = int(hashlib.md5(f"mix-1:{r['id']}".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert r["copies"] == int(r["p"]) + (u < r["p"] - int(r["p"]))
    rare = [r for r in rows if r["topic"] == "promotion"]
    assert len(rare) == 10 and all(r["copies"] >= 9 for r in rare)
    got = mixing.sample(docs, repeat=True, targets={"topic": {"promotion": 0.5, "prose": 0.5}}, budget_share=0.5)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["id"] for r in rows for _ in range(r["copies"]))
    assert mixing.sample(docs.limit(0), repeat=True).collect() == []
