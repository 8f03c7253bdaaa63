"""Lattice hashing against all pairs."""

import numpy as np
import pytest

import cases
from kpiloom.llm import embeddings as em


def test_nearest_lattice_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    found = em.nearest(y)
    doubled = np.rint(2 * found).astype(int)
    assert np.allclose(2 * found, doubled) and ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    assert (found.sum(axis=1) % 2 == 0).all()
    assert len(em.roots()) == 240 and np.allclose((em.roots() ** 2).sum(axis=1), 2)
    d = ((y - found) ** 2).sum(axis=1)
    assert all((((y[k] - found[k] - em.roots()) ** 2).sum(axis=1) >= d[k] - 1e-9).all() for k in range(300))


def expected(rows, cosine=0.95):
    ok = [r["embedding"] is not None and len(r["embedding"]) > 0 and all(x is not None and np.isfinite(x) for x in r["embedding"])
          and any(r["embedding"]) for r in rows]
    pairs = []
    v = [np.array(r["embedding"], dtype=float) if o else None for r, o in zip(rows, ok)]
    v = [x / np.linalg.norm(x) if x is not None else None for x in v]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(v[i]) == len(v[j]) and float(v[i] @ v[j]) >= cosine:
                pairs.append((i, j))
    low = cases.components(len(rows), pairs)
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j]["vec_id"] for j in range(len(rows)) if low[j] == low[k] and rows[j]["vec_id"] is not None]
        component = min(ids) if ids else None
        out.append((r["vec_id"], sum(k in p for p in pairs), component, r["vec_id"] == component))
    return sorted(out, key=repr)


def frame(spark, vectors, ids=None):
    rows = [(ids[k] if ids else k, v, "x", 1) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, copies int")


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [1.0, 0.1, 0.0], None, None, [], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0],
         [None, 1.0, 0.0], [1.0, 0.0], [1.0], [3.0], [-1.0], [1e38, 1e38, 0.0], [1e-38, 1e-38, 0.0]]
    df = frame(spark, v, [None, 0, *range(2, 17), 2])
    got = sorted((tuple(r) for r in em.near_duplicates(df).collect()), key=repr)
    assert got == expected(df.collect())


@pytest.mark.parametrize("block", [512, 5])
def test_groups_in_one_or_many_blocks(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 64))
    v = [(centres[k % 6] + rng.normal(size=64) * (0.04 + 0.05 * (k % 3))).tolist() for k in range(90)] + rng.normal(size=(60, 64)).tolist()
    v += v[:10]
    df = frame(spark, v)
    assert sorted((tuple(r) for r in em.near_duplicates(df, block=block).collect()), key=repr) == expected(df.collect())


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.95, the hardest ones."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(400, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * b
    found = em.near_duplicates(frame(spark, [*a.tolist(), *c.tolist()])).collect()
    assert sum(r["n_links"] for r in found) >= 0.9 * 800
    assert all(r["n_links"] <= 1 for r in found)


def test_table(spark):
    df = cases.table(spark, "embeddings")
    assert sorted((tuple(r) for r in em.near_duplicates(df).collect()), key=repr) == expected(df.collect())


def test_empty_table(spark):
    assert em.near_duplicates(cases.table(spark, "embeddings").limit(0)).collect() == []
