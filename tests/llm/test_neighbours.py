"""Nearest neighbours against brute force: recall, exact scores and order, copies, lengths and norms."""

import numpy as np

import cases
from kpiloom.llm import neighbours, queries
from pyspark.sql import functions as F


def brute(rows, wanted, k):
    """rows (id, vector) -> {query id: [(score, id), ...]}, all candidates, nearest first."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, v) in enumerate(good):
        if q is not None and wanted(q):
            all_ = [(-float(np.dot(v, w)), i is None, i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v)]
            out.setdefault(q, []).append([(-s, i) for s, _, i in sorted(all_, key=lambda x: (x[0], x[1], x[2] or 0))[:k]])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["id"]))
    return out


def recall(got, want):
    hits = total = 0
    for q, (own,) in want.items():
        hits += len({i for _, i in own} & {i for _, _, i in got.get(q, [])})
        total += len(own)
    return hits / total


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in vectors], "vec_id long, embedding array<float>")


def f32(m):
    return m.astype(np.float32).astype(float)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    m = f32(rng.normal(size=(60, 8)))
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7)]
    rows += [(300 + k, v.tolist()) for k, v in enumerate(f32(rng.normal(size=(5, 3))))] + [(None, f32(rng.normal(size=8)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ["id", "node", "dim", "block", "rank", "dotted.name"]})
    got = found(neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=20))
    want = brute(rows, lambda q: q % 5 == 0, 20)
    assert set(got) == set(want) and len(got[300]) == 4
    for q, (own,) in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(own) + 1))
        assert [i for _, _, i in got[q]] == [i for _, i in own]
        assert np.allclose([s for _, s, _ in got[q]], [s for s, _ in own], rtol=1e-12, atol=1e-12)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    m = f32(rng.normal(size=(40, 6)))
    m[1:30] = m[0]
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(0, m[0].tolist()), (35, m[35].tolist())]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=20).orderBy("query_id", "rank").collect()
    want = brute(rows, lambda q: q % 5 == 0, 20)
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append(r["id"])
    for q, own in want.items():
        each = sorted([i for _, i in o] for o in own)
        assert sorted(lists[q]) == sorted(i for o in each for i in o), q


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    m = np.concatenate([centres[rng.integers(12, size=1200)] + 0.2 * rng.normal(size=(1200, 24)), centres[0] + 0.02 * rng.normal(size=(700, 24)),
                        rng.normal(size=(1100, 24)) * rng.uniform(0.5, 4, size=(1100, 1))])
    rows = [(k, v.tolist()) for k, v in enumerate(f32(m))]
    options = dict(leaf=200, tables=2, rounds=4, beam=120, expand=30)  # cells smaller than the table, so that the rounds must find the rest
    got = found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, **options))
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert recall(got, want) >= 0.9
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [i for _, _, i in own]
        assert [(-s, i) for _, s, i in own] == sorted((-s, i) for _, s, i in own)
        assert np.allclose([s for _, s, _ in own], [np.dot(np.array(rows[q][1]), np.array(rows[i][1])) for _, _, i in own], rtol=1e-12)


def test_rounds_improve_the_graph(spark):
    rng = np.random.default_rng(4)
    m = f32(rng.normal(size=(1500, 12)))
    rows = table(spark, [(k, v.tolist()) for k, v in enumerate(m)]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    nodes = neighbours.nodes_of(rows, 20)
    shares = []
    at = {r["node"]: np.array(r["unit"], dtype=np.float64) for r in nodes.collect()}
    names, unit = list(at), np.stack(list(at.values()))
    for rounds in (0, 3):
        graph = {r["node"]: r["ids"] for r in neighbours.neighbour_graph(nodes, k=16, rounds=rounds, tables=1, leaf=100).collect()}
        hits = 0
        for n, name in enumerate(names[:200]):
            s = unit @ unit[n]
            s[n] = -9
            hits += len({names[k] for k in np.argsort(-s)[:16]} & set(graph[name]))
        shares.append(hits / 200 / 16)
    assert shares[0] < 0.5 and shares[1] > 0.85, shares


def test_queries_from_outside(spark):
    rng = np.random.default_rng(5)
    m, q = f32(rng.normal(size=(800, 10))), f32(rng.normal(size=(15, 10)))
    got = found(neighbours.nearest_to(table(spark, [(k, v.tolist()) for k, v in enumerate(m)]), table(spark, [(k, v.tolist()) for k, v in enumerate(q)]), k=10))
    hits = sum(len({int(k) for k in np.argsort(-(m @ v))[:10]} & {i for _, _, i in got[n]}) for n, v in enumerate(q))
    assert hits / 150 >= 0.9


def test_the_query_over_the_table(spark):
    df = queries.QUERIES["op12_nearest_neighbours"](spark, cases.SF)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = found(df.withColumnRenamed("vec_id", "id"))
    rows = [tuple(r) for r in cases.table(spark, "embeddings").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(len(got[q]) == len(own) for q, (own,) in want.items())
