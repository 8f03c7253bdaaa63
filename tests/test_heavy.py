"""Top values by summaries against plain counts: skewed, tied and unique columns, summaries too small to be sure."""

from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import heavy
from kpiloom.operators.profile import profile_categorical


def plain(rows, cols):
    out = {}
    for k, c in enumerate(cols):
        counts = Counter(r[k] for r in rows if r[k] is not None)
        top = min(counts, key=lambda v: (-counts[v], v)) if counts else None
        out[c] = (sum(counts.values()), len(counts), top, counts[top] if counts else None)
    return out


def got(df):
    return {r["column"]: (r["count"], r["unique"], r["top"], r["freq"]) for r in df.collect()}


@pytest.mark.parametrize("counters,candidates", [(1024, 10_000), (8, 10_000), (2, 3)])
def test_against_counts(spark, counters, candidates):
    rng = Random(counters)
    rows = []
    for k in range(4000):
        hot = "x" * 300 if rng.random() < 0.34 else f"text {rng.randint(0, 2500)}"
        rows.append((hot, f"only {k}", rng.choice(["b", "a", None]), None, f"{k % 40}", "é😀" if k % 3 else ""))
    cols = ["hot", "only", "few", "none", "tied", "odd"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).repartition(6)
    assert got(heavy.profile_texts(df, cols, counters, candidates)) == plain(rows, cols)


def test_summaries_bound_the_counts(spark):
    rng = Random(5)
    values = [f"v{min(rng.randint(1, 400), rng.randint(1, 400))}" for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    true = {tuple(r[0]): r[1] for r in df.groupBy(heavy.text_hash(F.col("v")).alias("h")).count().collect()}
    held = heavy.merged(heavy.summaries(df, ["v"], 50)).collect()
    (total,) = [r for r in held if r["h1"] is None]
    assert total["low"] == 6000 and total["off"] > 0
    low = {(r["h1"], r["h2"]): r["low"] for r in held if r["h1"] is not None}
    assert all(low.get(h, 0) <= n <= low.get(h, 0) + total["off"] for h, n in true.items())


def test_as_the_categorical_profile(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), (None, "y")], "p string, q string")
    assert got(heavy.profile_texts(df, ["p", "q"])) == got(profile_categorical(df, ["p", "q"]))
    assert got(heavy.profile_texts(df.limit(0), ["p", "q"])) == {"p": (0, 0, None, None), "q": (0, 0, None, None)}
