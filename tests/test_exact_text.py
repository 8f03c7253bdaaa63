"""Number text against Python's own formatting of the same doubles."""

import math
from random import Random

from pyspark.sql import functions as F

from kpiloom.functions import exact as E


def values():
    rng = Random(8)
    out = [0.0, 0.125, 0.375, 0.5, 1.5, 2.5, 2.675, 1.005, 0.05, 0.15, 0.25, 999.5, 999.95, 1000.0, 1e6, 999999.5, 1e15 + 0.5, 2.0 ** 53, 2.0 ** 60 + 4096,
           1e22, 123456789012345678.0, 5e-324, 1e-20, 0.005, 0.0049999999999999999, math.nextafter(0.5, 1), math.nextafter(0.5, 0), 1e300]
    out += [rng.uniform(-10, 10) ** rng.randint(1, 9) for _ in range(400)]
    out += [rng.randint(-10 ** 6, 10 ** 6) / 2 ** rng.randint(0, 12) for _ in range(400)]
    out += [round(rng.uniform(0, 5000), 3) for _ in range(300)]
    return [float(x) for x in out] + [-float(x) for x in out if x]


def test_fixed_text_is_python_s(spark):
    rows = list(enumerate(values()))
    df = spark.createDataFrame(rows, "k int, x double")
    got = df.select("k", *[E.fixed_exact("x", d).alias(f"f{d}") for d in (0, 1, 2, 4)], E.fixed_exact("x", 2, thousands=True).alias("t"),
                    E.fixed_exact("x", 1, sign=True).alias("s"), E.money_exact("x").alias("m"), E.percent_exact("x", True).alias("p")).collect()
    at = dict(rows)
    for r in got:
        x = at[r["k"]]
        if abs(x) < 1e28:
            for d in (0, 1, 2, 4):
                assert r[f"f{d}"] == f"{x:.{d}f}", x
            assert r["t"] == f"{x:,.2f}" and r["m"] == f"${x:,.2f}", x
            assert r["s"] == f"{x:+.1f}" and r["p"] == f"{x:+.1f}%", x


def metric(x):
    a, sign = abs(x), "-" if x < 0 else ""
    return f"{sign}$" + (f"{a / 1e6:.2f}M" if a >= 1e6 else f"{a / 1e3:.1f}K" if a >= 1e3 else f"{a:,.0f}")


def test_short_money(spark):
    rows = [(k, x) for k, x in enumerate(values()) if abs(x) < 1e28]
    df = spark.createDataFrame(rows, "k int, x double")
    assert {r["k"]: r["m"] for r in df.select("k", E.format_metric_exact("x").alias("m")).collect()} == {k: metric(x) for k, x in rows}
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in odd.select(E.format_metric_exact("x")).collect()] == ["N/A", "N/A", "$infM", "-$infM"]
    assert [r[0] for r in odd.select(E.fixed_exact("x", 1)).collect()] == [None, "nan", "inf", "-inf"]
