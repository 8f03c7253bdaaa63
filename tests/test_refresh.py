"""Cubes refreshed by changes against cubes from scratch."""

from decimal import Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from kpiloom.mapping import Mapping
from kpiloom.operators import refresh as R
from kpiloom.operators.cube import fact_cube

M = Mapping(date="d", region="r", product="p", revenue="rev", profit="prof")
KIND = "id long, d string, r string, p string, rev decimal(12,2), prof decimal(12,2), seg string"


def table(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], KIND).withColumn("d", F.to_timestamp("d"))


def random_row(rng):
    money = lambda: rng.choice([None, Decimal(rng.randint(-9999, 99999)) / 100])
    return (f"2024-{rng.randint(1, 5):02}-03", rng.choice(["N", "S", None]), rng.choice("AB"), money(), money(), rng.choice(["x", "y", None]))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("seg", "level", "key", "revenue", "profit", "n").collect()), key=str)


def test_snapshots_and_changes_equal_a_new_cube(spark):
    rng = Random(4)
    now = {k: random_row(rng) for k in range(300)}
    state = R.cells(table(spark, now), M, ["seg"])
    for _ in range(2):
        later = {k: random_row(rng) if rng.random() < 0.1 else v for k, v in now.items() if rng.random() < 0.8}
        later |= {1000 + rng.randint(0, 10 ** 6): random_row(rng) for _ in range(40)}
        delta = R.snapshot_change(table(spark, now), table(spark, later), ["id"], M, ["seg"])
        state = R.refreshed(state, delta, by=["seg"])
        now = later
        assert rows_of(R.cube_of(state, ["seg"])) == rows_of(fact_cube(table(spark, now), M, ["seg"]))


def test_months_and_labels_without_rows_are_gone(spark):
    rows = {1: ("2024-01-01", "N", "A", Decimal("1"), Decimal("1"), "x"), 2: ("2024-02-01", "S", "B", Decimal("2"), None, "x")}
    df = table(spark, rows)
    left = R.refreshed(R.cells(df, M, ["seg"]), R.change(None, df.where("id = 2"), M, ["seg"]), by=["seg"])
    assert rows_of(R.cube_of(left, ["seg"])) == rows_of(fact_cube(df.where("id = 1"), M, ["seg"]))
    assert R.refreshed(left, R.change(None, df.where("id = 1"), M, ["seg"]), by=["seg"]).collect() == []


def test_a_change_of_another_state_fails(spark):
    df = table(spark, {1: ("2024-01-01", "N", "A", Decimal("1"), Decimal("1"), "x")})
    with pytest.raises(Exception, match="does not have"):
        R.refreshed(R.cells(df, M), R.change(None, df, M), R.change(None, df, M)).collect()
