"""Every registered query against its DuckDB oracle (sf0.001, whole tables)."""

import os

import pytest

from oracle_check import compare, duck

SF = os.environ.get("KPILOOM_TEST_SF", "/root/testdata/sf0.001")

from kpiloom.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402

load_all()


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("test data missing")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    if name not in ORACLE:
        assert r["rows"] >= 0
        return
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["exact"] or r["approx"], r
