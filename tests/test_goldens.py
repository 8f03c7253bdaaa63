"""Hand-worked KPI, health and confidence values on a small table of our own."""

import pytest

from kpiloom.mapping import detect_columns
from kpiloom.operators.clean import clean_dataset
from kpiloom.operators.cube import fact_cube
from kpiloom.operators.kpis import data_confidence, kpi_facts, kpi_summary
from kpiloom.sources.csv import DEFAULT_SETTING, load_csv

SALES = """Date,Region,Product,Revenue,Profit
2025-01-10,North,Alpha,100,40
2025-01-11,South,Beta,100,20
2025-02-10,North,Alpha,150,60
2025-02-11,South,Beta,50,10
2025-03-10,North,Alpha,200,80
2025-03-11,South,Beta,100,10
"""


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sales") / "sales.csv"
    path.write_text(SALES)
    df = load_csv(spark, str(path))
    m = detect_columns(df)
    return clean_dataset(df, m), m, str(path)


def test_detect_roles(sample):
    m = sample[1]
    assert (m.date, m.region, m.product, m.revenue, m.profit) == ("Date", "Region", "Product", "Revenue", "Profit")


def test_kpi_golden(sample):
    """Months 200, 200, 300: +50 %, sample deviation sqrt(10000/3).  Regions 450 and 250: sum of squared shares 265000/490000."""
    df, m, _ = sample
    f = kpi_facts(fact_cube(df, m), (), True).first().asDict()
    assert (f["n_rows"], f["total_revenue"], f["total_profit"]) == (6, 700, 220)
    assert f["profit_margin"] == pytest.approx(220 / 7)
    assert (f["top_region"], f["top_region_rev"], f["top_product"], f["top_product_rev"]) == ("North", 450, "Alpha", 450)
    assert (f["worst_region"], f["worst_region_margin"], f["worst_product"], f["worst_product_margin"]) == ("South", 16.0, "Beta", 16.0)
    assert f["top_product_margin"] == 40.0
    assert (f["n_months"], f["first_month"], f["last_month"], f["pct_change"]) == (3, "2025-01", "2025-03", 50.0)
    assert (f["growth_score"], f["margin_score"]) == (100, pytest.approx(220 / 7 / 40 * 100))
    assert f["consistency_score"] == pytest.approx(100 - (10000 / 3) ** 0.5 / (700 / 3) * 100)
    assert f["balance_score"] == pytest.approx((1 - 265000 / 490000) * 200)
    assert (f["health_score"], f["health_status"]) == (86, "Robust")


def test_kpi_golden_with_and_without_the_first_sum(sample):
    df, m, _ = sample
    key = lambda r: (r["level"], r["key"] or "")
    assert sorted(fact_cube(df, m, fine=True).collect(), key=key) == sorted(fact_cube(df, m, fine=False).collect(), key=key)


def test_kpi_golden_no_profit(sample):
    df, m, _ = sample
    k = kpi_summary(df.drop("Profit"), m.with_overrides({"profit": None})).first()
    assert (k["health_score"], k["health_status"]) == (89, "Robust")


def test_confidence_golden(sample):
    assert data_confidence(sample[0]).first()["confidence"] == 90


def test_default_dataset(spark, sample):
    with pytest.raises(ValueError):
        load_csv(spark)
    spark.conf.set(DEFAULT_SETTING, sample[2])
    try:
        assert load_csv(spark).count() == 6
    finally:
        spark.conf.unset(DEFAULT_SETTING)
