"""Edge tables (FIXTURES.md §3) built in the tests themselves."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.mapping import Mapping, catalog_of, detect_columns, detect_columns_catalog
from kpiloom.operators.brief import brief_facts
from kpiloom.operators.clean import clean_dataset, cleaning_report, preview
from kpiloom.operators.cube import fact_cube
from kpiloom.operators.kpis import data_confidence, kpi_facts, kpi_summary
from kpiloom.operators.profile import profile_long, profile_numeric
from kpiloom.operators.questions import answer_confidence, prompt_messages, request_rows
from kpiloom.operators.ranks import running_before
from kpiloom.operators.textops import markdown_blocks, markdown_section
from kpiloom.operators.views import region_top_others

M = Mapping(date="d", region="r", product="p", revenue="rev", profit="prof")


def test_dirty_money(spark):
    vals = ["$1,200.50", "(500)", "1.2e3", "45%", "--5", "1-2", "5-", "", "-7", None]
    rows = [(i, "2025-01-01", "N", "A", v, "1") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, d string, r string, p string, rev string, prof string")
    out = {r["id"]: r["rev"] for r in clean_dataset(df, M, "yyyy-MM-dd").collect()}
    assert out == {0: 1200.5, 1: 500.0, 2: 1.23, 3: 45.0, 8: -7.0}


def test_null_profit_drops_row_and_bad_dates(spark):
    rows = [(1, "2025-01-05", "N", "A", "10", None), (2, "01/06/2025", "N", "A", "10", "1"),
            (3, "2025-01-07", None, "A", "10", "1"), (4, "2025-01-08", "N", "A", "10", "2")]
    df = spark.createDataFrame(rows, "id long, d string, r string, p string, rev string, prof string")
    out = clean_dataset(df, M, "yyyy-MM-dd").collect()
    assert [r["id"] for r in out] == [4]
    assert out[0]["d"] == dt.datetime(2025, 1, 8)


def test_no_core_column_gives_empty(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert clean_dataset(df, Mapping(date="x", region="y", product="z", revenue="w")).count() == 0


def _facts(spark, rows, profit=True):
    schema = "d timestamp, r string, p string, rev double, prof double"
    df = spark.createDataFrame(rows, schema)
    m = M if profit else M.with_overrides({"profit": None})
    if not profit:
        df = df.drop("prof")
    return kpi_facts(fact_cube(df, m), (), profit).first()


def test_ties_smallest_label_and_zero_revenue_margins(spark):
    d = dt.datetime(2025, 1, 1)
    rows = [(d, "B", "x", 10.0, 1.0), (d, "A", "y", 10.0, 1.0), (d, "Z", "z", 0.0, -1.0)]
    f = _facts(spark, rows)
    assert f["top_region"] == "A" and f["top_product"] == "x"
    assert f["worst_region"] == "Z" and f["worst_region_margin"] == -math.inf


def test_single_month_single_region_constants(spark):
    d = dt.datetime(2025, 1, 1)
    f = _facts(spark, [(d, "N", "x", 10.0, 5.0), (d, "N", "y", 30.0, 5.0)])
    assert (f["growth_score"], f["consistency_score"], f["balance_score"]) == (75.0, 85.0, 50.0)
    assert f["growth_statement"].startswith("a single billing month")


def test_negative_first_month_flips_growth(spark):
    rows = [(dt.datetime(2025, 1, 1), "N", "x", -10.0, 0.0), (dt.datetime(2025, 2, 1), "S", "x", 10.0, 0.0)]
    f = _facts(spark, rows)
    assert round(f["pct_change"], 6) == -200.0 and f["growth_score"] == 0.0


def test_empty_kpi_default_row(spark):
    df = spark.createDataFrame([], "d timestamp, r string, p string, rev double, prof double")
    k = kpi_summary(df, M).collect()
    assert len(k) == 1
    k = k[0]
    assert (k["total_revenue"], k["top_region"], k["health_score"], k["health_status"]) == (0.0, "N/A", 0, "Vulnerable")


def test_others_clash(spark):
    d = dt.datetime(2025, 1, 1)
    names = ["Others"] + [f"R{i}" for i in range(9)]
    rows = [(d, n, "x", float(100 - i), 1.0) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "d timestamp, r string, p string, rev double, prof double")
    out = region_top_others(df, M, (), 8).orderBy("rank").collect()
    assert len(out) == 9 and out[0]["region"] == "Others" and out[0]["rank"] == 1
    assert out[-1]["rank"] == 9 and out[-1]["revenue"] == 92.0 + 91.0
    assert sum(r["revenue"] for r in out) == sum(r[3] for r in rows)


def test_labels_and_metric_text(spark):
    df = spark.createDataFrame([("a" * 19,), ("b" * 20,), ("c" * 21,), (None,), ("\tpad  ",)], "s string")
    got = [r[0] for r in df.select(S.truncate_label("s", 20)).collect()]
    assert got == ["a" * 19, "b" * 20, "c" * 17 + "...", "N/A", "pad"]
    nums = spark.createDataFrame([(1234567.0,), (999999.0,), (-1500.0,), (12.4,), (None,)], "x double")
    got = [r[0] for r in nums.select(S.format_metric("x")).collect()]
    assert got == ["$1.23M", "$1000.0K", "-$1.5K", "$12", "N/A"]


def test_markdown_section_rules(spark):
    md = "# Title\n## Executive Summary\nFirst **bold** line\n- item one\n## Executive Summary again\nmore\n## Risks\nno"
    df = spark.createDataFrame([(1, md), (2, ""), (3, "plain")], "id long, t string")
    out = {r["id"]: r["section"] for r in markdown_section(df, "t", "Executive Summary").collect()}
    assert out == {1: "First bold line\n\n• item one\n\nmore", 2: "", 3: ""}


def test_markdown_blocks_rules(spark):
    md = "## Head é\n# Major\n- **a** b\n3. c\n10. d\n### e\n\n**x"
    df = spark.createDataFrame([(1, md)], "id long, t string")
    out = [(r["kind"], r["text"]) for r in markdown_blocks(df, "id", "t").orderBy("line_no").collect()]
    assert out == [("heading", "Head"), ("major", "Major"), ("bullet", "<b>a</b> b"), ("bullet", "c"),
                   ("body", "10. d"), ("body", "### e"), ("body", "<b>x")]


def test_running_before_matches_a_plain_loop(spark):
    rows = [(c, t * (1 if c else 7), t * 3 + c, f"x{t}") for c in range(3) for t in range(0, 50 if c else 5000)] + [(None, 1, 5, "y")]
    df = spark.createDataFrame(rows, "k long, t long, v long, r string")
    got = {(r["k"], r["t"]): (r["n_before"], r["v_before"], r["previous_r"])
           for r in running_before(df, ["k"], ["t"], {"v": F.col("v")}, ["r"]).collect()}
    seen = {}
    for k, t, v, r in rows:
        n, total, last = seen.get(k, (0, 0, None))
        assert got[(k, t)] == (n, total, last)
        seen[k] = (n + 1, total + v, r)


def test_prompt_rows_with_gaps_between_turns(spark):
    df = spark.createDataFrame([(1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 7, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["n_messages"], r["history_chars"], r["previous_role"]) for r in prompt_messages(df).collect()}
    assert got == {1: (2, 0, None), 7: (4, 2, "assistant")}
    assert sorted((r["seq"], r["history_to"], r["question"]) for r in request_rows(df).collect()) == [(1, 0, "a"), (3, 2, "c")]


DATES = {
    "string": ["2017-10-02 10:56:33", "2017-11-03 00:00:00"], "us": ["01/13/2025", "02/06/2025"], "european": ["13/01/2025", "06/02/2025"],
    "month": ["Jan 2025", "Feb 2025"],
}


def test_default_dates_keep_rows(spark):
    for values in DATES.values():
        df = spark.createDataFrame([(v, "N", "A", 1.0) for v in values] + [("nonsense", "N", "A", 1.0), (None, "N", "A", 1.0)], "d string, r string, p string, rev double")
        m = M.with_overrides({"profit": None})
        assert clean_dataset(df, m).count() == len(values)
        assert cleaning_report(df, m).first().asDict() == {"n_rows": 4, "null_core": 1, "bad_date": 1, "bad_revenue": 0, "bad_profit": 0, "n_kept": 2}


def test_integer_dates(spark):
    df = spark.createDataFrame([(20250105, "N", "A", 1.0), (2024, "N", "A", 1.0), (20251340, "N", "A", 1.0), (5, "N", "A", 1.0)], "d int, r string, p string, rev double")
    got = [r["d"] for r in clean_dataset(df, M.with_overrides({"profit": None})).orderBy("d").collect()]
    assert got == [dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 5)]


def test_missing_revenue_column_gives_the_default_record(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1), "N", "x", 1.0)], "d timestamp, r string, p string, prof double")
    k = kpi_summary(df, M).first()
    assert (k["total_revenue"], k["top_region"], k["health_score"], k["health_status"]) == (0.0, "N/A", 0, "Vulnerable")


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([("2025-01-01", "N", "A", "5", None), ("2025-02-01", "S", "B", "7", "1")], "`Order.Date` string, r string, p string, `Sales.1` string, `x y` string")
    m = Mapping(date="Order.Date", region="r", product="p", revenue="Sales.1")
    assert data_confidence(df).first()["n_rows"] == 2
    cleaned = clean_dataset(df, m)
    assert cleaned.columns == df.columns and kpi_summary(cleaned, m).first()["total_revenue"] == 12.0
    assert profile_numeric(cleaned, ["Sales.1"]).first()["p50"] == 6.0 and preview(df, ["Order.Date"], 1).count() == 1


def test_others_of_double_money(spark):
    rows = [(dt.datetime(2025, 1, 1), f"R{i}", "x", 1e17 if i < 8 else 0.3, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "d timestamp, r string, p string, rev double, prof double")
    assert region_top_others(df, M, (), 8).where("rank = 9").first()["revenue"] == 0.6


def test_one_industry_for_each_entity(spark):
    d = dt.datetime(2025, 1, 1)
    rows = [("e1", d, "N", "x", 1.0, 1.0, i) for i in ("Retail", "Banking", "Retail")] + [("e2", d, "N", "x", 1.0, 1.0, i) for i in ("SaaS", "Retail")]
    rows += [("e3", d, "N", "x", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "e string, d timestamp, r string, p string, rev double, prof double, trade string")
    got = {r["e"]: r["industry"] for r in brief_facts(df, M, ["e"], industry="Telecommunications", industry_col="trade").collect()}
    assert got == {"e1": "Retail", "e2": "Retail", "e3": "Telecommunications"}
    assert [r["industry"] for r in brief_facts(df, M, [], industry_col="trade").collect()] == ["Retail"]


def test_profile_of_missing_values_and_ties(spark):
    df = spark.createDataFrame([(float(x), None, "a") for x in (1, 1, 2, 4)] + [(float("nan"), None, None)], "x double, y double, s string")
    r = profile_numeric(df, ["x", "y"]).orderBy("column").collect()
    assert (r[0]["count"], r[0]["p25"], r[0]["p50"], r[0]["p75"], r[0]["max"]) == (4, 1.0, 1.5, 2.5, 4.0)
    assert (r[1]["count"], r[1]["mean"], r[1]["p50"]) == (0, None, None)
    cells = {(c["column"], c["stat"]): c["value"] for c in profile_long(df, ["x", "y"], ["s"], []).collect()}
    assert len(cells) == 33 and cells["x", "top"] == "nan" and cells["s", "freq"] == "4" and cells["y", "std"] == "nan" and cells["x", "p50"] == "1.5000"


def test_long_profile_places_numbers_and_dates_at_once(spark, monkeypatch):
    import kpiloom.operators.profile as P

    calls = []
    monkeypatch.setattr(P, "running_before", lambda *a, **k: calls.append(1) or running_before(*a, **k))
    df = spark.sql("""SELECT * FROM VALUES ('a', 1.0D, 'x', TIMESTAMP '2024-01-01 00:00:00'), ('a', 3.0D, 'x', TIMESTAMP '2024-01-03 00:00:00'),
                      (NULL, double('infinity'), 'y', NULL) AS t(k, n, s, d)""")
    got = {(r["k"], r["column"], r["stat"]): r["value"] for r in profile_long(df, ["n"], ["s"], ["d"], by=["k"]).collect()}
    assert len(calls) == 1 and len(got) == 66
    assert got["a", "n", "p50"] == "2.0000" and got["a", "n", "std"] == "1.4142" and got["a", "s", "top"] == "x"
    assert got["a", "d", "p25"] == "2024-01-01 12:00:00" and got["a", "d", "mean"] == "2024-01-02 00:00:00" and got["a", "d", "std"] == "nan"
    assert got[None, "d", "count"] == "0" and got[None, "d", "max"] == "nan" and got[None, "n", "max"] == "Infinity"


def test_driver_and_catalog_detection_agree(spark):
    from pyspark.sql import types as T

    kinds = [T.StringType(), T.LongType(), T.DoubleType()]
    names = [["Net Sales", "Order Date", "State", "Item"], ["a", "b"], ["id", "year", "code", "x", "y"], [" Revenue ", "total", "Internet", "sku"],
             ["ts", "timestamp", "zone", "cat", "gain"], ["only"], ["city", "country", "price", "date_id", "profit"]]
    tables = {f"t{i}": spark.createDataFrame([], T.StructType([T.StructField(n, kinds[(i + k) % 3]) for k, n in enumerate(x)])) for i, x in enumerate(names)}
    rows = {r["table"]: r for r in detect_columns_catalog(catalog_of(spark, tables)).collect()}
    for t, df in tables.items():
        m = detect_columns(df)
        assert [rows[t][f"{r}_col"] for r in ("date", "region", "product", "revenue", "profit")] == [m.date, m.region, m.product, m.revenue, m.profit], t


def test_several_fact_rows_for_one_entity_fail(spark):
    q = spark.createDataFrame([(1, "show sales")], "id long, question string")
    two = spark.createDataFrame([(90,), (91,)], "confidence int")
    with pytest.raises(Exception, match="more than one fact row"):
        answer_confidence(q, two, ["id"]).collect()


def test_bold_over_a_carriage_return(spark):
    df = spark.createDataFrame([(1, "**a\rb** c")], "id long, t string")
    assert [r["text"] for r in markdown_blocks(df, "id", "t").collect()] == ["<b>a\rb</b> c"]
