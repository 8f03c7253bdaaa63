"""Date formats induced from the shapes of a column's values."""

import datetime as dt
from random import Random

import pyarrow as pa
from pyspark.sql import functions as F

from kpiloom.operators import dates
from kpiloom.operators.clean import clean_dataset
from kpiloom.operators.dates import date_report, induce, induce_all, parse_column, parse_induced
from kpiloom.mapping import Mapping

#: How to print a date, and what of it is lost.
FORMATS = {
    "iso": "%Y-%m-%d", "us": "%m/%d/%Y", "eu": "%d/%m/%Y", "dots": "%d.%m.%Y %H:%M", "long": "%B %d, %Y", "mid": "%d %b %Y", "rfc": "%a, %d %b %Y %H:%M:%S +0230",
    "twelve": "%m/%d/%Y %I:%M %p", "zulu": "%Y-%m-%dT%H:%M:%S.%fZ", "compact": "%Y%m%d", "stamp": "%Y%m%d%H%M%S", "short": "%d-%b-%y", "slash": "%Y/%m/%d %H:%M:%S",
    "two": "%m/%d/%y", "month": "%b %Y", "ym": "%Y-%m", "my": "%m/%Y", "year": "%Y", "ydm": "%Y-%d-%m", "ymname": "%Y-%b-%d"}


def test_each_format_is_read_whole(spark):
    rng = Random(3)
    days = [dt.datetime(rng.randint(1971, 2067), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999999))
            for _ in range(200)]
    df = spark.createDataFrame([(k, *[d.strftime(f) for f in FORMATS.values()]) for k, d in enumerate(days)], "k int, " + ", ".join(f"`{c}` string" for c in FORMATS))
    plans = {c: induce(df, c) for c in FORMATS}
    assert not any(x["ambiguous"] for plan in plans.values() for x in plan)
    got = df.select("k", *[parse_column(F.col(c), plans[c]).alias(c) for c in FORMATS]).collect()
    for r in got:
        for c, form in FORMATS.items():
            text = days[r["k"]].strftime(form)
            want = dt.datetime.strptime(text[:-6], "%a, %d %b %Y %H:%M:%S") - dt.timedelta(hours=2, minutes=30) if c == "rfc" else dt.datetime.strptime(text, form)
            assert r[c] == want.replace(tzinfo=None), (c, text)


def parsed(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, d string")
    return [r["d"] and r["d"].strftime("%Y-%m-%d") for r in parse_induced(df, "d").orderBy("k").collect()], induce(df, "d")


def test_order_is_settled_by_the_whole_column(spark):
    assert parsed(spark, ["01/02/2020", "13/02/2020"])[0] == ["2020-02-01", "2020-02-13"]
    assert parsed(spark, ["01/02/2020", "02/13/2020"])[0] == ["2020-01-02", "2020-02-13"]
    got, plan = parsed(spark, ["01/02/2020", "03/04/2020"])
    assert got == ["2020-01-02", "2020-03-04"] and plan[0]["ambiguous"]
    # a shape that is open borrows the order of the others
    assert parsed(spark, ["01.02.2020 10:00", "05.06.2020 11:00", "31.12.2020"])[0] == ["2020-02-01", "2020-06-05", "2020-12-31"]
    assert parsed(spark, ["1-2-20", "25-2-20"])[0] == ["2020-02-01", "2020-02-25"]


def test_mixed_columns_and_values_that_are_no_dates(spark):
    got, plan = parsed(spark, ["2020-02-30", "2020-02-29", None, "", "n/a", "March 3rd, 2021", "Sept. 4 2021", "12:30", "2021-13-45x", "1999", "25:00", "2021-01-01 25:00"])
    assert got == [None, "2020-02-29", None, None, None, "2021-03-03", "2021-09-04", None, None, "1999-01-01", None, None]
    assert sum(x["n"] for x in plan) == 11 and [x for x in plan if x["shape"] is None][0]["n"] == 5


def test_impossible_orders_parse_nothing(spark):
    got, plan = parsed(spark, ["13/14/2020", "40/50/2020"])
    assert got == [None, None] and plan[0]["order"] is None


def test_in_the_cleaning(spark):
    df = spark.createDataFrame([("3 Jan 2020", "N", "A", "1"), ("14 February 2020", "N", "A", "2"), ("soon", "N", "A", "3")], "d string, r string, p string, rev string")
    m = Mapping(date="d", region="r", product="p", revenue="rev")
    assert sorted(r["d"].day for r in clean_dataset(df, m, "shapes").collect()) == [3, 14]
    assert date_report(df, ["d"]).where("shape IS NULL").first()["n"] == 1


def test_columns_are_induced_together_and_values_matched_once(spark):
    df = spark.createDataFrame([("01/02/2020", "3 Jan 2020 10:00", "x\x01"), ("13/02/2020", None, "2020-01")], "a string, b string, c string")
    plans = induce_all(df, ["a", "b", "c"])
    assert plans == {c: induce(df, c) for c in "abc"} and [x["shape"] for x in plans["b"]] == ["day month-name year"]
    plan = df.select(parse_column(F.col("a"), plans["a"]).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("jan(?:uary)?") <= 5  # one pattern, which names the months in five shapes


def test_the_grammar_is_matched_against_outlines(spark, monkeypatch):
    """Many texts of a few outlines cost a few matches (finding F4 of round 4)."""
    days = [dt.date(2001, 1, 1) + dt.timedelta(k) for k in range(1000)]
    df = spark.createDataFrame([(k, d.strftime("%d.%m.%Y 10:20")) for k, d in enumerate(days)], "k int, d string")
    parsed = df.select("k", parse_column(F.col("d"), induce(df, "d")).alias("d"))
    assert "lambda" not in parsed._jdf.queryExecution().optimizedPlan().toString()  # nothing is interpreted value by value
    assert [r["d"].date() for r in parsed.orderBy("k").collect()] == days
    texts, known = pa.array([None, "x", *(d.strftime("%d.%m.%Y") for d in days), "", "y" * 100, "3 may 2020"])[1:], {}
    found = [(form.shape, len(rows)) for form, rows, _ in dates._forms(texts, known)]
    assert found == [("number", 1000), ("day month-name year", 1), (None, 3)] and len(known) == 4
    monkeypatch.setattr(dates, "OUTLINES", 1)
    known = {}
    assert [(form.shape, rows.tolist()) for form, rows, _ in dates._forms(texts[-3:], known)] == [("day month-name year", [2]), (None, [0, 1])] and len(known) == 1
