"""Registered queries: date columns whose format is induced from their shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.dates import date_report, induce_all, parse_induced
from ..sources.tables import load_table
from .registry import query

_T = "(o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400))"
#: Column: how Spark prints it, what DuckDB says is left of it, and its line in the report.
_FORMATS = {
    "iso": ("yyyy-MM-dd", "date_trunc('day', t)", "number", "-", "", "ymd", False),
    "us": ("MM/dd/yyyy", "date_trunc('day', t)", "number", "/", "", "mdy", False),
    "eu": ("dd/MM/yyyy", "date_trunc('day', t)", "number", "/", "", "dmy", False),
    "dots": ("dd.MM.yyyy HH:mm", "date_trunc('minute', t)", "number", ".", "H:M", "dmy", False),
    "full": ("MMMM d, yyyy", "date_trunc('day', t)", "month-name day year", None, "", "", False),
    "brief": ("d MMM yyyy", "date_trunc('day', t)", "day month-name year", None, "", "", False),
    "mail": ("EEE, dd MMM yyyy HH:mm:ss '+0230'", "date_trunc('second', t) - INTERVAL 150 MINUTE", "day month-name year", None, "H:M:S zone", "", False),
    "twelve": ("MM/dd/yyyy hh:mm a", "date_trunc('minute', t)", "number", "/", "H:M am", "mdy", False),
    "zulu": ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "date_trunc('second', t)", "number", "-", "H:M:S.F zone", "ymd", False),
    "digits": ("yyyyMMdd", "date_trunc('day', t)", "8 digits", None, "", "", False),
    "stamp": ("yyyyMMddHHmmss", "date_trunc('second', t)", "14 digits", None, "", "", False),
    "short": ("dd-MMM-yy", "date_trunc('day', t)", "day month-name year", None, "", "", False),
    "two": ("MM/dd/yy", "date_trunc('day', t)", "number", "/", "", "mdy", False),
    "month": ("MMM yyyy", "date_trunc('month', t)", "month-name year", None, "", "", False),
    "numbered": ("yyyy/MM", "date_trunc('month', t)", "year month", None, "", "", False),
    "open": ("MM/'07'/yyyy", "make_timestamp(year(t), month(t), 7, 0, 0, 0.0)", "number", "/", "", "mdy", True),
}


def printed(spark, d):
    """Order dates (with a time of day) as text in all formats."""
    o = load_table(spark, d, "orders").withColumn("t", F.expr(_T))
    return o.select("o_orderkey", *[F.date_format("t", f[0]).alias(c) for c, f in _FORMATS.items()])


@query("dates_by_shape", "SELECT o_orderkey, " + ", ".join(f'CAST({f[1]} AS TIMESTAMP) AS "{c}"' for c, f in _FORMATS.items())
       + " FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)")
def q_dates_by_shape(spark, d):
    """Sixteen text columns, each in a format of its own that is found from its values, as timestamps."""
    df = printed(spark, d)
    plans = induce_all(df, list(_FORMATS))
    return reduce(lambda x, c: parse_induced(x, c, plan=plans[c]), _FORMATS, df)


@query("date_shape_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{f[2]}' AS shape, {f"'{f[3]}'" if f[3] else 'CAST(NULL AS VARCHAR)'} AS separator, '{f[4]}' AS "time", COUNT(*) AS n,
 '{f[5]}' AS "order", {f[6]} AS ambiguous FROM orders""" for c, f in _FORMATS.items()))
def q_date_shape_report(spark, d):
    """What shapes the columns have, how their parts were ordered, and which column leaves that open."""
    return date_report(printed(spark, d), list(_FORMATS))
