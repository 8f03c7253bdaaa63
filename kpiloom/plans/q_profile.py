"""Registered queries: profiling (D1-D5) over the sales fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.heavy import profile_texts
from ..operators.sketches import profile_sketched, ranks_of, sketch_parts
from ..session import write_and_read
from ..sources.tables import load_table, sales_fact
from . import sql as Q
from .registry import query

NUMERIC = ["revenue", "profit"]
CATEGORICAL = ["region", "nation", "product", "brand", "segment"]
DATES = ["order_date"]


@query("shape", Q.with_fact("SELECT COUNT(*) AS n_rows, CAST(8 AS INTEGER) AS n_cols FROM f"))
def q_shape(spark, d):
    return P.shape(sales_fact(spark, d))


def _num_sql():
    parts = []
    for c in NUMERIC:
        parts.append(f"""SELECT '{c}' AS "column", COUNT(v) AS count, ROUND(AVG(v), 4) AS mean,
  ROUND(STDDEV_SAMP(v), 4) AS std, ROUND(MIN(v), 4) AS min, ROUND(quantile_cont(v, 0.25), 4) AS p25,
  ROUND(quantile_cont(v, 0.5), 4) AS p50, ROUND(quantile_cont(v, 0.75), 4) AS p75, ROUND(MAX(v), 4) AS max
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM f WHERE {c} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


def _cat_sql():
    parts = []
    for c in CATEGORICAL:
        parts.append(f"""SELECT '{c}' AS "column", SUM(cnt) AS count, COUNT(*) AS "unique",
  arg_min(value, (-cnt, value)) AS top, MAX(cnt) AS freq
FROM (SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS cnt FROM f WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(f'SELECT "column", CAST(count AS BIGINT) AS count, CAST("unique" AS BIGINT) AS "unique", '
                              f"top, CAST(freq AS BIGINT) AS freq FROM ({p})" for p in parts)


def _ts(x):
    return f"strftime(make_timestamp(CAST(floor({x}) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


def _date_sql():
    parts = []
    for c in DATES:
        parts.append(f"""SELECT '{c}' AS "column", COUNT(us) AS count, {_ts('AVG(us)')} AS mean, {_ts('MIN(us)')} AS min,
  {_ts('quantile_cont(CAST(us AS DOUBLE), 0.25)')} AS p25, {_ts('quantile_cont(CAST(us AS DOUBLE), 0.5)')} AS p50,
  {_ts('quantile_cont(CAST(us AS DOUBLE), 0.75)')} AS p75, {_ts('MAX(us)')} AS max
FROM (SELECT epoch_us({c}) AS us FROM f WHERE {c} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("profile_numeric", Q.with_fact(_num_sql()))
def q_profile_numeric(spark, d):
    p = P.profile_numeric(sales_fact(spark, d), NUMERIC)
    return p.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query("profile_categorical", Q.with_fact(_cat_sql()))
def q_profile_categorical(spark, d):
    return P.profile_categorical(sales_fact(spark, d), CATEGORICAL)


@query("profile_dates", Q.with_fact(_date_sql()))
def q_profile_dates(spark, d):
    return P.profile_dates(sales_fact(spark, d), DATES)


def _txt(x):
    return f"format('{{:.4f}}', ROUND({x}, 4))"


def _long_sql(source, shown):
    cells = ", ".join(f"{{'stat': '{st}', 'value': COALESCE({shown.get(st, 'NULL')}, 'nan')}}" for st in
                      ("count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"))
    return f'SELECT "column", UNNEST([{cells}], recursive := true) FROM ({source})'


_quart = ("mean", "min", "p25", "p50", "p75", "max")
_LONG = " UNION ALL ".join([
    _long_sql(_num_sql(), {"count": "CAST(count AS VARCHAR)", "std": _txt("std"), **{c: _txt(c) for c in _quart}}),
    _long_sql(_cat_sql(), {"count": "CAST(count AS VARCHAR)", "unique": 'CAST("unique" AS VARCHAR)', "top": "top", "freq": "CAST(freq AS VARCHAR)"}),
    _long_sql(_date_sql(), {"count": "CAST(count AS VARCHAR)", **{c: c for c in _quart}})])


@query("profile_long", Q.with_fact(_LONG))
def q_profile_long(spark, d):
    return P.profile_long(sales_fact(spark, d), NUMERIC, CATEGORICAL, DATES)


TEXTS = ["text", "lang", "source"]


@query("profile_texts", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(SUM(cnt) AS BIGINT) AS count, COUNT(*) AS "unique", arg_min(value, (-cnt, value)) AS top, MAX(cnt) AS freq
FROM (SELECT {c} AS value, COUNT(*) AS cnt FROM documents WHERE {c} IS NOT NULL GROUP BY 1)""" for c in TEXTS))
def q_profile_texts(spark, d):
    """D3 over whole texts, which don't move: summaries, candidates, and hashes."""
    return profile_texts(load_table(spark, d, "documents"), TEXTS)


@query("profile_sketched", Q.with_fact(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", UNNEST(['p25', 'p50', 'p75']) AS stat, n AS count, true AS within, lo AS min, hi AS max, mean FROM (
  SELECT COUNT({c}) AS n, CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi, ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS mean FROM f)""" for c in NUMERIC)))
def q_profile_sketched(spark, d):
    """D2 from sketches of each month, merged: whether the exact ranks of the quartiles are within the stated error."""
    fact = sales_fact(spark, d)
    parts = write_and_read(sketch_parts(fact, NUMERIC, [F.date_format("order_date", "yyyy-MM").alias("month")]), "sketches")
    profile = write_and_read(profile_sketched(parts), "sketched-profile")
    ranks = ranks_of(fact, profile, NUMERIC)
    exact = profile.select(F.col("column").alias("_c"), "min", "max", F.round("mean", 4).alias("mean"))
    return ranks.join(exact, F.col("column") == F.col("_c")).select("column", "stat", "count", "within", "min", "max", "mean")
