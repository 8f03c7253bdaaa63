"""Registered queries: cube, KPIs, health, aggregations (A*, H*, K*, P1-P4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import kpis as K
from ..operators.cube import cube_report, fact_cube
from ..sources.tables import (FACT_MAPPING, FACT_MAPPING_NO_PROFIT, sales_fact)
from . import sql as Q
from .registry import query

BY = ["segment"]


def _fact(spark, d, profit=True):
    return sales_fact(spark, d, with_profit=profit)


def rounded(df, digits, *columns):
    """Sums of doubles differ in their last bits between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


SCORES = ("growth_score", "consistency_score", "balance_score", "margin_score")


def _facts(spark, d, by=BY, profit=True):
    m = FACT_MAPPING if profit else FACT_MAPPING_NO_PROFIT
    return K.kpi_facts(fact_cube(_fact(spark, d, profit), m, by), by, profit)


# --- A13 fact cube ----------------------------------------------------------
@query("fact_cube", Q.with_fact("""
SELECT segment, CASE WHEN GROUPING(nation) = 0 THEN 'region' WHEN GROUPING(product) = 0 THEN 'product'
                     WHEN GROUPING(m) = 0 THEN 'month' ELSE 'all' END AS level,
       COALESCE(CASE WHEN GROUPING(nation) = 0 THEN nation END, CASE WHEN GROUPING(product) = 0 THEN product END,
                CASE WHEN GROUPING(m) = 0 THEN m END) AS key,
       CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit, COUNT(*) AS n
FROM (SELECT *, strftime(order_date, '%Y-%m') AS m FROM f)
GROUP BY GROUPING SETS ((segment, nation), (segment, product), (segment, m), (segment))
"""))
def q_fact_cube(spark, d):
    return cube_report(fact_cube(_fact(spark, d), FACT_MAPPING, BY), BY)


# --- K1 KPI record ----------------------------------------------------------
@query("kpi_summary", Q.with_fact(f"SELECT {Q.KPI_COLS} FROM kf", extra_ctes=Q.kpi_facts_ctes([])))
def q_kpi_summary(spark, d):
    return rounded(K.kpi_summary(_fact(spark, d), FACT_MAPPING), 6, *SCORES)


@query("kpi_by_entity", Q.with_fact(f"SELECT segment, {Q.KPI_COLS} FROM kf",
                                    extra_ctes=Q.kpi_facts_ctes(BY)))
def q_kpi_by_entity(spark, d):
    return rounded(K.kpi_summary(_fact(spark, d), FACT_MAPPING, BY), 6, *SCORES)


@query("kpi_summary_noprofit", Q.with_fact(f"SELECT segment, {Q.KPI_COLS} FROM kf",
                                           extra_ctes=Q.kpi_facts_ctes(BY, profit=False)))
def q_kpi_noprofit(spark, d):
    return rounded(K.kpi_summary(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY), 6, *SCORES)


@query("kpi_summary_norevenue", """
SELECT DISTINCT c_mktsegment AS segment, CAST(0 AS BIGINT) AS n_rows, 0.0::DOUBLE AS total_revenue, 0.0::DOUBLE AS total_profit,
       0.0::DOUBLE AS profit_margin, 'N/A' AS top_region, 0.0::DOUBLE AS top_region_rev, 'N/A' AS top_product, 0.0::DOUBLE AS top_product_rev,
       NULL::DOUBLE AS growth_score, NULL::DOUBLE AS consistency_score, NULL::DOUBLE AS balance_score, NULL::DOUBLE AS margin_score,
       0 AS health_score, 'Vulnerable' AS health_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def q_kpi_norevenue(spark, d):
    """K1 over a table without the mapped revenue column: the default record."""
    return K.kpi_summary(_fact(spark, d).drop("revenue"), FACT_MAPPING, BY)


@query("health_components", Q.with_fact(
    "SELECT segment, growth_score, consistency_score, balance_score, margin_score, health_score, health_status "
    "FROM kf", extra_ctes=Q.kpi_facts_ctes(BY)))
def q_health_components(spark, d):
    return rounded(K.health_components(_fact(spark, d), FACT_MAPPING, BY), 6, *SCORES)


@query("health_score", Q.with_fact("SELECT health_score, health_status FROM kf",
                                   extra_ctes=Q.kpi_facts_ctes([])))
def q_health_score(spark, d):
    return K.kpi_summary(_fact(spark, d), FACT_MAPPING).select("health_score", "health_status")


# --- A1-A12 ------------------------------------------------------------------
@query("totals", Q.with_fact("""
SELECT segment, COUNT(*) AS n_rows, CAST(SUM(revenue) AS DOUBLE) AS total_revenue,
       CAST(SUM(profit) AS DOUBLE) AS total_profit FROM f GROUP BY segment"""))
def q_totals(spark, d):
    return K.totals(_fact(spark, d), FACT_MAPPING, BY)


def _perf_sql(key_expr, alias, profit=True):
    extra = (f", CAST(SUM(profit) AS DOUBLE) AS profit, {Q.group_margin('SUM(profit)', 'SUM(revenue)')} AS margin"
             if profit else "")
    return Q.with_fact(f"SELECT segment, {key_expr} AS {alias}, CAST(SUM(revenue) AS DOUBLE) AS revenue{extra} "
                       f"FROM f GROUP BY segment, {key_expr}")


@query("revenue_by_region", _perf_sql("nation", "region", profit=False))
def q_revenue_by_region(spark, d):
    return K.segment_performance(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, "region", BY)


@query("revenue_by_product", _perf_sql("product", "product", profit=False))
def q_revenue_by_product(spark, d):
    return K.segment_performance(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, "product", BY)


@query("profit_by_product", Q.with_fact(
    "SELECT segment, product, CAST(SUM(profit) AS DOUBLE) AS profit FROM f GROUP BY segment, product"))
def q_profit_by_product(spark, d):
    return (K.segment_performance(_fact(spark, d), FACT_MAPPING, "product", BY)
            .select("segment", "product", "profit"))


@query("region_performance", _perf_sql("nation", "region"))
def q_region_performance(spark, d):
    return K.segment_performance(_fact(spark, d), FACT_MAPPING, "region", BY)


@query("product_performance", _perf_sql("product", "product"))
def q_product_performance(spark, d):
    return K.segment_performance(_fact(spark, d), FACT_MAPPING, "product", BY)


@query("monthly_trend", _perf_sql("strftime(order_date, '%Y-%m')", "month", profit=False))
def q_monthly_trend(spark, d):
    return K.segment_performance(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, "month", BY)


@query("monthly_rev_profit", Q.with_fact("""
SELECT strftime(order_date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       CAST(SUM(profit) AS DOUBLE) AS profit FROM f GROUP BY 1"""))
def q_monthly_rev_profit(spark, d):
    return (K.segment_performance(_fact(spark, d), FACT_MAPPING, "month")
            .select("month", "revenue", "profit"))


@query("growth_rate", Q.with_fact("""
SELECT segment, COUNT(*) AS n_months, MIN(month) AS first_month, MAX(month) AS last_month,
       arg_min(revenue, month) AS first_rev, arg_max(revenue, month) AS last_rev,
       CASE WHEN arg_min(revenue, month) <> 0
            THEN (arg_max(revenue, month) - arg_min(revenue, month)) / arg_min(revenue, month) * 100.0
            ELSE 0.0 END AS pct_change
FROM (SELECT segment, strftime(order_date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
      FROM f GROUP BY 1, 2) GROUP BY segment"""))
def q_growth_rate(spark, d):
    return K.growth_rate(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY)


@query("top_region", Q.with_fact("SELECT segment, top_region, top_region_rev FROM kf",
                                 extra_ctes=Q.kpi_facts_ctes(BY)))
def q_top_region(spark, d):
    return _facts(spark, d).select("segment", "top_region", "top_region_rev")


@query("top_product", Q.with_fact("SELECT segment, top_product, top_product_rev FROM kf",
                                  extra_ctes=Q.kpi_facts_ctes(BY)))
def q_top_product(spark, d):
    return _facts(spark, d).select("segment", "top_product", "top_product_rev")


@query("worst_segments", Q.with_fact(
    "SELECT segment, worst_region, worst_region_margin, worst_product, worst_product_margin FROM kf",
    extra_ctes=Q.kpi_facts_ctes(BY)))
def q_worst_segments(spark, d):
    return _facts(spark, d).select("segment", "worst_region", "worst_region_margin",
                                   "worst_product", "worst_product_margin")


@query("top_product_margin", Q.with_fact("SELECT segment, top_product, top_product_margin FROM kf",
                                         extra_ctes=Q.kpi_facts_ctes(BY)))
def q_top_product_margin(spark, d):
    return _facts(spark, d).select("segment", "top_product", "top_product_margin")


@query("revenue_cv", Q.with_fact("""
SELECT segment, COUNT(*) AS n_months, ROUND(AVG(revenue), 4) AS mean_rev, ROUND(STDDEV_SAMP(revenue), 4) AS std_rev,
       ROUND(CASE WHEN AVG(revenue) > 0 THEN STDDEV_SAMP(revenue) / AVG(revenue) ELSE 1.0 END, 6) AS cv
FROM (SELECT segment, strftime(order_date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
      FROM f GROUP BY 1, 2) GROUP BY segment"""))
def q_revenue_cv(spark, d):
    return rounded(rounded(K.revenue_cv(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY), 4, "mean_rev", "std_rev"), 6, "cv")


@query("region_hhi", Q.with_fact("""
SELECT segment, COUNT(*) AS n_regions, ROUND(SUM((revenue / total) * (revenue / total)), 6) AS hhi
FROM (SELECT segment, nation, CAST(SUM(revenue) AS DOUBLE) AS revenue,
             SUM(CAST(SUM(revenue) AS DOUBLE)) OVER (PARTITION BY segment) AS total
      FROM f GROUP BY 1, 2) GROUP BY segment"""))
def q_region_hhi(spark, d):
    return rounded(K.region_hhi(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY), 6, "hhi")


@query("data_confidence", Q.with_fact("""
SELECT segment, COUNT(*) AS n_rows,
       CAST(CASE WHEN COUNT(*) = 0 THEN 50 ELSE LEAST(99, GREATEST(50, 80 + LEAST(10, FLOOR(COUNT(*) / 10))
         + FLOOR((1.0 - SUM((order_date IS NULL)::INT + (region IS NULL)::INT + (nation IS NULL)::INT
             + (product IS NULL)::INT + (brand IS NULL)::INT + (revenue IS NULL)::INT + (profit IS NULL)::INT)
             / (COUNT(*) * 7.0)) * 10))) END AS INTEGER) AS confidence
FROM f GROUP BY segment"""))
def q_data_confidence(spark, d):
    return K.data_confidence(_fact(spark, d), BY)


# --- P1-P4 -----------------------------------------------------------------
@query("month_bucket", Q.with_fact(
    "SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS n_rows FROM f GROUP BY 1"))
def q_month_bucket(spark, d):
    return (_fact(spark, d).select(S.month_bucket("order_date").alias("month"))
            .groupBy("month").agg(F.count(F.lit(1)).alias("n_rows")))


@query("group_margin", Q.with_fact(f"""
SELECT segment, product, {Q.group_margin('SUM(profit)', 'SUM(revenue)')} AS margin,
       {Q.group_margin('SUM(profit)', 'SUM(revenue)')} IS NULL AS margin_missing
FROM f GROUP BY segment, product"""))
def q_group_margin(spark, d):
    perf = K.segment_performance(_fact(spark, d), FACT_MAPPING, "product", BY)
    return perf.select("segment", "product", "margin", F.col("margin").isNull().alias("margin_missing"))


# Profits that give margins from far below zero to above 15 %, zero sales and nothing at all.
_MIXED = """(SELECT p_size AS size, r * (p_size % 3 > 0)::INT AS revenue, r * (p_size % 40 - 10) / 100 * (p_size % 5 > 0)::INT AS profit
 FROM (SELECT p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS r FROM part))"""


def _mixed(spark, d):
    from ..sources.tables import load_table
    r, size = F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_size")
    return load_table(spark, d, "part").select(size.alias("size"), (r * (size % 3 > 0).cast("int")).alias("revenue"),
                                               (r * (size % 40 - 10) / 100 * (size % 5 > 0).cast("int")).alias("profit"))


@query("margin_band_mixed", f"""
SELECT size, {Q.margin_band('m')} AS band, ROUND(m, 6) AS margin, m IS NULL AS margin_missing
FROM (SELECT size, {Q.group_margin('SUM(profit)', 'SUM(revenue)')} AS m FROM {_MIXED} GROUP BY size)""")
def q_margin_band_mixed(spark, d):
    """P3, P10 where margins are negative, small, large, infinite and missing."""
    from ..mapping import Mapping
    m = Mapping(date="none", region="size", product="none", revenue="revenue", profit="profit")
    perf = K.segment_performance(_mixed(spark, d), m, "region")
    return perf.select(F.col("region").cast("int").alias("size"), S.margin_band("margin").alias("band"),
                       F.round("margin", 6).alias("margin"), F.col("margin").isNull().alias("margin_missing"))


@query("revenue_share", Q.with_fact("""
SELECT segment, nation AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       CAST(SUM(revenue) AS DOUBLE) / CAST(ANY_VALUE(t.total) AS DOUBLE) * 100.0 AS share
FROM f JOIN (SELECT segment, SUM(revenue) AS total FROM f GROUP BY segment) t USING (segment)
GROUP BY segment, nation"""))
def q_revenue_share(spark, d):
    from ..operators.views import revenue_share
    return revenue_share(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, "region", BY)
