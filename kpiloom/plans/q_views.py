"""Registered queries: ranked views, report tables, scalar formatting (T*, P5-P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact as E
from ..functions import scalars as S
from ..operators import views as V
from ..operators.kpis import kpi_facts
from ..operators.cube import fact_cube
from ..sources.tables import (FACT_MAPPING, FACT_MAPPING_BRAND, FACT_MAPPING_NO_PROFIT, load_table,
                              sales_fact)
from . import sql as Q
from .registry import query

BY = ["segment"]


def _fact(spark, d, profit=True):
    return sales_fact(spark, d, with_profit=profit)


# The ranked tables for the whole dataset: key, order, rows, label length, columns.
_REV, _PROF, _SHARE, _MARGIN = ("CAST(rev AS DOUBLE) AS revenue", "CAST(prof AS DOUBLE) AS profit",
                                "CAST(rev AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS share", f"{Q.group_margin('prof', 'rev')} AS margin")
WHOLE = {
    "top10_products_by_profit_all": ("brand", "prof", 10, 20, "product", [_PROF], lambda f, m: V.top_n(f, FACT_MAPPING_BRAND, "product", "profit", 10)),
    "region_report_table_all": ("nation", "rev", 15, 20, "region", [_REV, _SHARE, _PROF, _MARGIN], lambda f, m: V.region_report_table(f, m)),
    "product_report_table_all": ("brand", "prof", 15, 20, "product", [_REV, _PROF, _MARGIN], lambda f, m: V.product_report_table(f, FACT_MAPPING_BRAND)),
}


def _register_whole(name, key, order, n, size, role, columns, run):
    @query(name, Q.with_fact(f"""
SELECT CAST(rn AS INTEGER) AS rank, k AS {role}, {Q.truncate_label('k', size)} AS label, {', '.join(columns)}
FROM (SELECT *, SUM(rev) OVER () AS total, ROW_NUMBER() OVER (ORDER BY {order} DESC, k) AS rn
      FROM (SELECT {key} AS k, SUM(revenue) AS rev, SUM(profit) AS prof FROM f GROUP BY 1)) WHERE rn <= {n}"""))
    def whole(spark, d):
        return run(_fact(spark, d), FACT_MAPPING)


for _name, _spec in WHOLE.items():
    _register_whole(_name, *_spec)


def _ranked_sql(key, order, n, select, source="f", extra_group=""):
    return f"""
SELECT {select} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY {order}, k) AS rn FROM (
    SELECT segment, {key} AS k, SUM(revenue) AS rev, SUM(profit) AS prof FROM {source} GROUP BY segment, {key}) g
) WHERE rn <= {n}"""


@query("region_top8_others", Q.with_fact(f"""
SELECT segment, CAST(bucket AS INTEGER) AS rank, region,
       CASE WHEN bucket <= 8 THEN {Q.truncate_label('region', 20)} ELSE 'Others' END AS label,
       CAST(SUM(rev) AS DOUBLE) AS revenue
FROM (SELECT segment, rev, CASE WHEN rn <= 8 THEN rn ELSE 9 END AS bucket,
             CASE WHEN rn <= 8 THEN k ELSE 'Others' END AS region
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rev DESC, k) AS rn
            FROM (SELECT segment, nation AS k, SUM(revenue) AS rev FROM f GROUP BY segment, nation)))
GROUP BY segment, bucket, region"""))
def q_region_top8_others(spark, d):
    return V.region_top_others(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY, k=8)


# Money as doubles where the largest dwarf the rest: Others must come from the rest alone.
_STEEP = ("CASE WHEN CAST(substr(nation, 8) AS INT) < 8 THEN CAST(l_extendedprice AS DOUBLE) * 1e12 ELSE 0.25 * (l_linenumber % 4) END")


@query("region_top8_others_double", f"""
WITH f AS (SELECT n_name AS nation, l_extendedprice, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT nation AS k, SUM({_STEEP}) AS rev FROM f GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rev DESC, k) AS rn FROM g)
SELECT CAST(rn AS INTEGER) AS rank, k AS region, {Q.truncate_label('k', 20)} AS label, ROUND(rev / 1e12, 3) AS revenue FROM r WHERE rn <= 8
UNION ALL SELECT 9, 'Others', 'Others', ROUND(SUM(rev), 3) FROM r WHERE rn > 8""")
def q_region_top8_double(spark, d):
    """T1 for the whole dataset on double money."""
    t = lambda n: load_table(spark, d, n)
    rows = (t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "nation"))
    m = FACT_MAPPING_NO_PROFIT.with_overrides({"revenue": "steep"})
    out = V.region_top_others(rows.withColumn("steep", F.expr(_STEEP)), m, [], 8)
    return out.withColumn("revenue", F.round(F.when(F.col("rank") <= 8, F.col("revenue") / 1e12).otherwise(F.col("revenue")), 3))


@query("top10_products_by_profit", Q.with_fact(_ranked_sql(
    "brand", "prof DESC", 10,
    f"segment, CAST(rn AS INTEGER) AS rank, k AS brand, {Q.truncate_label('k', 20)} AS label, "
    "CAST(prof AS DOUBLE) AS profit")))
def q_top10_products(spark, d):
    return V.top_n(_fact(spark, d), FACT_MAPPING_BRAND, "product", "profit", 10, BY).withColumnRenamed(
        "product", "brand")


_share = "CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER (PARTITION BY segment) AS DOUBLE) * 100.0"


@query("region_report_table", Q.with_fact(f"""
SELECT segment, CAST(rn AS INTEGER) AS rank, k AS region, {Q.truncate_label('k', 20)} AS label,
       CAST(rev AS DOUBLE) AS revenue, share, CAST(prof AS DOUBLE) AS profit,
       {Q.group_margin('prof', 'rev')} AS margin
FROM (SELECT *, {_share} AS share, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rev DESC, k) AS rn
      FROM (SELECT segment, nation AS k, SUM(revenue) AS rev, SUM(profit) AS prof FROM f GROUP BY 1, 2))
WHERE rn <= 15"""))
def q_region_report_table(spark, d):
    return V.region_report_table(_fact(spark, d), FACT_MAPPING, BY)


@query("region_report_table_noprofit", Q.with_fact(f"""
SELECT segment, CAST(rn AS INTEGER) AS rank, k AS region, {Q.truncate_label('k', 25)} AS label,
       CAST(rev AS DOUBLE) AS revenue, share
FROM (SELECT *, {_share} AS share, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rev DESC, k) AS rn
      FROM (SELECT segment, nation AS k, SUM(revenue) AS rev FROM f GROUP BY 1, 2))
WHERE rn <= 15"""))
def q_region_report_table_np(spark, d):
    return V.region_report_table(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY)


@query("product_report_table", Q.with_fact(f"""
SELECT segment, CAST(rn AS INTEGER) AS rank, k AS product, {Q.truncate_label('k', 20)} AS label,
       CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit, {Q.group_margin('prof', 'rev')} AS margin
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY prof DESC, k) AS rn
      FROM (SELECT segment, brand AS k, SUM(revenue) AS rev, SUM(profit) AS prof FROM f GROUP BY 1, 2))
WHERE rn <= 15"""))
def q_product_report_table(spark, d):
    return V.product_report_table(_fact(spark, d), FACT_MAPPING_BRAND, BY)


@query("product_report_table_noprofit", Q.with_fact(f"""
SELECT segment, CAST(rn AS INTEGER) AS rank, k AS product, {Q.truncate_label('k', 25)} AS label,
       CAST(rev AS DOUBLE) AS revenue, share
FROM (SELECT *, {_share} AS share, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rev DESC, k) AS rn
      FROM (SELECT segment, brand AS k, SUM(revenue) AS rev FROM f GROUP BY 1, 2))
WHERE rn <= 15"""))
def q_product_report_table_np(spark, d):
    m = FACT_MAPPING_BRAND.with_overrides({"profit": None})
    return V.product_report_table(_fact(spark, d, False), m, BY)


@query("rev_profit_long", Q.with_fact("""
SELECT month, 'revenue' AS metric, CAST(SUM(revenue) AS DOUBLE) AS amount FROM
  (SELECT strftime(order_date, '%Y-%m') AS month, revenue FROM f) GROUP BY month
UNION ALL
SELECT month, 'profit' AS metric, CAST(SUM(profit) AS DOUBLE) AS amount FROM
  (SELECT strftime(order_date, '%Y-%m') AS month, profit FROM f) GROUP BY month"""))
def q_rev_profit_long(spark, d):
    return V.rev_profit_long(_fact(spark, d), FACT_MAPPING)


# --- P5-P16 scalar functions over real columns --------------------------------
@query("truncate_label", f"""
SELECT p_partkey, {Q.truncate_label('p_name', 15)} AS label15, {Q.truncate_label('p_name', 20)} AS label20,
       {Q.truncate_label('p_name', 25)} AS label25 FROM part""")
def q_truncate_label(spark, d):
    p = load_table(spark, d, "part")
    return p.select("p_partkey", *[S.truncate_label("p_name", n).alias(f"label{n}") for n in (15, 20, 25)])


@query("format_metric", f"""
SELECT o_orderkey, {Q.format_metric('o_totalprice')} AS total_short,
       {Q.format_metric('-o_totalprice / 1000')} AS neg_short, {Q.format_metric('o_totalprice / 100000')} AS small_short,
       {Q.money('o_totalprice')} AS total_long FROM orders""")
def q_format_metric(spark, d):
    o = load_table(spark, d, "orders")
    return o.select("o_orderkey", S.format_metric("o_totalprice").alias("total_short"),
                    S.format_metric(-F.col("o_totalprice") / 1000).alias("neg_short"),
                    S.format_metric(F.col("o_totalprice") / 100000).alias("small_short"),
                    S.money("o_totalprice").alias("total_long"))


_pct_sql = """(SELECT segment, first_rev, last_rev,
   CASE WHEN first_rev <> 0 THEN (last_rev - first_rev) / first_rev * 100.0 ELSE 0.0 END AS pct_change,
   n_months, first_month, last_month
 FROM (SELECT segment, COUNT(*) AS n_months, MIN(month) AS first_month, MAX(month) AS last_month,
              arg_min(revenue, month) AS first_rev, arg_max(revenue, month) AS last_rev
       FROM (SELECT segment, strftime(order_date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
             FROM f GROUP BY 1, 2) GROUP BY segment))"""


def _growth(spark, d):
    from ..operators.kpis import growth_rate
    return growth_rate(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY)


@query("trend_class", Q.with_fact(
    f"SELECT segment, {Q.trend_class('pct_change')} AS trend, {Q.fmt('pct_change', 1, sign=True)} AS change_text "
    f"FROM {_pct_sql}"))
def q_trend_class(spark, d):
    g = _growth(spark, d)
    return g.select("segment", S.trend_class("pct_change").alias("trend"),
                    S.fmt_fixed("pct_change", 1, sign=True).alias("change_text"))


@query("trend_class_balances", f"""
SELECT c_custkey, {Q.trend_class('c_acctbal / 500')} AS trend FROM customer""")
def q_trend_class_balances(spark, d):
    """P8 where all three classes occur."""
    return load_table(spark, d, "customer").select("c_custkey", S.trend_class(F.col("c_acctbal") / 500).alias("trend"))


@query("growth_statement", Q.with_fact(
    f"SELECT segment, {Q.growth_statement('n_months', 'pct_change', 'first_month', 'last_month')} AS statement "
    f"FROM {_pct_sql}"))
def q_growth_statement(spark, d):
    g = _growth(spark, d)
    return g.select("segment", S.growth_statement("n_months", "pct_change", "first_month", "last_month")
                    .alias("statement"))


@query("margin_band", Q.with_fact(f"""
SELECT segment, nation AS region, {Q.margin_band(Q.group_margin('SUM(profit)', 'SUM(revenue)'))} AS band
FROM f GROUP BY segment, nation"""))
def q_margin_band(spark, d):
    from ..operators.kpis import segment_performance
    perf = segment_performance(_fact(spark, d), FACT_MAPPING, "region", BY)
    return perf.select("segment", "region", S.margin_band("margin").alias("band"))


@query("strip_non_ascii", r"""
SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') AS ascii_text FROM documents""")
def q_strip_non_ascii(spark, d):
    docs = load_table(spark, d, "documents")
    return docs.select("doc_id", S.strip_non_ascii("text").alias("ascii_text"))


def _cards_sql(hp):
    na = "'N/A'"
    cards = [("Total Revenue", Q.format_metric("total_revenue"), "'All periods combined'"),
             ("Total Profit", Q.format_metric("total_profit") if hp else na, "'Net earnings'"),
             ("Profit Margin", Q.pct1("profit_margin") if hp else na, f"'Margin band: ' || {Q.margin_band('profit_margin')}"),
             ("Health Score", "CAST(health_score AS VARCHAR) || '/100'", "health_status"),
             ("Top Region", Q.truncate_label("top_region", 15), f"'Sales: ' || {Q.format_metric('top_region_rev')}"),
             ("Top Category", Q.truncate_label("top_product", 15), f"'Sales: ' || {Q.format_metric('top_product_rev')}")]
    rows = ", ".join(f"{{'card_no': {k}, 'card': '{c}', 'value': {v}, 'subtext': {t}}}" for k, (c, v, t) in enumerate(cards, 1))
    return Q.with_fact(f"SELECT segment, card_no, card, value, subtext FROM (SELECT segment, UNNEST([{rows}], recursive := true) FROM kf)",
                       extra_ctes=Q.kpi_facts_ctes(BY, hp))


@query("kpi_cards", _cards_sql(True))
def q_kpi_cards(spark, d):
    facts = kpi_facts(fact_cube(_fact(spark, d), FACT_MAPPING, BY), BY, True)
    return V.kpi_cards(facts, BY)


@query("kpi_cards_noprofit", _cards_sql(False))
def q_kpi_cards_np(spark, d):
    facts = kpi_facts(fact_cube(_fact(spark, d, False), FACT_MAPPING_NO_PROFIT, BY), BY, False)
    return V.kpi_cards(facts, BY)


# --- P6, P7 on the binary value ---------------------------------------------------
_SHORT = """CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs({x}) >= 1000000 THEN format('{{:.2f}}', abs({x}) / 1000000.0::DOUBLE) || 'M'
 WHEN abs({x}) >= 1000 THEN format('{{:.1f}}', abs({x}) / 1000.0::DOUBLE) || 'K' ELSE format('{{:,.0f}}', abs({x})) END"""
_EXACT = {"price": "o_totalprice", "loss": "-o_totalprice * 37.5", "eighth": "CAST(o_orderkey AS DOUBLE) / 8.0", "cents": "o_totalprice / 1000.0"}


@query("format_metric_exact", "SELECT o_orderkey, " + ", ".join(
    f"""{_SHORT.format(x=c)} AS {c}_short, '$' || format('{{:,.2f}}', {c}) AS {c}_money, format('{{:+.1f}}', {c}) || '%' AS {c}_percent, format('{{:.1f}}', {c}) AS {c}_text"""
    for c in _EXACT) + " FROM (SELECT o_orderkey, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _EXACT.items()) + " FROM orders)")
def q_format_metric_exact(spark, d):
    """Numbers as text from their binary value, ties to even: eighths end in a tie at every second place."""
    o = load_table(spark, d, "orders").select("o_orderkey", *[F.expr(x).cast("double").alias(c) for c, x in _EXACT.items()])
    return o.select("o_orderkey", *[e for c in _EXACT for e in (
        E.format_metric_exact(c).alias(f"{c}_short"), E.money_exact(c).alias(f"{c}_money"), E.percent_exact(c, True).alias(f"{c}_percent"),
        E.fixed_exact(c, 1).alias(f"{c}_text"))])
