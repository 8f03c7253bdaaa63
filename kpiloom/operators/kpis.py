"""KPIs, health score and data confidence.

``kpi_facts`` turns the fact cube into one row per entity with a single
aggregation: every statistic (arg-max labels, worst margins, first/last
month, monthly mean and sample std, Herfindahl sums) is an ordinary
aggregate, so Spark combines it map-side and no entity is ever gathered as a
list.  Arg-max/arg-min use ``min_by`` over ``struct(value, label)`` so ties
go to the smallest label.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (NA, clamp, group_margin, growth_statement, health_class,
                                 round_even_int, total_margin)
from ..mapping import Mapping
from .cube import fact_cube, missing_cells, prepare

# ---------------------------------------------------------------------------
# Health-score parameters.
GROWTH_BASE, GROWTH_GAIN = 50.0, 2.5        # 50 + growth% * 2.5
MARGIN_BENCHMARK = 40.0                     # margin 40 % scores 100
SINGLE_MONTH_GROWTH = 75.0
SINGLE_MONTH_CONSISTENCY = 85.0
DEFAULT_BALANCE = 50.0
WEIGHTS_PROFIT = {"margin": 0.30, "growth": 0.25, "consistency": 0.25, "balance": 0.20}
WEIGHTS_NO_PROFIT = {"growth": 0.35, "consistency": 0.35, "balance": 0.30}
CONFIDENCE_BASE, CONFIDENCE_EMPTY = 80, 50
# ---------------------------------------------------------------------------

KPI_COLUMNS = ["n_rows", "total_revenue", "total_profit", "profit_margin", "top_region",
               "top_region_rev", "top_product", "top_product_rev", "growth_score",
               "consistency_score", "balance_score", "margin_score", "health_score",
               "health_status"]


def _lvl(name: str) -> Column:
    return (F.col("level") == name) & F.col("key").isNotNull()


def kpi_facts(cube: DataFrame, by: Sequence[str] = (), has_profit: bool = True, has_revenue: bool = True) -> DataFrame:
    """One row per entity with KPIs, score components and brief facts.

    No rows, or no revenue column (``has_revenue``): the default record, with 0 as its count of usable rows."""
    rev, prof, key = F.col("revenue"), F.col("profit"), F.col("key")
    rev_d = rev.cast("double")
    is_all, is_r, is_p, is_m = F.col("level") == "all", _lvl("region"), _lvl("product"), _lvl("month")
    margin = group_margin(prof, rev)

    def top(cond):  # arg-max revenue, ties → smallest label
        return F.when(cond, F.struct((-rev).alias("v"), key.alias("k")))

    def worst(cond):  # arg-min margin, NULL margins skipped
        return F.when(cond & margin.isNotNull(), F.struct(margin.alias("v"), key.alias("k")))

    aggs = [
        F.sum(F.when(is_all, F.col("n"))).alias("n_rows"),
        F.max(F.when(is_all, rev)).alias("_total"),
        F.max(F.when(is_all, prof)).alias("_total_profit"),
        F.count(F.when(is_r, 1)).alias("n_regions"),
        F.min_by(key, top(is_r)).alias("top_region"),
        F.max(F.when(is_r, rev)).alias("_top_region_rev"),
        F.min_by(key, top(is_p)).alias("top_product"),
        F.max(F.when(is_p, rev)).alias("_top_product_rev"),
        F.min_by(margin, top(is_p)).alias("top_product_margin"),
        F.min_by(key, worst(is_r)).alias("worst_region"),
        F.min(F.when(is_r, margin)).alias("worst_region_margin"),
        F.min_by(key, worst(is_p)).alias("worst_product"),
        F.min(F.when(is_p, margin)).alias("worst_product_margin"),
        F.count(F.when(is_m, 1)).alias("n_months"),
        F.min(F.when(is_m, key)).alias("first_month"),
        F.max(F.when(is_m, key)).alias("last_month"),
        F.min_by(rev, F.when(is_m, key)).alias("_first_rev"),
        F.max_by(rev, F.when(is_m, key)).alias("_last_rev"),
        F.avg(F.when(is_m, rev_d)).alias("_mean_m"),
        F.stddev_samp(F.when(is_m, rev_d)).alias("_std_m"),
        F.sum(F.when(is_r, rev_d * rev_d)).alias("_sumsq_r"),
    ]
    g = cube.groupBy(*by).agg(*aggs) if by else cube.agg(*aggs)

    c = F.col
    total = c("_total").cast("double")
    first, last = c("_first_rev").cast("double"), c("_last_rev").cast("double")
    growth = F.when(first != 0, (last - first) / first).otherwise(F.lit(0.0))
    pct_change = F.when(first != 0, (last - first) / first * 100.0).otherwise(F.lit(0.0))
    multi = c("n_months") > 1
    growth_score = F.when(multi, clamp(GROWTH_BASE + growth * 100.0 * GROWTH_GAIN)).otherwise(SINGLE_MONTH_GROWTH)
    cv = F.when(c("_mean_m") > 0, c("_std_m") / c("_mean_m")).otherwise(F.lit(1.0))
    consistency = F.when(multi, clamp(100.0 - cv * 100.0)).otherwise(SINGLE_MONTH_CONSISTENCY)
    hhi = c("_sumsq_r") / (total * total)
    n_reg = c("n_regions").cast("double")
    balance = (F.when((total > 0) & (c("n_regions") > 1),
                      clamp((1.0 - hhi) / (1.0 - 1.0 / n_reg) * 100.0))
               .otherwise(DEFAULT_BALANCE))
    if has_profit:
        pmargin = total_margin(c("_total_profit"), c("_total"))
        margin_score = clamp(pmargin / MARGIN_BENCHMARK * 100.0)
        w = WEIGHTS_PROFIT
        raw = (w["margin"] * margin_score + w["growth"] * growth_score
               + w["consistency"] * consistency + w["balance"] * balance)
        total_profit = c("_total_profit").cast("double")
    else:
        pmargin = F.lit(0.0)
        margin_score = F.lit(None).cast("double")
        w = WEIGHTS_NO_PROFIT
        raw = w["growth"] * growth_score + w["consistency"] * consistency + w["balance"] * balance
        total_profit = F.lit(0.0)
    empty = c("n_rows").isNull() | (c("n_rows") == 0) if has_revenue else F.lit(True)
    score = round_even_int(raw)

    def rnd(x):
        return F.when(~empty, x)

    out = g.select(
        *by,
        F.when(empty, 0).otherwise(c("n_rows")).cast("long").alias("n_rows"),
        F.when(empty, 0.0).otherwise(total).alias("total_revenue"),
        F.when(empty, 0.0).otherwise(total_profit).alias("total_profit"),
        F.when(empty, 0.0).otherwise(pmargin).alias("profit_margin"),
        F.when(empty, F.lit(NA)).otherwise(F.coalesce(c("top_region"), F.lit(NA))).alias("top_region"),
        F.when(empty, 0.0).otherwise(F.coalesce(c("_top_region_rev").cast("double"), F.lit(0.0))).alias("top_region_rev"),
        F.when(empty, F.lit(NA)).otherwise(F.coalesce(c("top_product"), F.lit(NA))).alias("top_product"),
        F.when(empty, 0.0).otherwise(F.coalesce(c("_top_product_rev").cast("double"), F.lit(0.0))).alias("top_product_rev"),
        rnd(growth_score).alias("growth_score"),
        rnd(consistency).alias("consistency_score"),
        rnd(balance).alias("balance_score"),
        rnd(margin_score).alias("margin_score"),
        F.when(empty, 0).otherwise(score).alias("health_score"),
        F.when(empty, "Vulnerable").otherwise(health_class(score)).alias("health_status"),
        # brief facts
        c("n_regions"), c("n_months"), c("first_month"), c("last_month"),
        F.when(empty, 0.0).otherwise(pct_change).alias("pct_change"),
        growth_statement(c("n_months"), pct_change, c("first_month"), c("last_month")).alias("growth_statement"),
        (F.coalesce(c("worst_region"), F.lit(NA)) if has_profit else F.lit(NA)).alias("worst_region"),
        (F.coalesce(c("worst_region_margin"), F.lit(0.0)) if has_profit else F.lit(0.0)).alias("worst_region_margin"),
        (F.coalesce(c("worst_product"), F.lit(NA)) if has_profit else F.lit(NA)).alias("worst_product"),
        (F.coalesce(c("worst_product_margin"), F.lit(0.0)) if has_profit else F.lit(0.0)).alias("worst_product_margin"),
        (F.when(c("top_product").isNull(), 0.0).otherwise(c("top_product_margin")) if has_profit
         else F.lit(0.0)).alias("top_product_margin"),
        F.lit(has_profit).alias("has_profit"),
    )
    return out


def kpi_summary(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """K1: the KPI record (+ score components), one row per entity."""
    return kpi_facts(fact_cube(df, m, by), by, m.has_profit(df), m.revenue in df.columns).select(*by, *KPI_COLUMNS)


def health_components(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """H1-H6: component scores, weighted score and class."""
    facts = kpi_facts(fact_cube(df, m, by), by, m.has_profit(df), m.revenue in df.columns)
    return facts.select(*by, "growth_score", "consistency_score", "balance_score",
                        "margin_score", "health_score", "health_status")


def data_confidence(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K2: 80 + min(10, rows div 10) + int(10 * completeness), clamped to [50, 99].

    Completeness counts NULL (and NaN) cells over all columns in one pass.
    """
    n_cols = len([f for f in df.schema.fields if f.name not in by])
    miss = missing_cells(df, by)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("n_missing")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.select(*by, F.col("n_rows").cast("long").alias("n_rows"),
                    confidence_expr(F.col("n_rows"), F.col("n_missing"), n_cols).alias("confidence"))


def confidence_expr(n_rows: Column, n_missing: Column, n_cols: int) -> Column:
    """K2 from row count, NULL-cell count and column count."""
    n = F.coalesce(n_rows, F.lit(0))
    cells = n * F.lit(n_cols)
    completeness = F.when(cells > 0, 1.0 - n_missing / cells).otherwise(1.0)
    row_adj = F.least(F.lit(10), F.floor(n / 10))
    comp_adj = F.floor(completeness * 10)
    conf = F.least(F.lit(99), F.greatest(F.lit(50), CONFIDENCE_BASE + row_adj + comp_adj))
    return F.when(n == 0, CONFIDENCE_EMPTY).otherwise(conf).cast("int")


def confidence_from_cube(cube: DataFrame, n_cols: int, by: Sequence[str] = ()) -> DataFrame:
    """K2 from a cube built with ``count_missing=True`` (no extra pass)."""
    a = cube.filter(F.col("level") == "all")
    aggs = [F.sum("n").alias("n_rows"), F.sum("n_missing").alias("n_missing")]
    g = a.groupBy(*by).agg(*aggs) if by else a.agg(*aggs)
    return g.select(*by, F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
                    confidence_expr(F.col("n_rows"), F.col("n_missing"), n_cols).alias("confidence"))


def region_facts_from_cube(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-region revenue, profit and margin from the cube (no extra pass)."""
    r = cube.filter((F.col("level") == "region") & F.col("key").isNotNull())
    return r.select(*by, F.col("key").alias("region"), F.col("revenue").cast("double").alias("revenue"),
                    F.col("profit").cast("double").alias("profit"),
                    group_margin("profit", "revenue").alias("margin"))


# --- single-statistic operators (each one aggregation over the rows) -------

def totals(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """A1: revenue and profit sums."""
    p = prepare(df, m, by)
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.sum("_revenue").cast("double").alias("total_revenue")]
    if "_profit" in p.columns:
        aggs.append(F.sum("_profit").cast("double").alias("total_profit"))
    return p.groupBy(*by).agg(*aggs) if by else p.agg(*aggs)


def segment_performance(df: DataFrame, m: Mapping, role: str, by: Sequence[str] = ()) -> DataFrame:
    """Revenue (+ profit, margin) per region / product / month; months in ascending order (T5)."""
    p = prepare(df, m, by)
    k = {"region": "_region", "product": "_product", "month": "_month"}[role]
    aggs = [F.sum("_revenue").alias("_rev")]
    if "_profit" in p.columns:
        aggs.append(F.sum("_profit").alias("_prof"))
    g = p.filter(F.col(k).isNotNull()).groupBy(*by, k).agg(*aggs)
    cols = [*by, F.col(k).alias(role), F.col("_rev").cast("double").alias("revenue")]
    if "_profit" in p.columns:
        cols += [F.col("_prof").cast("double").alias("profit"),
                 group_margin("_prof", "_rev").alias("margin")]
    out = g.select(*cols)
    return out.orderBy(*by, "month") if role == "month" else out


def growth_rate(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """first/last month revenue and % change (0 when the first is 0)."""
    mon = segment_performance(df, m.with_overrides({"profit": None}), "month", by)
    aggs = [F.count(F.lit(1)).alias("n_months"), F.min("month").alias("first_month"),
            F.max("month").alias("last_month"), F.min_by("revenue", "month").alias("first_rev"),
            F.max_by("revenue", "month").alias("last_rev")]
    g = mon.groupBy(*by).agg(*aggs) if by else mon.agg(*aggs)
    f, l_ = F.col("first_rev"), F.col("last_rev")
    return g.withColumn("pct_change", F.when(f != 0, (l_ - f) / f * 100.0).otherwise(F.lit(0.0)))


def revenue_cv(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Monthly mean, sample std and coefficient of variation."""
    mon = segment_performance(df, m.with_overrides({"profit": None}), "month", by)
    aggs = [F.count(F.lit(1)).alias("n_months"), F.avg("revenue").alias("mean_rev"),
            F.stddev_samp("revenue").alias("std_rev")]
    g = mon.groupBy(*by).agg(*aggs) if by else mon.agg(*aggs)
    cv = F.when(F.col("mean_rev") > 0, F.col("std_rev") / F.col("mean_rev")).otherwise(F.lit(1.0))
    return g.select(*by, "n_months", "mean_rev", "std_rev", cv.alias("cv"))


def region_hhi(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Herfindahl index over regions, sum of squared revenue shares.

    Σ(rev_i / T)² is computed as Σ rev_i² / T² so it stays one aggregation
    (no per-entity total has to be joined back to the region rows).
    """
    reg = segment_performance(df, m.with_overrides({"profit": None}), "region", by)
    aggs = [F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("revenue") * F.col("revenue")).alias("_sq"),
            F.sum("revenue").alias("_t")]
    g = reg.groupBy(*by).agg(*aggs) if by else reg.agg(*aggs)
    return g.select(*by, "n_regions", (F.col("_sq") / (F.col("_t") * F.col("_t"))).alias("hhi"))
