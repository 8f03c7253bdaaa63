"""Ranked views and report tables.

Top-k per entity uses ``row_number() <= k`` over the aggregated groups; Spark
plans that filter as a WindowGroupLimit, so only k rows per entity survive
the sort.  Sums stay exact (DECIMAL) until the output, and the "Others" bucket
of T1 sums the groups that an anti-join with the top rows leaves, so no
entity's full key list has to be ranked in one place to get it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..mapping import Mapping
from .cube import prepare

ROLE_ALIAS = {"region": "_region", "product": "_product", "month": "_month"}
OTHERS = "Others"


def performance_exact(df: DataFrame, m: Mapping, role: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, key, _rev, _prof, _n)`` with exact sums (input type kept)."""
    p = prepare(df, m, by)
    k = ROLE_ALIAS[role]
    aggs = [F.sum("_revenue").alias("_rev"), F.count(F.lit(1)).alias("_n")]
    if "_profit" in p.columns:
        aggs.append(F.sum("_profit").alias("_prof"))
    out = p.filter(F.col(k).isNotNull()).groupBy(*by, F.col(k).alias("key")).agg(*aggs)
    if "_prof" not in out.columns:
        out = out.withColumn("_prof", F.lit(None).cast("double"))
    return out


def _entity_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-entity rows; with no entity keys the right side is one row
    (a proven size bound), so it is broadcast on a constant key."""
    if by:
        return left.join(right, list(by))
    return (left.withColumn("_one", F.lit(1))
            .join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def entity_totals(perf: DataFrame, by: Sequence[str]) -> DataFrame:
    aggs = [F.sum("_rev").alias("_total"), F.count(F.lit(1)).alias("_groups")]
    return perf.groupBy(*by).agg(*aggs) if by else perf.agg(*aggs)


def with_share(perf: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``_total`` (exact) and ``share`` = revenue / total * 100."""
    j = _entity_join(perf, entity_totals(perf, by), by)
    return j.withColumn("share", S.share("_rev", "_total"))


def ranked(perf: DataFrame, order: Sequence[Column], by: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order, F.col("key"))
    return perf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def region_top_others(df: DataFrame, m: Mapping, by: Sequence[str] = (), k: int = 8,
                      label_len: int = 20) -> DataFrame:
    """Top k regions by revenue plus one 'Others' row for the rest.

    The Others row exists only when there are more than k regions and sums
    the regions that are not among them.  A real region named 'Others' keeps
    its own row (rank tells them apart).
    """
    perf = performance_exact(df, m, "region", by)
    top = ranked(perf, [F.col("_rev").desc()], by, k)
    top_rows = top.select(*by, F.col("rank").cast("int").alias("rank"), F.col("key").alias("region"),
                          S.truncate_label("key", label_len).alias("label"),
                          F.col("_rev").cast("double").alias("revenue"))
    taken = top.select(*[F.col(b).alias(f"_t{i}") for i, b in enumerate(by)], F.col("key").alias("_tk"))
    same = perf["key"] == taken["_tk"]
    for i, b in enumerate(by):
        same = same & perf[b].eqNullSafe(taken[f"_t{i}"])
    rest = perf.join(taken, same, "left_anti").groupBy(*by).agg(F.sum("_rev").alias("_rest"), F.count(F.lit(1)).alias("_groups"))
    others = rest.filter(F.col("_groups") > 0).select(
        *by, F.lit(k + 1).cast("int").alias("rank"), F.lit(OTHERS).alias("region"), F.lit(OTHERS).alias("label"),
        F.col("_rest").cast("double").alias("revenue"))
    return top_rows.unionByName(others)


def top_n(df: DataFrame, m: Mapping, role: str, metric: str, n: int, by: Sequence[str] = (),
          label_len: int = 20) -> DataFrame:
    """Top n groups of a role by revenue or profit, with rank 1..n."""
    perf = performance_exact(df, m, role, by)
    col = "_prof" if metric == "profit" else "_rev"
    top = ranked(perf, [F.col(col).desc()], by, n)
    return top.select(*by, F.col("rank").cast("int").alias("rank"), F.col("key").alias(role),
                      S.truncate_label("key", label_len).alias("label"),
                      F.col(col).cast("double").alias(metric))


def region_report_table(df: DataFrame, m: Mapping, by: Sequence[str] = (), n: int = 15) -> DataFrame:
    """Top n regions by revenue with share of the full total and margin."""
    has_profit = m.has_profit(df)
    perf = with_share(performance_exact(df, m, "region", by), by)
    top = ranked(perf, [F.col("_rev").desc()], by, n)
    cols = [*by, F.col("rank").cast("int").alias("rank"), F.col("key").alias("region"),
            S.truncate_label("key", 20 if has_profit else 25).alias("label"),
            F.col("_rev").cast("double").alias("revenue"), F.col("share")]
    if has_profit:
        cols += [F.col("_prof").cast("double").alias("profit"), S.group_margin("_prof", "_rev").alias("margin")]
    return top.select(*cols)


def product_report_table(df: DataFrame, m: Mapping, by: Sequence[str] = (), n: int = 15) -> DataFrame:
    """T4: with profit, top n products by PROFIT with margin (no share);
    without profit, top n by revenue with share."""
    if m.has_profit(df):
        perf = performance_exact(df, m, "product", by)
        top = ranked(perf, [F.col("_prof").desc()], by, n)
        return top.select(*by, F.col("rank").cast("int").alias("rank"), F.col("key").alias("product"),
                          S.truncate_label("key", 20).alias("label"),
                          F.col("_rev").cast("double").alias("revenue"),
                          F.col("_prof").cast("double").alias("profit"),
                          S.group_margin("_prof", "_rev").alias("margin"))
    perf = with_share(performance_exact(df, m, "product", by), by)
    top = ranked(perf, [F.col("_rev").desc()], by, n)
    return top.select(*by, F.col("rank").cast("int").alias("rank"), F.col("key").alias("product"),
                      S.truncate_label("key", 25).alias("label"),
                      F.col("_rev").cast("double").alias("revenue"), F.col("share"))


def revenue_share(df: DataFrame, m: Mapping, role: str = "region", by: Sequence[str] = ()) -> DataFrame:
    """P4 as a table: revenue and share per group."""
    perf = with_share(performance_exact(df, m, role, by), by)
    return perf.select(*by, F.col("key").alias(role), F.col("_rev").cast("double").alias("revenue"), "share")


def rev_profit_long(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Monthly revenue and profit unpivoted to ``(month, metric, amount)``."""
    perf = performance_exact(df, m, "month", by)
    wide = perf.select(*by, F.col("key").alias("month"), F.col("_rev").cast("double").alias("revenue"),
                       F.col("_prof").cast("double").alias("profit"))
    return wide.unpivot([*by, "month"], ["revenue", "profit"], "metric", "amount")


# --- P16 KPI cards ------------------------------------------------------------
# Card titles in display order.
CARD_TITLES = ["Total Revenue", "Total Profit", "Profit Margin", "Health Score", "Top Region",
               "Top Category"]


def kpi_cards(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six display cards per entity ``(card_no, card, value, subtext)``."""
    c = F.col
    hp = c("has_profit")
    cards = [
        (S.format_metric("total_revenue"), F.lit("All periods combined")),
        (F.when(hp, S.format_metric("total_profit")).otherwise(S.NA), F.lit("Net earnings")),
        (F.when(hp, S.pct1("profit_margin")).otherwise(S.NA),
         F.concat(F.lit("Margin band: "), S.margin_band("profit_margin"))),
        (F.concat(c("health_score").cast("string"), F.lit("/100")), c("health_status")),
        (S.truncate_label("top_region", 15), F.concat(F.lit("Sales: "), S.format_metric("top_region_rev"))),
        (S.truncate_label("top_product", 15), F.concat(F.lit("Sales: "), S.format_metric("top_product_rev"))),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("card_no"), F.lit(t).alias("card"),
                             v.alias("value"), s.alias("subtext"))
                    for i, (t, (v, s)) in enumerate(zip(CARD_TITLES, cards))])
    return facts.select(*by, F.inline(arr))
