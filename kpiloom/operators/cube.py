"""One-pass fact cube feeding every KPI.

``fact_cube`` first sums the rows by (by, region, product, month), then groups
those cells by four grouping sets at once (by+region, by+product, by+month,
by).  Both steps aggregate before they shuffle, so a hot entity or a hot region
costs CPU, not shuffle volume, and the fourfold expansion of the grouping sets
meets cells instead of rows.  Where nearly every row is a cell of its own,
``fine=False`` skips the first step.

Roles are selected under private aliases (``_region`` …) so one column may
fill two roles (for example revenue and profit) without ambiguity.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_bucket, named
from ..mapping import Mapping

LEVELS = ("region", "product", "month", "all")


def prepare(df: DataFrame, m: Mapping, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Project entity keys and role columns under fixed aliases.

    A role column missing from ``df`` becomes a NULL column, which the KPI
    step treats as "role absent" (its defaults).
    """
    def role(name, alias, cast=None):
        if name and name in df.columns:
            c = named(name)
            return (c.cast(cast) if cast else c).alias(alias)
        return F.lit(None).cast(cast or "string").alias(alias)

    cols = [named(b) for b in by]
    cols += [role(m.date, "_date"), role(m.region, "_region", "string"),
             role(m.product, "_product", "string"), role(m.revenue, "_revenue")]
    if m.has_profit(df):
        cols.append(role(m.profit, "_profit"))
    cols += [named(c) for c in carry]
    out = df.select(*cols)
    return out.withColumn("_month", month_bucket("_date") if m.date in df.columns
                          else F.lit(None).cast("string"))


def missing_cells(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """Number of NULL (or NaN) cells in a row, over all columns but ``exclude``."""
    out = F.lit(0)
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        c = named(f.name)
        miss = c.isNull()
        if f.dataType.simpleString() in ("double", "float"):
            miss = miss | F.isnan(c)
        out = out + F.when(miss, 1).otherwise(0)
    return out


def fact_cube(df: DataFrame, m: Mapping, by: Sequence[str] = (), count_missing: bool = False,
              fine: bool = True) -> DataFrame:
    """Rows ``(by…, level, key, revenue, profit, n[, n_missing])``.

    ``level`` is region / product / month / all; ``key`` the group label
    (NULL for ``all``).  Money keeps the input type (DECIMAL sums are exact).
    ``count_missing`` adds the NULL-cell count (for K2) in the same pass.
    """
    p = prepare(df.withColumn("_miss", missing_cells(df, by)) if count_missing else df, m, by,
                carry=["_miss"] if count_missing else [])
    has_profit = "_profit" in p.columns
    keys = [named(b) for b in by]
    p = p.withColumn("_n", F.lit(1).cast("long"))
    sums = ["_revenue", "_n"] + (["_profit"] if has_profit else []) + (["_miss"] if count_missing else [])
    if fine:
        p = p.groupBy(*keys, "_region", "_product", "_month").agg(*[F.sum(c).alias(c) for c in sums])
    sets = [keys + [F.col("_region")], keys + [F.col("_product")], keys + [F.col("_month")], keys]
    aggs = [F.sum("_revenue").alias("revenue"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
            F.grouping_id().alias("_gid")]
    if count_missing:
        aggs.append(F.sum("_miss").alias("n_missing"))
    if has_profit:
        aggs.insert(1, F.sum("_profit").alias("profit"))
    g = p.groupingSets(sets, *keys, F.col("_region"), F.col("_product"), F.col("_month")).agg(*aggs)
    # grouping_id bits (region, product, month) → 3 / 5 / 6 / 7
    level = (F.when(F.col("_gid") == 3, "region").when(F.col("_gid") == 5, "product")
             .when(F.col("_gid") == 6, "month").otherwise("all"))
    key = (F.when(F.col("_gid") == 3, F.col("_region")).when(F.col("_gid") == 5, F.col("_product"))
           .when(F.col("_gid") == 6, F.col("_month")))
    out = [*keys, level.alias("level"), key.alias("key"), F.col("revenue")]
    out.append(F.col("profit") if has_profit else F.lit(None).cast("double").alias("profit"))
    out.append(F.col("n"))
    if count_missing:
        out.append(F.col("n_missing"))
    return g.select(*out)


def cube_report(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cube with money as double (the reported form)."""
    return cube.select(*by, "level", "key", F.col("revenue").cast("double").alias("revenue"),
                       F.col("profit").cast("double").alias("profit"), "n")
