"""A13, K1 kept up to date by deltas: a stored cube plus the rows that came, went or changed.

The stored state is the finest level of the cube, one row for each (by, region, product, month) with sums and row counts.  A
change is the same sums with a sign: rows added count up, rows removed count down, a changed row does both.  State and change are
added up cell by cell; a cell whose row count reaches 0 is gone, and with it months and labels that have no rows left.  Only the
changed rows are read and cut into cells; the state, which grows with the cells and not with the rows, is joined by one aggregation.

The coarse levels follow from the cells as in ``fact_cube``, so all KPIs work on a refreshed cube as they do on a new one.  Sums of decimals are exact,
so a refreshed cube equals one made from scratch; with doubles the last bits may differ.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..mapping import Mapping
from .cube import prepare

CELL = ["_region", "_product", "_month"]


def _sums(p: DataFrame, by: Sequence[str], sign: Column) -> DataFrame:
    """Signed cells.  A sum over rows without any value stays NULL, so values are counted too."""
    values = ["_revenue"] + (["_profit"] if "_profit" in p.columns else [])
    aggs = [F.sum(sign).cast("long").alias("n")]
    for v in values:
        aggs += [F.sum(F.col(v) * sign.cast("decimal(1,0)" if "decimal" in dict(p.dtypes)[v] else "int")).alias(v),
                 F.sum(F.when(F.col(v).isNotNull(), sign).otherwise(0)).cast("long").alias(f"{v}_n")]
    return p.groupBy(*[named(b) for b in by], *CELL).agg(*aggs)


def cells(df: DataFrame, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """The state of a whole table: (by…, _region, _product, _month, n, _revenue, _revenue_n[, _profit, _profit_n])."""
    return _sums(prepare(df, m, by), by, F.lit(1))


def change(added: DataFrame | None, removed: DataFrame | None, m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Signed cells of rows that came and rows that went (a changed row is one of each)."""
    parts = [prepare(df, m, by).withColumn("_sign", F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _sums(both, by, F.col("_sign"))


def snapshot_change(old: DataFrame, new: DataFrame, key: Sequence[str], m: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Signed cells between two snapshots of a table whose rows ``key`` names: by one join on the key, rows that did not change count for nothing."""
    cols = [c for c in dict.fromkeys([*by, m.date, m.region, m.product, m.revenue, m.profit]) if c and c in new.columns]
    state = lambda df, name: df.select(*[named(k) for k in key], F.struct(*[named(c) for c in cols]).alias(name))
    both = state(old, "_old").join(state(new, "_new"), list(key), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    rows = lambda name: both.where(F.col(name).isNotNull()).select(f"{name}.*")
    return change(rows("_new"), rows("_old"), m, by)


def refreshed(state: DataFrame, *changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state after the changes.  A cell that would lose more rows than it has fails: the change belongs to another state."""
    both = state
    for c in changes:
        both = both.unionByName(c)
    sums = [c for c in state.columns if c not in (*by, *CELL)]
    merged = both.groupBy(*[named(b) for b in by], *CELL).agg(*[F.sum(c).alias(c) for c in sums])
    n = F.when(F.col("n") < 0, F.raise_error(F.lit("a change removes rows that the cube does not have"))).otherwise(F.col("n"))
    values = [c for c in sums if f"{c}_n" in sums]
    kinds = dict(state.dtypes)
    out = [F.when(F.col(f"{v}_n") > 0, F.col(v)).cast(kinds[v]).alias(v) for v in values]
    kept = merged.withColumn("n", n).where("n <> 0")
    return kept.select(*[named(b) for b in by], *CELL, "n", *[x for v, o in zip(values, out) for x in (o, F.col(f"{v}_n"))])


def cube_of(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``fact_cube`` from a state: (by…, level, key, revenue, profit, n)."""
    keys = [named(b) for b in by]
    has_profit = "_profit" in state.columns
    sets = [keys + [F.col(c)] for c in CELL] + [keys]
    aggs = [F.sum("_revenue").alias("revenue"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.grouping_id().alias("_gid")]
    aggs += [F.sum("_profit").alias("profit")] if has_profit else []
    g = state.groupingSets(sets, *keys, *[F.col(c) for c in CELL]).agg(*aggs)
    gid = {3: ("region", "_region"), 5: ("product", "_product"), 6: ("month", "_month")}
    level, key = F.lit("all"), F.lit(None).cast("string")
    for k, (name, column) in gid.items():
        level, key = F.when(F.col("_gid") == k, name).otherwise(level), F.when(F.col("_gid") == k, F.col(column)).otherwise(key)
    profit = F.col("profit") if has_profit else F.lit(None).cast("double").alias("profit")
    return g.select(*keys, level.alias("level"), key.alias("key"), "revenue", profit, "n")
