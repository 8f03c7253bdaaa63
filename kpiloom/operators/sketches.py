"""D2 for big data: quantile sketches kept as a table for each part (day, month, partition of a source) and merged on demand.

A KLL sketch of ``size`` holds some multiple of ``size`` values, however many rows it has seen, and merging sketches gives the sketch of all their
rows; so quartiles of any span of parts need neither the rows nor a sort, and a new day costs one pass over that day.  Count,
mean, min and max are kept exactly beside them.  ``profile_numeric`` is the exact form.

Results are values of the column whose rank is off by at most ``rank_error(size)`` of the rows (twice the error that sketches of this
size keep to in 99 of 100 cases).  They differ from run to run within that error, as sketches draw at random.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import named
from .profile import QUANTILES

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which the rank of a returned value may be off."""
    return 2 * 2.296 / size ** 0.9021  # Fixed values: the published error of KLL sketches by their size.


def sketch_parts(df: DataFrame, cols: Sequence[str], part: Sequence[str | Column] = (), size: int = SIZE) -> DataFrame:
    """(part…, column, n, total, min, max, sketch): one row for each part and column; NULL and NaN are left out."""
    keys = [named(p) if isinstance(p, str) else p for p in part]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(named(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in cols])
    long = df.select(*keys, F.inline(cells))
    names = [c for c in long.columns if c not in ("column", "v")]
    v = F.col("v")
    return long.groupBy(*[named(c) for c in names], "column").agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged_parts(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parts added up over all keys but ``keep``: (keep…, column, n, total, min, max, sketch)."""
    return parts.groupBy(*[named(k) for k in keep], "column").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"))


def profile_sketched(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, count, mean, min, p25, p50, p75, max) from the parts; without rows the values are NULL."""
    m = merged_parts(parts, keep)
    some = F.col("n") > 0
    quartiles = [F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in QUANTILES.items()]
    return m.select(*[named(k) for k in keep], "column", F.col("n").alias("count"), F.when(some, F.col("total") / F.col("n")).alias("mean"), "min", *quartiles, "max")


def ranks_of(df: DataFrame, profile: DataFrame, cols: Sequence[str], size: int = SIZE) -> DataFrame:
    """(column, stat, value, below, up_to, count, within): the exact rank of each value of a profile (of the whole table), and whether it is within the stated error.

    One pass over the rows; the profile has a row for each column."""
    values = {r["column"]: r for r in profile.collect()}
    aggs, rows = [], []
    for i, c in enumerate(cols):
        v = F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))
        aggs.append(F.count(v).alias(f"n{i}"))
        for name in QUANTILES:
            value = F.lit(values[c][name]).cast("double")
            aggs += [F.count(F.when(v < value, 1)).alias(f"lt{i}_{name}"), F.count(F.when(v <= value, 1)).alias(f"le{i}_{name}")]
            rows.append((i, c, name, value))
    one = df.agg(*aggs)
    error = F.lit(rank_error(size))

    def line(i, c, name, value):
        n, below, up_to, q = F.col(f"n{i}"), F.col(f"lt{i}_{name}"), F.col(f"le{i}_{name}"), F.lit(QUANTILES[name])
        within = (below <= (q + error) * n) & (up_to >= (q - error) * n)
        return F.struct(F.lit(c).alias("column"), F.lit(name).alias("stat"), value.alias("value"), below.alias("below"), up_to.alias("up_to"), n.alias("count"), within.alias("within"))

    return one.select(F.inline(F.array(*[line(*r) for r in rows])))


def refreshed_parts(stored: DataFrame, *new: DataFrame) -> DataFrame:
    """Stored parts with the parts of new days beside them."""
    return reduce(DataFrame.unionByName, new, stored)
