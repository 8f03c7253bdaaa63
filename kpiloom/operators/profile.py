"""Profiling (D1-D5): the describe(include='all') family as Spark aggregates.

One pass over the data counts the distinct values of all columns at once
(column, value, count), with map-side combining, so a hot value never gathers
its rows.  Everything else works on those counts.  Quantiles are exact: the counts are
ordered by range partitions (``ranks.running_before``), which gives every value
its place among all rows, and each quantile interpolates between the two values around its place.
No task holds all distinct values of a column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..session import write_and_read
from .ranks import running_before

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
STATS = ("count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max")
MISSING = "nan"


def shape(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row and column count."""
    n_cols = len([c for c in df.columns if c not in by])
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(*by, F.col("n_rows").cast("long").alias("n_rows"), F.lit(n_cols).cast("int").alias("n_cols"))


def value_counts(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence[str] = (),
                 by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, number, text, n): how often each value of each column occurs; n 0 stands for missing values.

    Numbers (NaN counts as missing) and dates (as microseconds) are in ``number``, categories in ``text``."""
    cells = []
    for kind, names in (("n", numeric), ("c", categorical), ("d", dates)):
        for c in names:
            v = named(c)
            number = v.cast("double") if kind == "n" else F.unix_micros(v.cast("timestamp")).cast("double") if kind == "d" else F.lit(None).cast("double")
            cells.append(F.struct(F.lit(c).alias("column"), F.nanvl(number, F.lit(None).cast("double")).alias("number"),
                                  (v.cast("string") if kind == "c" else F.lit(None).cast("string")).alias("text")))
    long = df.select(*by, F.inline(F.array(*cells)))
    known = F.col("number").isNotNull() | F.col("text").isNotNull()
    counts = long.groupBy(*by, "column", "number", "text").agg(F.count(F.when(known, 1)).alias("n"))
    return write_and_read(counts, "value-counts")


def _numbers(counts: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of the columns, from their value counts."""
    keys = [*by, "column"]
    some = counts.where(F.col("column").isin(list(names))).drop("text")
    total = some.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"),
                                    F.min("number").alias("min"), F.max("number").alias("max"))
    placed = running_before(some, keys, ["number"], {"rows": F.col("n")})
    joined = _same(placed.where("n > 0"), total, keys)
    off = F.col("number") - F.col("mean")
    aggs = [F.sum(F.col("n") * off * off).alias("squares")]
    for name, q in QUANTILES.items():
        place = (F.col("count") - 1) * F.lit(q)
        at = lambda k: F.max(F.when((F.col("rows_before") <= k) & (k < F.col("rows_before") + F.col("n")), F.col("number")))
        aggs += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi")]
    found = _same(total, joined.groupBy(*keys).agg(*aggs), keys, "left")
    quartiles = [_between(F.col(f"{n}_lo"), F.col(f"{n}_hi"), (F.col("count") - 1) * F.lit(q)).alias(n) for n, q in QUANTILES.items()]
    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return found.select(*keys, "count", "mean", std.alias("std"), "min", *quartiles, "max")


def _between(low: Column, high: Column, place: Column) -> Column:
    """Linear interpolation at ``place`` between the values at its whole neighbours."""
    mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    return F.when(F.ceil(place) == F.floor(place), low).otherwise(mixed)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null-safe; the keys come from the left."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(other[f"_r{i}"])
    return left.join(other, same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def _categories(counts: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    n = F.col("n")
    return counts.where(F.col("column").isin(list(names))).groupBy(*by, "column").agg(
        F.sum("n").alias("count"), F.count(F.when(n > 0, 1)).alias("unique"),
        F.min_by("text", F.when(n > 0, F.struct((-n).alias("m"), F.col("text").alias("v")))).alias("top"),
        F.max(F.when(n > 0, n)).alias("freq"))


def profile_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 % (linear interpolation), max per numeric column."""
    return _numbers(value_counts(df, numeric=cols, by=by), cols, by)


def profile_categorical(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """D3: count, unique, top (most frequent; ties → smallest), freq."""
    return _categories(value_counts(df, categorical=cols, by=by), cols, by)


def _ts_text(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(micros).cast("long")), "yyyy-MM-dd HH:mm:ss")


def _date_texts(numbers: DataFrame, by: Sequence[str]) -> DataFrame:
    return numbers.select(*by, "column", "count", *[_ts_text(F.col(c)).alias(c) for c in ("mean", "min", *QUANTILES, "max")])


def profile_dates(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, min, quartiles, max of timestamp columns (no std)."""
    return _date_texts(_numbers(value_counts(df, dates=cols, by=by), cols, by), by)


def profile_long(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], dates: Sequence[str],
                 by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Every statistic of every column as text rows ``(column, stat, value)``; 'nan' where one doesn't apply.

    Numbers are shown with ``digits`` decimals.  One pass over ``df`` serves all columns."""
    counts = value_counts(df, numeric, categorical, dates, by)
    plain = lambda c: F.col(c).cast("string")
    parts = []
    if numeric or dates:
        # numbers and dates are placed together, which shuffles and reads the counts once
        kinds = F.array(*[F.when(F.col("column").isin(list(names)), F.lit(kind)) for kind, names in (("n", numeric), ("d", dates))])
        placed = _numbers(counts, list(dict.fromkeys([*numeric, *dates])), by).withColumn("_kind", F.explode(F.array_compact(kinds)))
        of = lambda kind, c: F.when(F.col("_kind") == kind, F.col(c))
        number = lambda c: F.format_string(f"%.{digits}f", F.round(of("n", c), digits))
        either = lambda c: F.when(F.col("_kind") == "d", _ts_text(of("d", c))).otherwise(number(c))
        placed = placed.withColumn("std", of("n", "std"))
        parts.append((placed, {"count": plain, "std": number, **dict.fromkeys(("mean", "min", *QUANTILES, "max"), either)}))
    if categorical:
        parts.append((_categories(counts, categorical, by), dict.fromkeys(("count", "unique", "top", "freq"), plain)))
    out = None
    for table, shown in parts:
        cell = lambda s: F.when(F.col(s).isNotNull(), shown[s](s)) if s in shown else F.lit(None).cast("string")  # noqa: B023,E731
        rows = [F.struct(F.lit(s).alias("stat"), F.coalesce(cell(s), F.lit(MISSING)).alias("value")) for s in STATS]
        part = table.select(*by, "column", F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out
