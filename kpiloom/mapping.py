"""Column roles: which columns hold date, region, product, revenue, profit.

Two forms:

* ``detect_columns(df_or_schema)`` works on a schema on the driver (metadata
  only, no Spark job) and returns a :class:`Mapping`.
* ``detect_columns_catalog(catalog_df)`` runs the same rules as a Spark job over
  a catalog of many tables ``(table, ordinal, column, dtype)`` and returns one
  row per table.

Rules: per role, first an exact pass (lower-cased, stripped name equals a
keyword), then a substring pass (a keyword occurs in the lower-cased name);
the first hit in COLUMN order wins.  Revenue, date, region and product then
fall back (numeric non-id column / name hints / position); profit has no
fallback.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Mapping as TMapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Role keywords and fallback hints (must equal the behaviour we
# reproduce; order matters only inside a pass by column order, not keyword
# order).
ROLE_KEYWORDS = {
    "revenue": ["revenue", "sales", "grand total", "turnover", "payment_value",
                "price", "amount", "total"],
    "profit": ["profit", "margin", "net income", "earnings", "gain", "net"],
    "date": ["purchase_timestamp", "order_date", "date", "month", "year",
             "timestamp", "time", "period"],
    "region": ["customer_state", "region", "country", "state", "city",
               "territory", "location", "zone"],
    "product": ["product_category_name", "product", "category", "item", "sku",
                "segment", "type"],
}
REVENUE_EXCLUDE = ["id", "date", "year", "code"]
DATE_HINTS = ["date", "time", "timestamp", "day", "year"]
REGION_HINTS = ["state", "country", "city", "region", "location"]
PRODUCT_HINTS = ["cat", "prod", "name", "item", "sku"]
# 1-based column position used when nothing else matched, with the minimum
# column count it needs (otherwise the first column).
POSITION_FALLBACK = {"revenue": 4, "region": 2, "product": 3, "date": 1}
# ---------------------------------------------------------------------------

ROLES = ("revenue", "profit", "date", "region", "product")
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Mapping:
    """Role → column name.  ``profit`` is optional."""

    date: str
    region: str
    product: str
    revenue: str
    profit: str | None = None

    def core(self) -> list[str]:
        return [self.date, self.region, self.product, self.revenue]

    def has_profit(self, df: DataFrame) -> bool:
        return bool(self.profit) and self.profit in df.columns

    def with_overrides(self, overrides: TMapping[str, str | None] | None) -> "Mapping":
        return replace(self, **dict(overrides or {}))


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def _rank(role: str, name: str, numeric: bool, ordinal: int, count: int) -> int | None:
    """How a column comes to a role: 1 exact keyword, 2 keyword inside, 3 fallback by type or hint, 4 by position."""
    low = name.lower()
    hints = {"date": DATE_HINTS, "region": REGION_HINTS, "product": PRODUCT_HINTS}.get(role, [])
    place = POSITION_FALLBACK.get(role)
    tests = {
        1: low.strip() in ROLE_KEYWORDS[role],
        2: any(k in low for k in ROLE_KEYWORDS[role]),
        3: any(h in low for h in hints) or (role == "revenue" and numeric and not any(x in low for x in REVENUE_EXCLUDE)),
        4: place is not None and ordinal == (place if count >= place else 1),
    }
    return min((k for k, hit in tests.items() if hit), default=None)


def detect_columns(df_or_schema, overrides: TMapping[str, str | None] | None = None) -> Mapping:
    """Driver-side role detection on a schema (no data is read): for each role the column of the lowest (rank, place)."""
    fields = (df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema).fields
    found = {}
    for role in ROLES:
        ranked = [(_rank(role, f.name, _is_numeric(f.dataType), k, len(fields)), k, f.name) for k, f in enumerate(fields, 1)]
        found[role] = min((x for x in ranked if x[0] is not None), default=(None, None, None))[2]
    return Mapping(**found).with_overrides(overrides)


def catalog_of(spark: SparkSession, tables: TMapping[str, DataFrame]) -> DataFrame:
    """``(table, ordinal, column, is_numeric)`` rows from the tables' schemas."""
    rows = [(t, i + 1, f.name, _is_numeric(f.dataType))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    schema = "table string, ordinal int, column string, is_numeric boolean"
    return spark.createDataFrame(rows, schema)


def _any_in(name: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(name, k))


def _strip(c: Column) -> Column:
    from .functions.scalars import py_strip
    return py_strip(c)


def detect_columns_catalog(catalog: DataFrame,
                           overrides: TMapping[str, TMapping[str, str]] | None = None) -> DataFrame:
    """Role detection for many tables at once; one row per table.

    ``catalog``: ``(table, ordinal, column, is_numeric)``.  ``overrides``:
    ``{table: {role: column}}`` applied after detection (user choice wins).
    """
    name = F.col("column")
    low = F.lower(name)
    ncols = F.max("ordinal").over(Window.partitionBy("table"))
    c = catalog.withColumn("_n", ncols)

    def rank_expr(role: str) -> Column:
        keys = ROLE_KEYWORDS[role]
        exact = F.array_contains(F.array(*[F.lit(k) for k in keys]), _strip(low))
        e = F.when(exact, 1).when(_any_in(low, keys), 2)
        if role == "revenue":
            e = e.when(F.col("is_numeric") & ~_any_in(low, REVENUE_EXCLUDE), 3)
        hints = {"date": DATE_HINTS, "region": REGION_HINTS, "product": PRODUCT_HINTS}.get(role)
        if hints:
            e = e.when(_any_in(low, hints), 3)
        pos = POSITION_FALLBACK.get(role)
        if pos:
            e = e.when(F.col("ordinal") == F.when(F.col("_n") >= pos, pos).otherwise(1), 4)
        return e

    # A struct holding a NULL field is itself non-NULL, so columns without a
    # hit get a NULL ordering key (min_by skips those rows).
    aggs = [F.min_by("column", F.when(rank_expr(r).isNotNull(),
                                      F.struct(rank_expr(r).alias("p"), F.col("ordinal"))))
             .alias(f"{r}_col") for r in ROLES]
    out = c.groupBy("table").agg(*aggs)
    for table, roles in (overrides or {}).items():
        for role, col in roles.items():
            out = out.withColumn(f"{role}_col", F.when(F.col("table") == table, F.lit(col))
                                 .otherwise(F.col(f"{role}_col")))
    return out
