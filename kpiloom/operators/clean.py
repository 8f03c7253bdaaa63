"""Cleaning (C1-C6): one chained projection + filter, no shuffle.

* C1 rows with NULL in a mapped core column (date, region, product, revenue)
  are dropped; profit is not core.  No core column at all → empty result.
* C3 dates are parsed with one format, a list of formats (first hit wins) or, by
  default, ``'auto'``: the candidate with the most parses over the whole column,
  ties by list order; ``'shapes'`` reads each value by its shape (``dates.py``).  Values that don't parse drop their row.  Integer date
  columns: 4 digits are a year, 8 digits ``yyyyMMdd``; any other integer doesn't parse.
* C4/C5 text money keeps only digits, '.' and '-', then ``try_cast`` to
  double; numeric columns are kept (NaN counts as missing).  A NULL after
  that drops the row, for revenue and, when mapped, profit.

``cleaning_report`` counts the rows that each of these rules drops.  The
text-or-number decision is per COLUMN (its type), not per row.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import named
from ..mapping import Mapping
from .dates import induce, parse_column

# ---------------------------------------------------------------------------
# Candidate date formats for 'auto', in preference order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy",
                "dd/MM/yyyy", "MMM yyyy", "yyyy-MM", "yyyyMMdd"]
MONEY_JUNK = r"[^0-9.\-]"
# ---------------------------------------------------------------------------


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def parse_dates(c, formats: Sequence[str]) -> Column:
    """Text → timestamp_ntz; first format that parses wins."""
    cc = named(c) if isinstance(c, str) else c
    return F.coalesce(*[_try_format(cc, f) for f in formats]).cast("timestamp_ntz")


#: What the parts of a format can match at most.
_WIDEST = {"yyyy": r"[+-]?[0-9]{4,}", "MMM": r"\D+", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}


def _outline(fmt: str) -> str | None:
    """A pattern that every text in the format matches; None where the format has other parts than ``_WIDEST``."""
    out = ""
    for m in re.finditer(r"'([^']+)'|([A-Za-z])\2*|.", fmt):
        part = m[0]
        if m[1]:
            out += re.escape(m[1])
        elif part.isalpha():
            if part not in _WIDEST:
                return None
            out += _WIDEST[part]
        elif part in "-/:. ,":
            out += re.escape(part)
        else:
            return None
    return rf"(?i)\A{out}\z"


def _try_format(text: Column, fmt: str) -> Column:
    """``try_to_timestamp``, asked only about texts that may have the format: a failing parse costs an exception."""
    outline = _outline(fmt)
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    return F.when(text.rlike(outline), parsed) if outline else parsed


def choose_date_format(df: DataFrame, column: str, candidates: Sequence[str] = DATE_FORMATS) -> str:
    """One aggregation counting parses per candidate; the most hits wins."""
    text = named(column).cast("string")
    aggs = [F.count(_try_format(text, f)).alias(f"c{i}")
            for i, f in enumerate(candidates)]
    row = df.agg(*aggs).first()
    counts = [row[f"c{i}"] for i in range(len(candidates))]
    best = max(range(len(candidates)), key=lambda i: (counts[i], -i))
    return candidates[best]


def integer_dates(c: Column) -> Column:
    """Integers as dates: 1000..9999 → January 1st of the year, 8 digits → yyyyMMdd, else NULL."""
    year = F.when(c.between(1000, 9999), F.make_timestamp_ntz(c.cast("int"), *[F.lit(x) for x in (1, 1, 0, 0, 0)]))
    day = F.when(c.between(10_000_000, 99_999_999), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    return F.coalesce(year, day)


def to_timestamp_col(df: DataFrame, column: str, date_format="auto") -> Column:
    dtype = _type(df, column)
    c = named(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        return integer_dates(c)
    if date_format == "shapes":
        return parse_column(c, induce(df, column))
    if date_format in (None, "auto"):
        date_format = choose_date_format(df, column)
    return parse_dates(c.cast("string"), [date_format] if isinstance(date_format, str) else list(date_format))


def strip_currency(c) -> Column:
    """C4: keep digits, '.', '-' only ('$1,200.50' → '1200.50', '(500)' → '500')."""
    cc = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(cc, MONEY_JUNK, "")


def to_amount_col(df: DataFrame, column: str) -> Column:
    """Text → strip → try_cast double; numbers kept (NaN → NULL)."""
    dtype = _type(df, column)
    c = named(column)
    if isinstance(dtype, T.StringType):
        text = strip_currency(c)
        return F.when(text != "", text).try_cast("double")  # a failing cast costs an exception
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.DecimalType):
        return c
    return c.cast("double")


def core_columns(df: DataFrame, m: Mapping) -> list[str]:
    return [c for c in dict.fromkeys(m.core()) if c and c in df.columns]


def complete(df: DataFrame, core: Sequence[str]) -> Column:
    """Whether a row has a value in all of the columns (NaN is none)."""
    out = F.lit(True)
    for c in core:
        out = out & named(c).isNotNull()
        if isinstance(_type(df, c), (T.DoubleType, T.FloatType)):
            out = out & ~F.isnan(named(c))
    return out


def drop_null_core(df: DataFrame, m: Mapping) -> DataFrame:
    """C1 (+ C2): drop rows with a NULL core value; no core column → empty."""
    core = core_columns(df, m)
    return df.where(complete(df, core)) if core else df.limit(0)


def _parsed(df: DataFrame, m: Mapping, date_format) -> dict[str, Column]:
    """The date, revenue and profit columns that exist, by name, as their parsed values."""
    out = {m.date: to_timestamp_col(df, m.date, date_format)} if m.date in df.columns else {}
    for a in dict.fromkeys([m.revenue, m.profit]):
        if a and a in df.columns:
            out[a] = to_amount_col(df, a)
    return out


def clean_dataset(df: DataFrame, m: Mapping, date_format="auto") -> DataFrame:
    """C1 → C3 → C5 as one projection + filter; columns keep their names."""
    core = core_columns(df, m)
    if not core:
        return df.limit(0)
    parsed = _parsed(df, m, date_format)
    fields = [(parsed[c] if c in parsed else named(c)).alias(c) for c in df.columns]
    # The parsed row is emitted through inline(filter(array(row))): each value
    # is parsed once, and there is no Filter for the optimizer to push below
    # the parse (which would evaluate every parse twice per row).
    needed = list(dict.fromkeys([*core, *parsed]))

    def valid(row):
        cond = F.lit(True)
        for c in needed:
            cond = cond & row.getField(c).isNotNull()
        return cond

    return df.where(complete(df, core)).select(F.inline(F.filter(F.array(F.struct(*fields)), valid)))


REASONS = ("null_core", "bad_date", "bad_revenue", "bad_profit")


def cleaning_report(df: DataFrame, m: Mapping, date_format="auto") -> DataFrame:
    """One row: n_rows, the rows dropped for each reason (the first that applies), n_kept."""
    core = core_columns(df, m)
    if not core:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.lit(1)).alias("null_core"),
                      *[F.lit(0).cast("long").alias(r) for r in REASONS[1:]], F.lit(0).cast("long").alias("n_kept"))
    parsed = _parsed(df, m, date_format)
    missing = lambda name: parsed[name].isNull() if name in parsed else F.lit(False)
    reason = (F.when(~complete(df, core), REASONS[0]).when(missing(m.date), REASONS[1])
              .when(missing(m.revenue), REASONS[2]).when(missing(m.profit), REASONS[3]))
    why = df.select(reason.alias("why"))
    return why.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col("why") == r, 1)).alias(r) for r in REASONS],
                   F.count(F.when(F.col("why").isNull(), 1)).alias("n_kept"))


def preview(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*[named(c) for c in order]).limit(n)


def raw_preview(raw: DataFrame, cleaned: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` raw rows if cleaning left nothing, else none."""
    return preview(raw, order, n if cleaned.isEmpty() else 0)
