"""Column functions (all JVM-side built-ins, no Python UDF).

Number text follows one contract: values are rounded HALF_UP to the shown
precision first, then printed (``round`` + ``format_string``), so the text
does not depend on how an engine prints binary ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# Characters Python's str.strip() removes (str.isspace), as one regex class
# usable by Java and RE2 regex engines alike.
PY_SPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
HEALTH_CLASSES = [(80, "Robust"), (60, "Stable")]   # else "Vulnerable"
MARGIN_BANDS = [(15, "positive"), (5, "neutral")]   # else "negative"
TREND_LIMIT = 5.0                                   # % change for up/down
NA = "N/A"
# ---------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace like Python's ``str.strip()``."""
    return F.regexp_replace(col(c), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def py_strip_fast(name: str) -> Column:
    """``py_strip`` for a plain column: the regex runs only when the first or
    last character is whitespace (most lines need no stripping)."""
    c = F.col(name)
    one = f"^{PY_SPACE}$"
    needs = F.substring(c, 1, 1).rlike(one) | F.substring(c, -1, 1).rlike(one)
    return F.when(needs, py_strip(c)).otherwise(c)


def month_bucket(ts) -> Column:
    """``YYYY-MM`` text of a timestamp (sorts correctly as text)."""
    return F.date_format(col(ts), "yyyy-MM")


def dbl(c) -> Column:
    return col(c).cast("double")


def total_margin(profit, revenue) -> Column:
    """Profit / revenue * 100, 0.0 when revenue is 0."""
    p, r = dbl(profit), dbl(revenue)
    return F.when(r != 0, p / r * 100.0).otherwise(F.lit(0.0))


def group_margin(profit, revenue) -> Column:
    """Per-group margin %: x/0 gives +-infinity, 0/0 gives NULL."""
    p, r = dbl(profit), dbl(revenue)
    return (F.when(r != 0, p / r * 100.0)
            .when(p < 0, F.lit(float("-inf")))
            .when(p > 0, F.lit(float("inf"))))


def share(part, total) -> Column:
    """Part / total * 100; NULL when the total is 0."""
    p, t = dbl(part), dbl(total)
    return F.when(t != 0, p / t * 100.0)


def truncate_label(c, max_len: int = 20) -> Column:
    """P5: NULL → 'N/A'; strip; longer than n → first n-3 chars + '...'."""
    s = py_strip(col(c).cast("string"))
    short = F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len - 3), F.lit("...")))
    return F.when(col(c).isNull(), F.lit(NA)).otherwise(short.otherwise(s))


def _is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def fmt_fixed(x, digits: int, thousands: bool = False, sign: bool = False) -> Column:
    """``%.Nf`` text after HALF_UP rounding to N digits (inf/nan as Python prints them)."""
    spec = "%" + ("+" if sign else "") + ("," if thousands else "") + f".{digits}f"
    v = dbl(x)
    return (F.when(F.isnan(v), F.lit("nan"))
            .when(v == float("inf"), F.lit("+inf" if sign else "inf"))
            .when(v == float("-inf"), F.lit("-inf"))
            .otherwise(F.format_string(spec, F.round(v, digits))))


def money(x) -> Column:
    """``$1,234.56`` (sign after the dollar, as Python prints it)."""
    return F.concat(F.lit("$"), fmt_fixed(x, 2, thousands=True))


def money0(x) -> Column:
    return F.concat(F.lit("$"), fmt_fixed(x, 0, thousands=True))


def pct1(x) -> Column:
    return F.concat(fmt_fixed(x, 1), F.lit("%"))


def format_metric(x, prefix: str = "$") -> Column:
    """Short money: 1.23M / 45.6K / 789, sign before the prefix."""
    v = dbl(x)
    a = F.abs(v)
    body = (F.when(a >= 1_000_000, F.concat(fmt_fixed(a / 1_000_000, 2), F.lit("M")))
            .when(a >= 1_000, F.concat(fmt_fixed(a / 1_000, 1), F.lit("K")))
            .otherwise(fmt_fixed(a, 0, thousands=True)))
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(_is_missing(v), F.lit(NA)).otherwise(F.concat(sign, F.lit(prefix), body))


def trend_class(pct) -> Column:
    """Upward / downward / stable around ±5 %."""
    p = dbl(pct)
    return (F.when(p > TREND_LIMIT, "upward").when(p < -TREND_LIMIT, "downward")
            .otherwise("stable"))


def growth_statement(n_months, pct, first_month, last_month) -> Column:
    """One sentence on the revenue trend between first and last month."""
    multi = F.concat(F.lit("a "), trend_class(pct), F.lit(" revenue path of "),
                     fmt_fixed(pct, 1, sign=True), F.lit("% between "),
                     col(first_month), F.lit(" and "), col(last_month))
    return F.when(col(n_months) > 1, multi).otherwise(
        F.lit("a single billing month, so no trend can be measured yet"))


def margin_band(margin) -> Column:
    """P10: positive (>=15) / neutral (>=5) / negative."""
    m = dbl(margin)
    e = F.when(m >= MARGIN_BANDS[0][0], MARGIN_BANDS[0][1])
    for lim, name in MARGIN_BANDS[1:]:
        e = e.when(m >= lim, name)
    return e.otherwise("negative")


def health_class(score) -> Column:
    """Robust (>=80) / Stable (>=60) / Vulnerable."""
    s = col(score)
    e = F.when(s >= HEALTH_CLASSES[0][0], HEALTH_CLASSES[0][1])
    for lim, name in HEALTH_CLASSES[1:]:
        e = e.when(s >= lim, name)
    return e.otherwise("Vulnerable")


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Clamp to [lo, hi] (callers guard NULL: least/greatest skip it)."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col(x)))


def round_even_int(x) -> Column:
    """Round half to even, as an int."""
    return F.bround(col(x), 0).cast("int")


def strip_non_ascii(c) -> Column:
    """Drop every non-ASCII character."""
    return F.regexp_replace(col(c), r"[^\x00-\x7F]+", "")


def bold_to_html(c) -> Column:
    """``**x**`` → ``<b>x</b>``; a left-over unpaired ``**`` → ``<b>``."""
    paired = F.regexp_replace(col(c), r"(?s)\*\*(.*?)\*\*", "<b>$1</b>")
    return F.replace(paired, F.lit("**"), F.lit("<b>"))


def decorate_headings(c, title_map: dict[str, str]) -> Column:
    """Exact-string replacement chain, applied in the given order."""
    out = col(c)
    for old, new in title_map.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
