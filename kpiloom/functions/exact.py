"""Number text from the exact binary value, ties to even, in column functions.

A double's whole part is split into two longs and its fraction into twice 52 bits and a mark for further ones (which only numbers far
below any half have), each step exact; the wanted decimals are then an integer division with its remainder, rounded
up above one half, and at exactly one half if the last digit is odd.  (``scalars.fmt_fixed`` rounds the shortest decimal half up.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import NA, dbl

# The fraction's unit (2^104) and half of it, and the size above which a number is printed from its shortest decimal.
_BITS, _HALF = str(1 << 104), str(1 << 103)
_LARGE = 1e28


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(a: Column, decimals: int) -> Column:
    """|x| * 10^decimals as the digits of a whole number, rounded half even."""
    power, unit = F.lit(10 ** decimals).cast("decimal(5,0)"), F.lit(_BITS).cast("decimal(32,0)")
    half = F.lit(_HALF).cast("decimal(32,0)")

    def rounded(r):
        up = (r["rest"] > half) | ((r["rest"] == half) & (r["more"] | (F.pmod(r["scaled"], F.lit(2)) == 1)))
        return (r["scaled"] + F.when(up, 1).otherwise(0)).cast("decimal(38,0)").cast("string")

    def divided(r):
        # the decimal division may round to the next whole number: its remainder puts it right
        off = F.when(r["rest"] < 0, -1).otherwise(0)
        return _let(F.struct((r["integer"] * power + r["quotient"] + off).cast("decimal(38,0)").alias("scaled"), (r["rest"] - off * unit).cast("decimal(38,0)").alias("rest"),
                             r["more"].alias("more")), rounded)

    def numbers(r):
        numerator = (r["bits"] * power).cast("decimal(38,0)")
        return _let(F.struct(numerator.alias("n"), F.floor(numerator / unit).cast("decimal(10,0)").alias("q"), r["integer"].alias("integer"), r["more"].alias("more")),
                    lambda x: _let(F.struct(x["q"].alias("quotient"), (x["n"] - (x["q"] * unit).cast("decimal(38,0)")).cast("decimal(38,0)").alias("rest"), x["integer"].alias("integer"),
                                            x["more"].alias("more")), divided))

    def fraction(r):
        integer = (r["whole"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + r["low"].cast("decimal(20,0)")).cast("decimal(30,0)")
        return _let((r["a"] - (r["whole"].cast("double") * F.lit(2.0 ** 32) + r["low"].cast("double"))) * F.lit(2.0 ** 52),
                    lambda part: _let((part - F.floor(part).cast("double")) * F.lit(2.0 ** 52), lambda rest: _let(
                        F.struct((F.floor(part).cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(16,0)") + F.floor(rest).cast("decimal(20,0)")).cast("decimal(32,0)").alias("bits"),
                                 (rest > F.floor(rest).cast("double")).alias("more"), integer.alias("integer")), numbers)))

    # every division by a power of two, and every difference here, is exact
    return _let(a, lambda x: _let(F.floor(x / F.lit(2.0 ** 32)), lambda whole: _let(
        F.struct(x.alias("a"), whole.alias("whole"), F.floor(x - whole.cast("double") * F.lit(2.0 ** 32)).alias("low")), fraction)))


def fixed_exact(x, decimals: int = 0, thousands: bool = False, sign: bool = False) -> Column:
    """``x`` with so many decimals (at most 4), rounded half even on its binary value; NULL stays NULL, infinities are inf, NaN is nan."""
    def shown(text):
        integer = F.substr(text, F.lit(1), F.length(text) - decimals)
        if thousands:
            integer = F.regexp_replace(integer, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
        return F.concat(integer, F.lit("."), F.substr(text, F.length(text) - decimals + 1, F.lit(decimals))) if decimals else integer

    def whole(v):
        a = F.abs(v)
        digits = _digits(F.when((a < _LARGE) & ~F.isnan(a), a).otherwise(0.0), decimals)
        body = _let(_let(digits, lambda t: F.lpad(t, F.greatest(F.length(t), F.lit(decimals + 1)), F.lit("0"))), shown)
        large = F.format_string(f"%{',' if thousands else ''}.{decimals}f", a)
        body = F.when(F.isnan(v), "nan").when(a == float("inf"), "inf").when(a >= _LARGE, large).otherwise(body)
        minus = (v < 0) | F.startswith(v.cast("string"), F.lit("-"))
        return F.when(v.isNotNull(), F.concat(F.when(minus, "-").otherwise("+" if sign else ""), body))

    return _let(dbl(x), whole)


def format_metric_exact(x, prefix: str = "$") -> Column:
    """P6 exactly: 1.23M / 45.6K / 1,000 of the binary value; the divisions by a million and a thousand are those of doubles."""
    def short(v):
        a = F.abs(v)
        scaled = F.when(a >= 1_000_000, a / 1_000_000).when(a >= 1_000, a / 1_000).otherwise(a)
        body = (F.when(a >= 1_000_000, F.concat(fixed_exact(scaled, 2), F.lit("M")))
                .when(a >= 1_000, F.concat(fixed_exact(scaled, 1), F.lit("K"))).otherwise(fixed_exact(scaled, 0, thousands=True)))
        return F.when(v.isNull() | F.isnan(v), NA).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), F.lit(prefix), body))

    return _let(dbl(x), short)


def money_exact(x) -> Column:
    """$1,234.56, the sign after the prefix."""
    return F.concat(F.lit("$"), fixed_exact(x, 2, thousands=True))


def percent_exact(x, sign: bool = False) -> Column:
    """12.3%, with ``sign`` +12.3%."""
    return F.concat(fixed_exact(x, 1, sign=sign), F.lit("%"))
