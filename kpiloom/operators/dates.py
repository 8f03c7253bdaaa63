"""C3 for columns of any date format: the format is induced from the shapes of all values.

One aggregation counts the column's shapes (which parts a value has, in which order, with which separators) and the range that each
numeric part takes in them.  The ranges settle which part is the day, the month or the year: a part above 31, or of four digits, is
a year, one above 12 a day.  Shapes that leave the order open borrow it from the column's other shapes with the same separators, then from all
others; what is still open reads month first and is reported as ambiguous.  Values are then parsed in one
narrow pass, each by its own shape.  Tasks match the grammar against outlines (a text with 0 for each digit), once for all texts of an outline, and read the
digits of these texts together.

Shapes are a fixed grammar, so the histogram is small whatever the column holds.  Read are: year-month-day and its orders with ``-``, ``/``, ``.`` or blanks, two-digit
years (69-99 are 1969-1999), months by English name, year and month alone, 8 or 14 digits, 4-digit years; weekdays, ordinals
(``3rd``) and commas are skipped; times of 12 or 24 hours with fractions; ``Z``, ``UTC``, ``GMT`` or an offset, which is taken off (results are UTC).
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..session import ship

# ---------------------------------------------------------------------------
# The words of dates and the grammar of their shapes (texts are in lower case and trimmed).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?")
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +)?"
_DAY = r"([0-9]{1,2})(?:st|nd|rd|th)?"
_TIME = (r"(?:(?:t|,? +)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?: ?([ap])\.?m\.?)?(?: ?(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?)?")
#: Shape: its pattern, and what its groups are: a, b, c are numbers in open order, y m d are settled, n a month's name, s the separator.
SHAPES = {
    "number": (rf"{_WEEKDAY}([0-9]{{1,4}})([-/. ])([0-9]{{1,2}})\2([0-9]{{1,4}})", "asbc"),
    "day month-name year": (rf"{_WEEKDAY}{_DAY}[- .]*{_MONTH}[- .,]*([0-9]{{4}}|[0-9]{{2}})", "dny"),
    "month-name day year": (rf"{_WEEKDAY}{_MONTH}[- ]*{_DAY},? +([0-9]{{4}})", "ndy"),
    "year month-name day": (rf"([0-9]{{4}})[- .]{_MONTH}[- .]{_DAY}", "ynd"),
    "month-name year": (rf"{_MONTH}[- .,]*([0-9]{{4}})", "ny"),
    "year month": (r"([0-9]{4})[-/.]([0-9]{1,2})", "ym"),
    "month year": (r"([0-9]{1,2})[-/.]([0-9]{4})", "my"),
    "8 digits": (r"([0-9]{4})([0-9]{2})([0-9]{2})", "ymd"),
    "14 digits": (r"([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})", "ymdhie"),
    "year": (r"([0-9]{4})", "y"),
}
_UNTIMED = ("14 digits", "year")  # the last shapes
_TIMES = "hiefpo"  # hour, minute, second, fraction, a or p, offset
ORDERS = ("ymd", "ydm", "dmy", "mdy")
DEFAULT_ORDER, PIVOT = "mdy", 69
# ---------------------------------------------------------------------------


_PATTERN = re.compile((rf"(?:(?:{'|'.join(SHAPES[s][0] for s in SHAPES if s not in _UNTIMED)}){_TIME}|{'|'.join(SHAPES[s][0] for s in _UNTIMED)})").encode())
#: The shapes in the order of their groups in the pattern, None for the time; and the role of each group.
_ORDERED = [*(s for s in SHAPES if s not in _UNTIMED), None, *_UNTIMED]
_GROUPS = [(shape, role) for shape in _ORDERED for role in (SHAPES[shape][1] if shape else _TIMES)]
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
OUTLINES, LONGEST = 4096, 64  # outlines that a task keeps, and bytes of one


class _Form(NamedTuple):
    """What all texts of one outline (digits as 0) share: their shape, and where the digits of each role are."""
    shape: str | None
    separator: str | None
    time: str
    at: dict[str, tuple[int, int]]
    month: int | None
    half: str | None
    sign: int
    offset: list[int] | None


_NONE = _Form(None, None, "", {}, None, None, 1, None)


def _form(outline: bytes) -> _Form:
    m = _PATTERN.fullmatch(outline)
    if not m:
        return _NONE
    shape = next(s for k, (s, _) in enumerate(_GROUPS, 1) if s and m.start(k) >= 0)
    spans = {role: m.span(k) for k, (s, role) in enumerate(_GROUPS, 1) if m.start(k) >= 0}
    text = lambda role: outline[slice(*spans[role])].decode() if role in spans else None
    zone, name = text("o"), text("n")
    time = "" if "h" not in spans or shape == "14 digits" else "H:M" + ":S" * ("e" in spans) + ".F" * ("f" in spans) + " am" * ("p" in spans) + " zone" * ("o" in spans)
    places = [k for k in range(*spans["o"]) if outline[k:k + 1].isdigit()] if zone else []
    return _Form(shape, text("s"), time, {r: at for r, at in spans.items() if r not in "snpo"}, MONTHS.index(name[:3]) + 1 if name else None, text("p"),
                 -1 if zone and zone[0] == "-" else 1, places or None)


def _forms(texts, known: dict):
    """(form, rows, bytes) for each outline of the texts: which texts have it, and their bytes in one row each; nulls are left out.

    Only outlines are matched against the grammar, as it does not tell one digit from another; ``known`` keeps the forms of a task."""
    import numpy as np
    import pyarrow as pa

    rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    texts = pa.concat_arrays([texts.drop_null()]).cast(pa.binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], "int32", len(texts) + 1, texts.offset * 4)
    data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if offsets[-1] else b""
    outlines = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.translate(_DIGITS))]).dictionary_encode()
    codes, data = outlines.indices.to_numpy(), np.frombuffer(data, "uint8")
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(outlines.dictionary) + 1))
    none = []
    for k, outline in enumerate(outlines.dictionary.to_pylist()):
        if (form := known.get(outline)) is None:
            form = _form(outline)
            if len(outline) <= LONGEST:
                if len(known) >= OUTLINES:
                    known.clear()
                known[outline] = form
        some = order[cuts[k]:cuts[k + 1]]
        if form.shape is None:
            none.append(some)
        else:
            yield form, rows[some], data[offsets[some][:, None] + np.arange(len(outline))]
    if none:
        yield _NONE, rows[np.concatenate(none)], None


def _number(digits, at):
    """The numbers that stand at places of texts of one length."""
    import numpy as np

    out = np.zeros(len(digits), "int64")
    for k in at:
        out = out * 10 + (digits[:, k] - 48)
    return out


def _text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


_SHAPE = ("column string, shape string, separator string, `time` string, n long, lo_a int, hi_a int, lo_b int, hi_b int, lo_c int, hi_c int, "
          "digits_a int, digits_c int")


def _count(names: list[str]):
    """The shapes of a task's values, with the range that each numeric part takes."""
    def work(batches):
        import pyarrow as pa

        known: dict = {}
        held: dict = {}
        for b in batches:
            for i, name in enumerate(names):
                for form, rows, digits in _forms(b.column(i), known):
                    key = (name, form.shape, form.separator, form.time)
                    now = [len(rows)]
                    for c in "abc":
                        number = _number(digits, range(*form.at[c])) if c in form.at else None
                        now += [None, None] if number is None else [int(number.min()), int(number.max())]
                    now += [form.at[c][1] - form.at[c][0] if c in form.at else None for c in "ac"]
                    was = held.get(key)
                    held[key] = now if was is None else [f(x, y) if x is not None else None for f, x, y in zip(_ADDED, was, now)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((*k, *v) for k, v in held.items())), [pa.string()] * 4 + [pa.int64()] + [pa.int32()] * 8)],
                                             names=["column", "shape", "separator", "time", "n", "lo_a", "hi_a", "lo_b", "hi_b", "lo_c", "hi_c", "digits_a", "digits_c"])
    return work


_ADDED = (int.__add__, min, max, min, max, min, max, max, max)


def date_shapes(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """(column, shape, separator, time, n, lo_a, hi_a, lo_b, hi_b, lo_c, hi_c, digits_a, digits_c): the columns' shapes; shape null: no date.

    One pass serves all columns.  Counted before they are shuffled; a column has at most some hundred."""
    names = [columns] if isinstance(columns, str) else list(columns)
    ship(df.sparkSession)
    parts = df.select(*[_text(named(c)).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(_count(names), _SHAPE)
    low, high = [[g(c).alias(c) for c in some] for g, some in ((F.min, ["lo_a", "lo_b", "lo_c"]), (F.max, ["hi_a", "hi_b", "hi_c"]))]
    ranges = [c for pair in zip(low, high) for c in pair]
    return parts.groupBy("column", "shape", "separator", "time").agg(
        F.sum("n").alias("n"), *ranges, F.max("digits_a").alias("digits_a"), F.max("digits_c").alias("digits_c"))


def _orders_of(r) -> list[str]:
    """The orders of (a, b, c) that all values of a shape allow."""
    hi = {k: r[f"hi_{k}"] for k in "abc"}
    year_at = [k for k, digits in (("a", r["digits_a"]), ("c", r["digits_c"])) if digits > 2 or hi[k] > 31]
    fits = []
    for order in ORDERS:
        at = dict(zip(order, "abc"))
        others = [k for k in year_at if k != at["y"]]
        if not others and hi[at["m"]] <= 12 and hi[at["d"]] <= 31:
            fits.append(order)
    if year_at:
        return fits
    return [o for o in fits if o[2] == "y"] or fits  # two digits everywhere: years come last


def induce(df: DataFrame, column: str) -> list[dict]:
    """For each shape of the column: shape, separator, time, n, order ('' where it needs none, None where no order fits), ambiguous."""
    return induce_all(df, [column])[column]


def induce_all(df: DataFrame, columns: list[str]) -> dict[str, list[dict]]:
    """``induce`` for each of the columns, from one pass over all of them."""
    rows = date_shapes(df, columns).collect()  # of a fixed grammar
    return {c: _plan([r for r in rows if r["column"] == c]) for c in columns}


def _plan(rows: list) -> list[dict]:
    out, sure = [], {}
    for r in rows:
        if r["shape"] == "number":
            fits = _orders_of(r)
            if len(fits) == 1:
                sure.setdefault(r["separator"], {}).setdefault(fits[0], 0)
                sure[r["separator"]][fits[0]] += r["n"]
    pooled: dict[str, int] = {}
    for counts in sure.values():
        for order, n in counts.items():
            pooled[order] = pooled.get(order, 0) + n
    best = lambda counts, fits: min((o for o in counts if o in fits), key=lambda o: (-counts[o], ORDERS.index(o)), default=None)
    for r in rows:
        order, ambiguous = "", False
        if r["shape"] == "number":
            fits = _orders_of(r)
            order = fits[0] if len(fits) == 1 else None
            if len(fits) > 1:
                borrowed = best(sure.get(r["separator"], {}), fits) or best(pooled, fits)
                iso = "ymd" if "ymd" in fits else DEFAULT_ORDER if DEFAULT_ORDER in fits else fits[0]
                order, ambiguous = borrowed or iso, borrowed is None and iso != "ymd"
        out.append({"shape": r["shape"], "separator": r["separator"], "time": r["time"], "n": r["n"], "order": order, "ambiguous": ambiguous})
    return sorted(out, key=lambda x: (-x["n"], x["shape"] or "", x["separator"] or "", x["time"]))


def parse_column(c: Column, plan: list[dict]) -> Column:
    """Text dates as timestamp_ntz by an induced plan; NULL where a value is no date."""
    orders = {(x["separator"], x["time"]): x["order"] for x in plan if x["shape"] == "number" and x["order"]}
    ship(SparkSession.active())
    return F.arrow_udf(_parser(orders), "timestamp_ntz")(_text(c))


def _parser(orders: dict):
    known: dict = {}

    def work(texts: pa.Array) -> pa.Array:
        import numpy as np

        out = np.full(len(texts), np.datetime64("NaT"), "datetime64[us]")
        for form, rows, digits in _forms(texts, known):
            order = orders.get((form.separator, form.time)) if form.shape == "number" else ""
            if form.shape is not None and order is not None:
                out[rows] = _moments(form, order, digits)
        return pa.array(out)

    return work


def _moments(form: _Form, order: str, digits):
    """The times that texts of one form say, not a time where a part is out of range."""
    import numpy as np

    at = {**form.at, **{role: form.at[c] for role, c in zip(order, "abc")}}
    part = lambda role, missing=0: _number(digits, range(*at[role])) if role in at else np.full(len(digits), missing, "int64")
    year, month, day = part("y"), part("m", form.month or 1), part("d", 1)
    if at["y"][1] - at["y"][0] <= 2:
        year += np.where(year >= PIVOT, 1900, 2000)
    hour, minute, second = part("h"), part("i"), part("e")
    good = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (minute <= 59) & (second <= 59) & (day >= 1)
    if form.half:
        good &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + (12 if form.half == "p" else 0)
    months = np.where(good, (year - 1970) * 12 + month - 1, 0).astype("datetime64[M]")
    first = months.astype("datetime64[D]")
    good &= (hour <= 23) & (day <= ((months + 1).astype("datetime64[D]") - first).astype("int64"))
    seconds = (hour * 60 + minute) * 60 + second
    if form.offset:
        hours, minutes = (_number(digits, form.offset[k:k + 2]) for k in (0, 2))
        seconds -= form.sign * (hours * 60 + minutes) * 60
    micros = 0
    if "f" in at:
        begin, end = at["f"]
        micros = _number(digits, range(begin, min(end, begin + 6))) * 10 ** max(0, 6 - (end - begin))
    out = (first + (day - 1)).astype("datetime64[us]") + (seconds * 1_000_000 + micros)
    out[~good] = np.datetime64("NaT")
    return out


def parse_induced(df: DataFrame, column: str, into: str | None = None, plan: list[dict] | None = None) -> DataFrame:
    """``df`` with the column's values as timestamp_ntz (in ``into``, or in its place); NULL where a value is no date."""
    return df.withColumn(into or column, parse_column(named(column), induce(df, column) if plan is None else plan))


def date_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shape, separator, time, n, order, ambiguous) for each shape of each column."""
    spark = df.sparkSession
    plans = induce_all(df, columns)
    rows = [(c, x["shape"], x["separator"], x["time"], x["n"], x["order"], x["ambiguous"]) for c in columns for x in plans[c]]
    return spark.createDataFrame(rows, "`column` string, shape string, separator string, `time` string, n long, `order` string, ambiguous boolean")
