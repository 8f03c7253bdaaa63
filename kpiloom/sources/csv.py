"""CSV scan with pandas-like NA tokens, column types from all values, and a ledger of bad rows.

Records (``records.py``) may hold quoted line feeds and are read by as many tasks as the files have splits.  A record with
too many values, or with a quote that is never closed, is bad: it goes to the ledger with its reason, and by default the
load fails with a message, as one bad row makes the file unreadable.  A record with too few values is filled up with NULL and noted too.

NA tokens become NULL; then one aggregation finds each column's type on the lattice null < bool < bigint < decimal(38,0) < double < string:
counts of the values that each type can hold, and the smallest value that speaks against it as a witness.  Repeated header names get
pandas-style suffixes (``x, x.1, x.2``).
"""

from __future__ import annotations

import re
from typing import Iterable, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..session import ship, stable_splits, write_and_read
from .records import FIELDS, INNER, Scan, ends_inside, joined, pieces_of, scan, split

# ---------------------------------------------------------------------------
# Text read as missing (pandas read_csv defaults), and what the types look like.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INT_PATTERN = r"[+-]?[0-9]+"
NUMBER_PATTERN = r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)"
MAX_DIGITS = 38
# ---------------------------------------------------------------------------

#: A pattern with blanks around it, and at most one of the line ends that are no blanks behind it.
_AT_ONCE = r"\A[ \t\n\v\f\r]*{}[ \t\n\v\f\r]*[\x{{85}}\x{{2028}}\x{{2029}}]?\z"
_NO_DIGIT = re.compile(r"[^0-9]|^[ \t\n\v\f\r]*[+-]?0+(?=[0-9])")

TOO_MANY, TOO_FEW, UNCLOSED = "too many values", "too few values", "quote not closed"


def pandas_style_names(names: Iterable[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            k = f"{n}.{seen[n]}"
            while k in seen:
                seen[n] += 1
                k = f"{n}.{seen[n]}"
            seen[k] = 0
            out.append(k)
        else:
            seen[n] = 0
            out.append(n)
    return out


#: Session setting that names the dataset to load when no path is given.
DEFAULT_SETTING = "spark.kpiloom.defaultDataset"


class CsvTable(NamedTuple):
    """Rows with typed columns; the ledger (file, number, reason, n_values, kept, record); a row of type evidence for each column."""
    rows: DataFrame
    ledger: DataFrame
    types: DataFrame


def values_of(record: Column) -> Column:
    """The values of a record as an array, quotes taken off."""
    def plain(raw):
        inner = F.replace(F.regexp_extract(raw, rf'\A"({INNER})', 1), F.lit('""'), F.lit('"'))
        tail = F.regexp_extract(raw, rf'(?s)\A"{INNER}"(.*)\z', 1)
        return F.when(F.startswith(raw, F.lit('"')), F.concat(inner, tail)).otherwise(raw)

    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELDS), 1), plain)
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.split(record, ",", -1))  # without quotes every comma parts values


def _header(found: Scan) -> list[str] | None:
    """The header, which must be the same in all files."""
    heads = found.heads
    if None in heads:
        pieces = pieces_of(found).where("number = 1").drop("v")
        records = pieces.where("whole").select("file", "number", "record").unionByName(joined(pieces))
        heads = {r["record"] for r in records.select("record").distinct().limit(2).collect()}
    several = sorted({tuple(split(h)) for h in heads})
    if len(several) > 1:
        raise ValueError(f"the files have different headers: {list(several[0])} and {list(several[1])}")
    return list(several[0]) if several else None


def read_csv(spark: SparkSession, path: str | None = None, na_values: Iterable[str] = NA_TOKENS, infer_types: bool = True) -> CsvTable:
    """The good rows of CSV files, the ledger of the others, and why each column has its type."""
    path = path or spark.conf.get(DEFAULT_SETTING, None)
    if not path:
        raise ValueError(f"give a path, or name a default dataset in {DEFAULT_SETTING}")
    with stable_splits(spark):
        found = scan(spark, path)
        header = _header(found)
        if header is None:
            raise ValueError(f"no columns to parse in {path}")
        names, n = pandas_style_names(header), len(header)
        pieces = pieces_of(found, n).where("number > 1")
        # of good rows only the values are stored, of bad ones and of pieces only the record
        na = [v for v in na_values]
        parsed = write_and_read(pieces.select("block", "whole", *_judged(pieces, n, F.when(F.col("whole"), F.lit(False)), na)), "csv-parsed")
    if found.crossed:
        others = joined(parsed).withColumn("v", values_of(F.col("record")))
        others = write_and_read(others.select(*_judged(others, n, F.contains("record", F.lit('"')) & ends_inside(F.col("record")), na)), "csv-joined")
        parsed = parsed.where("whole").drop("block", "whole").unionByName(others)
    ledger = parsed.where("reason IS NOT NULL").select("file", "number", "reason", "n_values", "kept", "record")
    rows = parsed.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    types = column_types(rows)
    if infer_types:
        found = {r["column"]: r["type"] for r in types.collect()}
        rows = rows.select(*[cast_text(named(c), found[c]).alias(c) for c in names])
    return CsvTable(rows, ledger, types)


def _judged(records: DataFrame, n: int, unclosed: Column, na: list[str]) -> list[Column]:
    """(file, number, record, n_values, reason, kept, c0, c1, ...) of records of ``n`` columns; ``unclosed`` is null for pieces, which keep their text."""
    size = F.size("v")
    reason = F.when(unclosed, UNCLOSED).when(size > n, TOO_MANY).when(size < n, TOO_FEW)
    kept = unclosed.isNotNull() & (reason.isNull() | (reason == TOO_FEW))
    value = lambda i: F.get(F.col("v"), F.lit(i))
    return [F.col("file"), F.col("number"), F.when(unclosed.isNull() | reason.isNotNull(), F.col("record")).alias("record"), size.alias("n_values"),
            reason.alias("reason"), kept.alias("kept"), *[F.when(kept & ~value(i).isin(na), value(i)).alias(f"c{i}") for i in range(n)]]


def cast_text(v: Column, kind: str) -> Column:
    if kind == "string":
        return v
    if kind == "boolean":
        return F.lower(F.trim(v)).cast("boolean")
    # Java's own suffixes and other spellings never get here: the type was found by patterns
    infinite = F.contains(F.lower(v), F.lit("inf"))
    return F.when(infinite, F.when(F.startswith(F.trim(v), F.lit("-")), float("-inf")).otherwise(float("inf"))) \
        .otherwise(F.when(~infinite, v).try_cast("double")) if kind == "double" else F.trim(v).try_cast(kind)


_EVIDENCE = "column string, n_values long, n_bool long, n_long long, n_integer long, n_number long, not_long string, not_integer string, not_number string"


def _kinds(values):
    """Whether each text is an integer of 64 bits, an integer of at most 38 digits, a number; masks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    matches = lambda pattern: pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)
    number = matches(_AT_ONCE.format(NUMBER_PATTERN))
    if not number.any():
        return number, number, number
    integer, plain = matches(_AT_ONCE.format(INT_PATTERN)), matches(rf"\A[ \t\n\v\f\r]*[+-]?[0-9]+[ \t\n\v\f\r]*\z")
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
    digits = pc.utf8_length(pc.utf8_ltrim(pc.utf8_trim(values, " \t\n\v\f\r+-"), "0")).to_numpy(zero_copy_only=False)
    long = plain & (digits <= 19)
    for k in np.flatnonzero(long & (digits == 19)):
        long[k] = -1 << 63 <= _int(values[k].as_py()) < 1 << 63
    for k in np.flatnonzero(integer & (size > MAX_DIGITS)):
        integer[k] = len(_NO_DIGIT.sub("", values[k].as_py())) <= MAX_DIGITS
    return long, integer, number


def _int(text: str) -> int:
    """An integer whatever zeros it begins with (the language limits the digits it reads)."""
    return int(text.strip().lstrip("+-").lstrip("0") or "0") * (-1 if "-" in text else 1)


def _evidence(names: list[str]):
    """What the values of a task say of each column's type, added up over its batches."""
    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        counts, least = np.zeros((len(names), 5), "int64"), [[None] * 3 for _ in names]
        for b in batches:
            for i in range(len(names)):
                v = b.column(i).drop_null()
                kinds = _kinds(v)
                counts[i] += [len(v), pc.sum(pc.is_in(v, pa.array(BOOLS))).as_py() or 0, *(int(k.sum()) for k in kinds)]
                for at, k in enumerate(kinds):
                    found = pc.min(v.filter(pa.array(~k))).as_py()
                    if found is not None and (least[i][at] is None or found.encode() < least[i][at].encode()):
                        least[i][at] = found
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c) for c in counts.T), *(pa.array(c, pa.string()) for c in zip(*least))],
                                         names=["column", "n_values", "n_bool", "n_long", "n_integer", "n_number", "not_long", "not_integer", "not_number"])
    return work


def column_types(rows: DataFrame) -> DataFrame:
    """(column, type, n_values, n_bool, n_long, n_integer, n_number, not_long, not_integer, not_number): one row for each text column.

    Counts of the values that fit each type, and the smallest value that does not as a witness.  They add up over parts of a table, so types of a
    growing dataset follow from the types of its parts (``lattice_type``)."""
    spark = rows.sparkSession
    ship(spark)
    names = rows.columns
    none = spark.createDataFrame([(c, 0, 0, 0, 0, 0, None, None, None) for c in names], _EVIDENCE)  # a table without rows has its columns
    texts = rows.select(*[named(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    return merged_types(none.unionByName(texts.mapInArrow(_evidence(names), _EVIDENCE)))


def merged_types(parts: DataFrame) -> DataFrame:
    """Rows of ``column_types`` of several parts of a table as one row for each column."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_values", "n_bool", "n_long", "n_integer", "n_number")]
    both = parts.groupBy("column").agg(*sums, *[F.min(c).alias(c) for c in ("not_long", "not_integer", "not_number")])
    return both.select("column", lattice_type().alias("type"), *[c for c in both.columns if c != "column"])


def lattice_type() -> Column:
    """The least type that holds all values; a column without values is double, as in pandas."""
    n = F.col("n_values")
    return (F.when(n == 0, "double").when(F.col("n_bool") == n, "boolean").when(F.col("n_long") == n, "bigint")
            .when(F.col("n_integer") == n, f"decimal({MAX_DIGITS},0)").when(F.col("n_number") == n, "double").otherwise("string"))


def load_csv(spark: SparkSession, path: str | None = None, na_values: Iterable[str] = NA_TOKENS,
             infer_numbers: bool = True, on_bad: str = "fail") -> DataFrame:
    """The rows of CSV files.  ``on_bad``: 'fail' raises on bad rows, with the first of them; 'skip' leaves them out (``read_csv`` has the ledger)."""
    table = read_csv(spark, path, na_values, infer_numbers)
    if on_bad == "fail":
        bad = table.ledger.where("NOT kept")
        first = bad.orderBy("file", "number").limit(1).collect()
        if first:
            r = first[0]
            raise ValueError(f"{bad.count()} bad rows; the first, a record of {r['file']}: {r['reason']} "
                             f"({r['n_values']}, expected {len(table.rows.columns)}): {r['record'][:200]}")
    return table.rows
