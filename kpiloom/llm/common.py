"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship  # noqa: F401

# Fixed value: the white space that separates words (space, tab, LF, VT, FF, CR).
WORD_SPACE = " \t\n\x0b\x0c\r"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins the
    table's true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(quoted(col)), F.lit(""))


def quoted(name: str) -> str:
    """A column name that may hold dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def hex64(col: Column) -> Column:
    """A long as 16 lowercase hex digits (two's complement)."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in have:
        name = "_" + name
    return name
