"""Test tables derived from the driver's tables (Spark form + SQL twin).

``dirty_sales``: line items re-written as messy text (money with '$',
brackets, units, percent signs, empties; dates with holes) so cleaning runs
over whole tables.  ``mixed_dates``: order dates printed in three formats
chosen by the order status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mapping import Mapping
from .tables import load_table

DIRTY_MAPPING = Mapping(date="sold_on", region="region", product="product", revenue="revenue",
                        profit="profit")


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    v = F.col("l_linenumber")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    gain = (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    revenue = (F.when(v == 1, price).when(v == 2, F.concat(F.lit("$"), price))
               .when(v == 3, F.concat(F.lit("("), price, F.lit(")")))
               .when(v == 4, F.concat(price, F.lit(" USD"))).when(v == 5, F.concat(F.lit("-"), price))
               .when(v == 6, F.lit("")).otherwise(F.concat(price, F.lit("%"))))
    return li.select(
        (F.col("l_orderkey") * 8 + v).cast("bigint").alias("row_id"),
        F.when(F.col("l_returnflag") == "A", F.when(v == 2, F.lit("not a date")).when(v == 3, None)
               .otherwise(day)).otherwise(day).alias("sold_on"),
        F.when((v == 4) & (F.col("l_returnflag") == "R"), None).otherwise(F.col("l_returnflag")).alias("region"),
        F.col("l_linestatus").alias("product"),
        revenue.alias("revenue"),
        F.when(v == 3, F.lit("N/A")).when(v == 5, None).otherwise(gain).alias("profit"),
    )


DIRTY_SQL = r"""
SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_id,
  CASE WHEN l_returnflag = 'A' THEN (CASE WHEN l_linenumber = 2 THEN 'not a date' WHEN l_linenumber = 3 THEN NULL
       ELSE strftime(l_shipdate, '%Y-%m-%d') END) ELSE strftime(l_shipdate, '%Y-%m-%d') END AS sold_on,
  CASE WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS region,
  l_linestatus AS product,
  CASE l_linenumber WHEN 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
    WHEN 2 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
    WHEN 3 THEN '(' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || ')'
    WHEN 4 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || ' USD'
    WHEN 5 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
    WHEN 6 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || '%' END AS revenue,
  CASE WHEN l_linenumber = 3 THEN 'N/A' WHEN l_linenumber = 5 THEN NULL
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) END AS profit
FROM lineitem"""


def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    txt = (F.when(s == "F", F.date_format(d, "yyyy-MM-dd")).when(s == "O", F.date_format(d, "MM/dd/yyyy"))
           .otherwise(F.date_format(d, "dd/MM/yyyy")))
    return o.select(F.col("o_orderkey").alias("row_id"), txt.alias("d"))


MIXED_SQL = """
SELECT o_orderkey AS row_id,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%m/%d/%Y')
       ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d
FROM orders"""


#: Column and value of a messy CSV record over ``lineitem``, as SQL of either engine; n is the line number.
MESSY = {
    "id": "CAST(l_orderkey * 8 + l_linenumber AS {text})", "code": "CAST(l_linenumber AS {text}) || substr('dfDFL', CAST(1 + l_orderkey % 5 AS INT), 1)",
    "hex": "'0x' || CAST(l_linenumber AS {text})", "flag": "CASE l_linestatus WHEN 'O' THEN 'True' ELSE 'FALSE' END",
    "big": "CASE WHEN l_linenumber = 2 THEN 'N/A' ELSE '1000000000000' || CAST(100000000 + l_orderkey AS {text}) END",
    "whole": "CASE WHEN l_linenumber = 3 THEN 'null' ELSE '-' || CAST(l_partkey AS {text}) END",
    "amount": "CASE l_linenumber WHEN 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS {text}) WHEN 2 THEN ' 12 ' WHEN 3 THEN '1e3' WHEN 4 THEN '.5' "
              "WHEN 5 THEN '<NA>' ELSE CAST(l_suppkey AS {text}) END",
    "none": "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '#N/A' END",
    "note": "CASE l_linenumber WHEN 1 THEN 'say \"' || l_returnflag || '\", then' || chr(10) || 'stop' WHEN 2 THEN chr(10) || '\"' WHEN 3 THEN 'a' || chr(13) || chr(10) || ',b' "
            "WHEN 4 THEN 'None' ELSE ' plain ' || l_returnflag END",
    "id.1": "l_returnflag",
}


def messy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV files over ``lineitem``: quoted line feeds, NA tokens, a repeated header; records of line 6 lack the last two values, those of line 7 have one too many."""
    names = list(MESSY)
    cells = load_table(spark, sf_dir, "lineitem").select("l_linenumber", *[F.expr(v.format(text="string")).alias(f"c{i}") for i, v in enumerate(MESSY.values())])
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = names.index("note")
    head = [F.col(f"c{i}") for i in range(note)]
    tail = [quoted(F.col(f"c{note}")), F.col(f"c{note + 1}")]
    n = F.col("l_linenumber")
    record = F.when(n == 6, F.concat_ws(",", *head)).when(n == 7, F.concat_ws(",", *head, *tail, F.lit("extra"))).otherwise(F.concat_ws(",", *head, *tail))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = ",".join("id" if c == "id.1" else c for c in names)
    return cells.select(F.when(first, F.concat(F.lit(header + "\n"), record)).otherwise(record).alias("value"))
