"""Parquet tables and the sales fact built from the test star schema.

At scale the fact is three equi-joins on keys of the big tables
(lineitem-orders on the order key, orders-customer, lineitem-part).  Their
strategy is left to Spark: adaptive execution turns one into a broadcast only
when the measured size is under ``autoBroadcastJoinThreshold``; otherwise it
stays a sort-merge join.  Only nation and region are broadcast explicitly:
the schema fixes them at 25 and 5 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mapping import Mapping

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Roles of the sales fact (region role = nation, 25 values).
FACT_MAPPING = Mapping(date="order_date", region="nation", product="product",
                       revenue="revenue", profit="profit")
FACT_MAPPING_NO_PROFIT = Mapping(date="order_date", region="nation", product="product",
                                 revenue="revenue", profit=None)
# Same fact, product role = brand (25 values) for top-10 views.
FACT_MAPPING_BRAND = Mapping(date="order_date", region="nation", product="brand",
                             revenue="revenue", profit="profit")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: load_table(spark, sf_dir, n) for n in names}


def sales_fact(spark: SparkSession, sf_dir: str, with_profit: bool = True) -> DataFrame:
    """One row per line item: date, geography, product, segment, money.

    Money is DECIMAL so sums are exact (and equal in every engine); the
    library casts to double only where it reports.
    """
    t = lambda n: load_table(spark, sf_dir, n)
    geo = (t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")))
    cust = (t("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "segment", "nation", "region"))
    orders = (t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("order_date"))
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "order_date", "segment", "nation", "region"))
    items = (t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
             .join(t("part").select("p_partkey", "p_type", "p_brand", "p_retailprice"),
                   F.col("l_partkey") == F.col("p_partkey")))
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    revenue = price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    cost = F.col("l_quantity").cast("decimal(6,0)") * F.col("p_retailprice").cast("decimal(12,2)")
    cols = [F.col("order_date"), F.col("region"), F.col("nation"),
            F.col("p_type").alias("product"), F.col("p_brand").alias("brand"),
            F.col("segment"), revenue.alias("revenue")]
    if with_profit:
        cols.append((revenue - cost).alias("profit"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*cols)


# The same fact as DuckDB SQL (used by the oracle side of every check).
FACT_SQL = """
SELECT o_orderdate AS order_date, r_name AS region, n_name AS nation, p_type AS product,
       p_brand AS brand, c_mktsegment AS segment,
       CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
       CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
         - CAST(l_quantity AS DECIMAL(6,0)) * CAST(p_retailprice AS DECIMAL(12,2)) AS profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
     JOIN part ON l_partkey = p_partkey
"""
