"""Registered queries: the cube and the KPI record refreshed by deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refresh as R
from ..operators.cube import cube_report
from ..operators.kpis import KPI_COLUMNS, kpi_facts
from ..session import write_and_read
from ..sources.tables import FACT_MAPPING, sales_fact
from . import sql as Q
from .q_kpis import SCORES, rounded
from .registry import query

BY = ["segment"]
# What happened since the cube was stored: late orders came, one nation's early months went, one brand's prices rose.
_NEW = "order_date >= TIMESTAMP '2000-07-01'"
_GONE = "nation = 'NATION_7' AND order_date < TIMESTAMP '1996-01-01'"
_DEARER = "brand = 'Brand#11' AND NOT (nation = 'NATION_7' AND order_date < TIMESTAMP '1996-01-01')"
_AFTER = f"""SELECT order_date, region, nation, product, brand, segment, CASE WHEN {_DEARER} AND NOT ({_NEW}) THEN revenue * 2 ELSE revenue END AS revenue, profit
FROM ({Q.FACT_SQL}) WHERE NOT ({_GONE})"""


def _refreshed(spark, d):
    fact = sales_fact(spark, d)
    old = fact.where(f"NOT ({_NEW})")
    state = write_and_read(R.cells(old, FACT_MAPPING, BY), "cube-state")
    raised = old.where(_DEARER)
    added = fact.where(_NEW).where(f"NOT ({_GONE})").unionByName(raised.withColumn("revenue", (F.col("revenue") * 2).cast(raised.schema["revenue"].dataType)))
    removed = old.where(_GONE).unionByName(raised)
    return R.refreshed(state, R.change(added, removed, FACT_MAPPING, BY), by=BY)


@query("cube_refresh", Q.with_fact("""
SELECT segment, CASE WHEN GROUPING(nation) = 0 THEN 'region' WHEN GROUPING(product) = 0 THEN 'product' WHEN GROUPING(m) = 0 THEN 'month' ELSE 'all' END AS level,
       COALESCE(CASE WHEN GROUPING(nation) = 0 THEN nation END, CASE WHEN GROUPING(product) = 0 THEN product END, CASE WHEN GROUPING(m) = 0 THEN m END) AS key,
       CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit, COUNT(*) AS n
FROM (SELECT *, strftime(order_date, '%Y-%m') AS m FROM f)
GROUP BY GROUPING SETS ((segment, nation), (segment, product), (segment, m), (segment))""", fact=_AFTER))
def q_cube_refresh(spark, d):
    """A stored cube plus a change (rows added, removed, changed), as a cube from scratch."""
    return cube_report(R.cube_of(_refreshed(spark, d), BY), BY)


@query("kpi_refresh", Q.with_fact(f"SELECT segment, {Q.KPI_COLS} FROM kf", fact=_AFTER, extra_ctes=Q.kpi_facts_ctes(BY)))
def q_kpi_refresh(spark, d):
    """The KPI record of each segment from the refreshed cube."""
    facts = kpi_facts(R.cube_of(_refreshed(spark, d), BY), BY, True).select(*BY, *KPI_COLUMNS)
    return rounded(facts, 6, *SCORES)
