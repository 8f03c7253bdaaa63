"""kpiloom: sales KPI, health score and decision-report tables on Spark.

Layout
------
sources/    read CSV / parquet, the test star-schema fact, sinks
functions/  Column-level scalar functions (formatting, bands, margins)
operators/  table operators: mapping, cleaning, cube, KPIs, views, profile,
            briefs, questions, markdown text tables
plans/      the query registry (``queries()``) and its DuckDB oracle SQL
streaming/  the same cube maintained incrementally with Structured Streaming
"""

from .mapping import Mapping  # noqa: F401
