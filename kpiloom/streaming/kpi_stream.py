"""Running KPIs over a stream of sales rows (Structured Streaming).

The fact cube of the batch operators is kept as streaming state (one
grouping-sets aggregation, ``complete`` mode; the state is the small cube, not the rows) and, for every micro-batch, the
KPI record per entity is recomputed from the cube with the batch operators
and handed to ``sink(batch_df, epoch_id)``.  Checkpoints go to the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..mapping import Mapping
from ..operators.cube import fact_cube
from ..operators.kpis import KPI_COLUMNS, kpi_facts
from ..session import scratch_path


def running_kpis(spark: SparkSession, source_dir: str, schema: StructType, m: Mapping,
                 sink: Callable[[DataFrame, int], None], by: Sequence[str] = (),
                 checkpoint: str | None = None, fmt: str = "parquet"):
    """Start the stream; returns the ``StreamingQuery``."""
    rows = spark.readStream.schema(schema).format(fmt).load(source_dir)
    has_profit = bool(m.profit) and m.profit in schema.fieldNames()
    cube = fact_cube(rows, m, by, fine=False)  # a stream keeps one aggregation

    def per_batch(batch: DataFrame, epoch: int) -> None:
        facts = kpi_facts(batch, by, has_profit).select(*by, *KPI_COLUMNS)
        sink(facts, epoch)

    return (cube.writeStream.outputMode("complete").foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "kpi-stream"))
            .start())
