"""Ranks and running totals over an order, without gathering a key in one task.

A range partitioning of all rows by (key, order) cuts them into blocks; windows
work inside the blocks of a key, and one small window over a key's block totals
(at most one row for each partition) gives what lies before each block.  A key
with a third of all rows is thus spread over as many tasks as its rows need.
The blocks are written to the shared folder, so that they stay the same for all that follows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..session import write_and_read


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                   last: Sequence[str] = ()) -> DataFrame:
    """``df`` with, over the strictly earlier rows of the same keys, their number ``n_before``, the sum
    ``{name}_before`` of each value, and ``previous_{name}`` of each column in ``last``.

    Null keys are a key of their own; ties in ``order`` get an arbitrary but fixed order."""
    keys, order = list(keys), list(order)
    rows = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    rows = rows.repartitionByRange(*[named(c) for c in [*keys, *order]]).withColumn("_block", F.spark_partition_id())
    rows = write_and_read(rows, "blocks")
    inside = Window.partitionBy(*[named(k) for k in keys], "_block").orderBy(*[named(c) for c in order])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.row_number().over(inside).alias("_at"),
                       *[F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in values],
                       *[F.lag(named(c)).over(inside).alias(f"_lag_{c}") for c in last])
    totals = rows.groupBy(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values],
        *[F.max_by(named(c), "_at").alias(f"_last_{c}") for c in last])
    blocks = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_b")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[f"_k{i}" for i in range(len(keys))], "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in values],
                            *[F.lag(f"_last_{c}").over(blocks).alias(f"_l0_{c}") for c in last])
    same = rows["_block"] == offsets["_b"]
    for i, k in enumerate(keys):
        same = same & rows[f"`{k}`"].eqNullSafe(offsets[f"_k{i}"])
    j = rows.join(offsets, same)
    return j.select(*[rows[f"`{c}`"] for c in df.columns], (F.col("_n0") + F.col("_at") - 1).cast("long").alias("n_before"),
                    *[(F.col(f"_s0_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in values],
                    *[F.when(F.col("_at") == 1, F.col(f"_l0_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"previous_{c}") for c in last])
