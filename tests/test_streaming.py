"""The streaming cube gives the same KPI record as the batch operator."""

import os
import tempfile

from kpiloom.operators.kpis import kpi_summary
from kpiloom.sources.tables import FACT_MAPPING, sales_fact
from kpiloom.streaming import running_kpis

SF = "/root/testdata/sf0.001"


def test_running_kpis_match_batch(spark):
    fact = sales_fact(spark, SF)
    src = tempfile.mkdtemp(prefix="kpiloom-stream-src-")
    fact.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "part"))
    out = []
    q = running_kpis(spark, os.path.join(src, "part"), fact.schema, FACT_MAPPING,
                     lambda df, epoch: out.append([r.asDict() for r in df.orderBy("segment").collect()]),
                     by=["segment"], checkpoint=tempfile.mkdtemp(prefix="kpiloom-stream-ckpt-"))
    q.processAllAvailable()
    q.stop()
    batch = [r.asDict() for r in kpi_summary(fact, FACT_MAPPING, ["segment"]).orderBy("segment").collect()]
    same = lambda rows: [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    assert out and same(out[-1]) == same(batch)
