"""Formats are asked only about texts that may have them, and find the same."""

from pyspark.sql import functions as F

from kpiloom.operators.clean import DATE_FORMATS, _outline, _try_format

VALUES = ["2020-01-05", "2020-1-5", "+12020-01-05", "-2020-01-05", "12020-01-05", "2020-01-05 10:11:12", "2020-01-05T10:11:12", "2020-01-05t10:11:12", "01/05/2020", "13/05/2020",
          "Jan 2020", "JAN 2020", "jan 2020", "2020-01", "20200105", "120200105", "not a date", "", " 2020-01-05", "2020-01-05\n", "2020-02-30", "٢٠٢٠-01-05"]


def test_outlines_lose_no_date(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    assert all(_outline(f) for f in DATE_FORMATS) and _outline("EEE d") is None
    for f in DATE_FORMATS:
        rows = df.select("v", F.try_to_timestamp("v", F.lit(f)).cast("string").alias("want"), _try_format(F.col("v"), f).cast("string").alias("got"), F.col("v").rlike(_outline(f)).alias("asked")).collect()
        assert all(r["want"] == r["got"] for r in rows), f
        assert not [r["v"] for r in rows if r["asked"] and r["v"] == "not a date"]
