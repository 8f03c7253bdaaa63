"""Quartiles from merged sketches against sorted values."""

from random import Random

from pyspark.sql import functions as F

from kpiloom.operators import sketches as S


def test_merged_parts_keep_to_the_error(spark):
    rng = Random(6)
    rows = [(k % 30, rng.choice("ab"), rng.gauss(0, 1) if k % 3 else float(k % 5)) for k in range(40_000)] + [(1, "a", None), (2, "b", float("nan"))]
    df = spark.createDataFrame(rows, "day int, seg string, x double").repartition(7)
    parts = S.sketch_parts(df, ["x"], ["day", "seg"], 400)
    for keep in ([], ["seg"]):
        for r in S.profile_sketched(parts, keep).collect():
            own = sorted(v for _, seg, v in rows if v is not None and v == v and (not keep or seg == r["seg"]))
            assert (r["count"], r["min"], r["max"]) == (len(own), own[0], own[-1]) and abs(r["mean"] - sum(own) / len(own)) < 1e-9
            for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
                below, up_to = sum(v < r[name] for v in own), sum(v <= r[name] for v in own)
                assert below <= (q + S.rank_error(400)) * len(own) and up_to >= (q - S.rank_error(400)) * len(own)
    ranks = S.ranks_of(df, S.profile_sketched(parts), ["x"], 400).collect()
    assert [r["stat"] for r in ranks] == ["p25", "p50", "p75"] and all(r["within"] for r in ranks)


def test_small_parts_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 3.0), (2, None)], "day int, x double")
    got = {r["day"]: r for r in S.profile_sketched(S.sketch_parts(df, ["x"], ["day"]), ["day"]).collect()}
    assert (got[1]["p50"], got[1]["count"]) == (3.0, 3) and (got[2]["p50"], got[2]["count"], got[2]["mean"]) == (None, 0, None)
    later = S.refreshed_parts(S.sketch_parts(df, ["x"], ["day"]), S.sketch_parts(df.withColumn("day", F.lit(3)), ["x"], ["day"]))
    assert S.profile_sketched(later).first()["count"] == 6
    assert S.profile_sketched(S.sketch_parts(df.limit(0), ["x"], ["day"])).collect() == []
