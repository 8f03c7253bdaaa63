"""Tables that are read whole or not at all."""

import json
import os
import shutil

import pytest

from kpiloom.sources.manifest import MANIFESTS, BrokenTable, manifest_of, read_whole, write_whole


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s", "CASE WHEN id % 3 = 0 THEN NULL ELSE id / 2.0 END AS x")
    path = str(tmp_path / "t")
    return df, path, write_whole(df, path, ["id"], file_bytes=40_000)


def data_files(path, manifest):
    folder = os.path.join(path, manifest["version"])
    return [os.path.join(folder, n) for n in sorted(manifest["files"])]


def test_what_was_written_comes_back_in_ranges(spark, table):
    df, path, manifest = table
    assert read_whole(spark, path).orderBy("id").collect() == df.orderBy("id").collect()
    assert manifest["rows"] == 5000 and len(manifest["files"]) > 3
    assert max(f["rows"] for f in manifest["files"].values()) < 2500
    assert manifest_of(spark, path) == json.loads(json.dumps(manifest))


def test_a_lost_file_is_refused(spark, table):
    _, path, manifest = table
    file = data_files(path, manifest)[0]
    os.remove(file)
    with pytest.raises(BrokenTable, match="missing"):
        read_whole(spark, path)


def test_a_changed_or_added_file_is_refused(spark, table, tmp_path):
    _, path, manifest = table
    first, second = data_files(path, manifest)[:2]
    shutil.copy(second, os.path.join(os.path.dirname(second), "part-more.parquet"))
    with pytest.raises(BrokenTable, match="unlisted"):
        read_whole(spark, path)
    os.remove(os.path.join(os.path.dirname(second), "part-more.parquet"))
    spark.range(3).selectExpr("id", "id AS k", "'x' AS s", "1.0D AS x").coalesce(1).write.parquet(str(tmp_path / "other"))
    (other,) = [n for n in os.listdir(tmp_path / "other") if n.startswith("part")]
    shutil.copy(tmp_path / "other" / other, first)
    crc = os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc")
    os.remove(crc)
    with pytest.raises(BrokenTable, match="other sizes"):
        read_whole(spark, path)


def test_versions_and_a_writer_that_died(spark, table):
    df, path, _ = table
    write_whole(df.where("k = 1"), path)
    df.where("k = 2").write.parquet(os.path.join(path, "half-written"))  # no manifest names it
    assert read_whole(spark, path).where("k <> 1").isEmpty() and read_whole(spark, path, number=1).count() == 5000
    with pytest.raises(BrokenTable, match="no complete version"):
        read_whole(spark, os.path.join(path, "half-written"))
    assert len([n for n in os.listdir(os.path.join(path, MANIFESTS)) if n.endswith(".json")]) == 2


def test_empty_tables(spark, tmp_path):
    df = spark.range(0)
    write_whole(df, str(tmp_path / "e"), ["id"])
    assert read_whole(spark, str(tmp_path / "e")).collect() == []
