"""CSV files against the standard library's reader, with splits of a few bytes."""

import csv
import io
from pathlib import Path
from random import Random

import pytest

from kpiloom.sources.csv import load_csv, merged_types, column_types, read_csv, values_of
from kpiloom.session import shared_dir
from kpiloom.sources import records
from kpiloom.sources.records import records_of
from pyspark.sql import functions as F


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(rows, ends, rng):
    """CSV text of rows, values quoted where they must be and at random elsewhere."""
    out = []
    for row in rows:
        cells = []
        for v in row:
            must = v[:1] == '"' or any(c in v for c in ',\n\r') or v == ""
            cells.append('"' + v.replace('"', '""') + '"' if must or rng.random() < 0.3 else v)
        out.append(",".join(cells) + ends)
    return "".join(out)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, tiny_splits, ends):
    rng = Random(1)
    words = ["a", "b,c", 'say "hi"', '"', '""', "line\nfeed", "\n", "\n\n", "x\r\ny", " sp ", "é😀", "1", ""]
    want = []
    for n in range(3):
        rows = [["k", "v", "w"]] + [[f"{n}-{k}", *("".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(2))] for k in range(60)]
        (tmp_path / f"f{n}.csv").write_bytes(written(rows, ends, rng).encode())
        want += rows[1:]
        assert list(csv.reader(io.StringIO(written(rows, ends, Random(9)), newline=""))) == rows  # the test's own writer is sound
    records = records_of(spark, str(tmp_path))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(list(r["v"]) for r in records.where("number > 1").select(values_of(F.col("record")).alias("v")).collect())
    assert got == sorted(want)
    numbers = records.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.max("number").alias("m")).collect()
    assert [(r["n"], r["d"], r["m"]) for r in numbers] == [(61, 61, 61)] * 3


def test_a_value_longer_than_many_splits(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {k}, \"quoted\"" for k in range(80))
    (tmp_path / "f.csv").write_text(written([["k", "v"], ["1", long], ["2", "b"], ["3", long + "\n"], ["4", "d"]], "\n", Random(2)))
    got = {r["k"]: r["v"] for r in load_csv(spark, str(tmp_path)).collect()}
    assert got == {1: long, 2: "b", 3: long + "\n", 4: "d"}


def test_types_and_missing_values(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "﻿id,id,code,hex,big,huge,flag,num,gap,sci\n"
        "1,a,12d,0x1,123456789012345678901,1" + "0" * 40 + ",True,1.5,NA,1e3\n"
        "   \t\n"
        "2,b,7f,2,-5,1,FALSE,+2,,inf\n"
        "3,NULL,3D,,N/A,2,true, 3 ,nan,-.5e-2\n")
    rows = load_csv(spark, str(tmp_path))
    assert dict(rows.dtypes) == {"id": "bigint", "id.1": "string", "code": "string", "hex": "string", "big": "decimal(38,0)", "huge": "double",
                                 "flag": "boolean", "num": "double", "gap": "double", "sci": "double"}
    got = {r["id"]: r for r in rows.collect()}
    assert [got[k]["code"] for k in (1, 2, 3)] == ["12d", "7f", "3D"]
    assert got[1]["big"] == 123456789012345678901 and got[3]["big"] is None
    assert [got[k]["sci"] for k in (1, 2, 3)] == [1000.0, float("inf"), -0.005] and got[3]["num"] == 3.0 and got[2]["flag"] is False


def test_bad_rows_fail_or_go_to_the_ledger(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,2\n3\n4,5,6\n"x,1\n2,y\n')
    with pytest.raises(ValueError, match="2 bad rows"):
        load_csv(spark, str(tmp_path))
    table = read_csv(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in table.rows.collect() if r["b"]) == [(1, 2)]
    ledger = {r["number"]: (r["reason"], r["kept"], r["record"]) for r in table.ledger.collect()}
    assert ledger == {3: ("too few values", True, "3"), 4: ("too many values", False, "4,5,6"), 5: ("quote not closed", False, '"x,1\n2,y\n')} or \
        sorted(v[:2] for v in ledger.values()) == [("quote not closed", False), ("too few values", True), ("too many values", False)]
    assert load_csv(spark, str(tmp_path), on_bad="skip").count() == 2


def test_headers_and_empty_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "f.csv").write_text("x,y\n")
    assert load_csv(spark, str(tmp_path / "a")).collect() == []
    (tmp_path / "b" / "f.csv").write_text("")
    with pytest.raises(ValueError, match="no columns"):
        load_csv(spark, str(tmp_path / "b"))
    (tmp_path / "c" / "f.csv").write_text("x\n1\n")
    (tmp_path / "c" / "g.csv").write_text("y\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        load_csv(spark, str(tmp_path / "c"))


def test_type_evidence_adds_up(spark):
    df = spark.createDataFrame([("1", "True"), ("2", "x"), (None, "False"), ("99999999999999999999", None)], "a string, b string")
    whole = {r["column"]: r for r in column_types(df).collect()}
    parts = column_types(df.where("b = 'x'")).unionByName(column_types(df.where("b <> 'x' OR b IS NULL")))
    assert {r["column"]: r for r in merged_types(parts).collect()} == whole
    assert (whole["a"]["type"], whole["a"]["not_long"], whole["b"]["type"]) == ("decimal(38,0)", "99999999999999999999", "string")


def test_splits_are_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PART_BITS", 2)
    rows = [["k", "v"]] + [[str(k), "a\nb\n\nc" if k % 3 else "x,\"y\""] for k in range(40)] + [["40", "\n" * 30]]
    (tmp_path / "f.csv").write_text(written(rows, "\n", Random(4)))
    found = records_of(spark, str(tmp_path))
    assert sorted(found.select("number").toPandas()["number"]) == list(range(1, 43))
    assert sorted(list(r["v"]) for r in found.where("number > 1").select(values_of(F.col("record")).alias("v")).collect()) == sorted(rows[1:])


def test_values_are_stored_once(spark, tmp_path):
    """Lines and records leave no copies in the shared folder, only the values (findings F1 to F3 of round 4)."""
    rng = Random(7)
    rows = [["k", "v"]] + [[str(k), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789\n", k=2000))] for k in range(500)]
    (tmp_path / "f.csv").write_text(written(rows, "\n", Random(4)))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = held()
    assert load_csv(spark, str(tmp_path)).count() == 500
    assert held() - before < 1.5 * (tmp_path / "f.csv").stat().st_size


def test_headers_over_several_splits_and_odd_bytes(spark, tmp_path, tiny_splits):
    text = b"\xef\xbb\xbf" + b"\n \r\n\t\n" * 20 + b'k,"a\nlong header\nof several lines and many more words"\r\n1,"x\xff\r\ny"\r\n2\r\n3,"a\rb"\r\n4,"c""d"tail"s"\r\n5,\xc3\xa9"q"\n'
    (tmp_path / "f.csv").write_bytes(text)
    table = read_csv(spark, str(tmp_path))
    assert table.rows.columns == ["k", "a\nlong header\nof several lines and many more words"]
    assert {r[0]: r[1] for r in table.rows.collect()} == {1: "x�\r\ny", 2: None, 3: "a\rb", 4: 'c"dtail"s"', 5: 'é"q"'}
    assert [(r["number"], r["reason"], r["record"]) for r in table.ledger.collect()] == [(3, "too few values", "2")]
