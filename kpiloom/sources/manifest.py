"""S4 for reports that arrive whole: staged files and a manifest that makes them visible in one step.

Files are written to a folder of their own, then read back once for their rows and content hashes; the manifest, a small JSON file, is put in
place last by a rename, which stores do in one step.  A reader takes only the files that the newest manifest names, and refuses them if a
file is missing or unlisted, or its rows or content are not what the manifest says.  A writer that dies leaves a folder that no
reader looks into.

File sizes come from a range partitioning by bytes: the table's rows are placed by key, and the number of ranges follows from its size.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import named

FILE_BYTES = 128 * 1024 * 1024
MANIFESTS = "_manifests"


class BrokenTable(ValueError):
    """The files don't match their manifest."""


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _contents(df: DataFrame) -> list[Column]:
    """Rows and an order-free hash of all values: sums of two 64-bit hashes of each row."""
    cells = [named(c) for c in df.columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("string").alias(f"hash{seed}") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("rows"), *sums]


def _listed(df: DataFrame, folder: str) -> dict[str, dict]:
    """What the files of a folder hold, by file name: a row for each file."""
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    found = df.select("*", file.alias("_file"), F.col("_metadata.file_size").alias("_size")).groupBy("_file", "_size").agg(*_contents(df))
    return {r["_file"]: {"rows": r["rows"], "bytes": r["_size"], "hash": f"{r['hash1']}:{r['hash2']}"} for r in found.collect()}


def average_bytes(df: DataFrame) -> float:
    """Bytes of a row as text, on average, for the number of files."""
    return float(df.agg(F.avg(F.length(F.to_json(F.struct(*[named(c) for c in df.columns]))))).first()[0] or 0.0)


def write_whole(df: DataFrame, path: str, order: Sequence[str] = (), file_bytes: int = FILE_BYTES) -> dict:
    """Write a version of a table; returns its manifest.  Rows are dealt to files by ``order`` in ranges of about ``file_bytes``."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{version}"
    rows = df
    if order:
        n = max(1, math.ceil(df.count() * average_bytes(df) / file_bytes))
        rows = df.repartitionByRange(n, *[named(c) for c in order]).sortWithinPartitions(*[named(c) for c in order])
    rows.write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder)
    files = _listed(back, folder)
    fs, where = _fs(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    fs.mkdirs(where)
    number = max([int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")], default=0) + 1
    manifest = {"version": version, "number": number, "schema": json.loads(df.schema.json()), "rows": sum(f["rows"] for f in files.values()), "files": files}
    _put(spark, f"{path.rstrip('/')}/{MANIFESTS}", f"{number:08d}.json", json.dumps(manifest, sort_keys=True))
    return manifest


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file that appears whole or not at all, and replaces none."""
    fs, part = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    _, whole = _fs(spark, f"{folder}/{name}")
    if fs.exists(whole) or not fs.rename(part, whole):
        raise BrokenTable(f"another writer has put {name} in place")


def manifest_of(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The newest manifest of a table, or an earlier one."""
    fs, where = _fs(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []
    wanted = [n for n in names if number is None or int(n.split(".")[0]) == number]
    if not wanted:
        raise BrokenTable(f"no complete version of the table in {path}")
    text = "\n".join(r[0] for r in spark.read.text(f"{path.rstrip('/')}/{MANIFESTS}/{wanted[-1]}").collect())
    return json.loads(text)


def read_whole(spark: SparkSession, path: str, number: int | None = None, contents: bool = True) -> DataFrame:
    """A version of a table, the newest by default, after its files are found to be what the manifest says.

    ``contents`` reads the files once more for their rows and hashes; without it only names and sizes are compared."""
    from pyspark.sql.types import StructType

    manifest = manifest_of(spark, path, number)
    folder = f"{path.rstrip('/')}/{manifest['version']}"
    fs, where = _fs(spark, folder)
    there = {s.getPath().getName(): s.getLen() for s in fs.listStatus(where)} if fs.exists(where) else {}
    data = {n: size for n, size in there.items() if not n.startswith(("_", "."))}
    said = manifest["files"]
    missing = sorted(set(said) - set(data))
    # a file without rows is no part of the manifest
    extra = sorted(n for n in set(data) - set(said) if spark.read.parquet(f"{folder}/{n}").limit(1).count())
    changed = sorted(n for n in set(said) & set(data) if data[n] != said[n]["bytes"])
    if missing or extra or changed:
        raise BrokenTable(f"{folder}: missing {missing}, unlisted {extra}, other sizes {changed}")
    df = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(folder)
    if contents:
        found = _listed(df, folder)
        other = sorted(n for n in said if found.get(n) != said[n])
        if other:
            raise BrokenTable(f"{folder}: other contents in {other}")
    return df
