"""Spark session helpers.

Everything in the library works on any ``SparkSession``; these helpers only
pin the settings the results depend on (UTC clock, ANSI arithmetic) and the
ones that matter for large runs (AQE, skew-join handling, size-checked
broadcasts).  A caller on a cluster keeps its own session: we only fill in a
checkpoint folder where the cluster did not name one.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that decide results (not only speed).
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for large inputs.  Broadcasts stay behind Spark's own size check
# (autoBroadcastJoinThreshold, measured at run time by AQE).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kpiloom", extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for k, v in {**RESULT_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-deciding settings to an existing session, for good: plans built from it run later."""
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables and checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``.  Only where none is set and the
    master is ``local`` do we create one, and register it so ``checkpoint()``
    works too; a cluster without one is an error, because its executors don't share local folders.
    What is written there stays until the cluster's own clean-up of that folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="kpiloom-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared folder."""
    base = shared_dir(spark)
    if not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", base):
        base = os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_and_read(df, name: str):
    """Write an intermediate to the shared folder and read it back: lineage is
    cut, and later joins know its true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Write a small intermediate (e.g. a fact cube with several consumers) to
    the shared checkpoint folder and read it back: one computation, lineage
    cut, and it survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once for each application), as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-py-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


@contextlib.contextmanager
def stable_splits(spark: SparkSession):
    """Files are cut into the same splits by all that runs inside, also when executors come or go."""
    key = "spark.sql.files.minPartitionNum"
    given = spark.conf.get(key, None)
    if given is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(key)
