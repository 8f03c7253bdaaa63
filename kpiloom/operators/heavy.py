"""D3 for long texts: count, unique, top and freq without moving the values.

A Misra-Gries summary of each partition (at most COUNTERS values, by 128-bit hash, and what it had to take off all of them) says which
values can be the most frequent and how often at most all others occur.  The summaries are added up; the values that can still
be the top are counted exactly in one more scan.  If their best count is above the bound of all others, it is the top; only else are the hashes of
all values counted.  Distinct values are counted by their hashes, so what moves is 16 bytes a value, whatever its length.

Summaries of parts of a table can be kept and added up (``summaries``, ``merged``): sums of lower counts and of errors stay bounds.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import named
from ..session import write_and_read

COUNTERS = 1024  # values in a partition's summary
CANDIDATES = 10_000  # values counted exactly, at most; they are sent to all tasks


def text_hash(c: Column) -> Column:
    """128 bits of a text as two longs."""
    digest = F.md5(c.cast("string"))
    half = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(16)), 16, -10).cast("long")
    return F.struct(half(1).alias("h1"), half(17).alias("h2"))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, h1, h2): the hash of each value; missing values are left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.when(named(c).isNotNull(), text_hash(named(c))).alias("h")) for i, c in enumerate(cols)])
    cell = df.select(F.explode(cells).alias("c")).where("c.h IS NOT NULL")
    return cell.select("c.column", "c.h.h1", "c.h.h2")


def summaries(df: DataFrame, cols: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """(column, h1, h2, low, off): the summaries of all partitions; a row without a hash holds the number of values in ``low`` and the error in ``off``."""
    def work(batches):
        held: dict[int, dict] = {}
        total: dict[int, int] = {}
        off: dict[int, int] = {}
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by(["column", "h1", "h2"]).aggregate([([], "count_all")])
            for column, h1, h2, n in zip(*[rows[c].to_pylist() for c in ("column", "h1", "h2", "count_all")]):
                mine = held.setdefault(column, {})
                mine[h1, h2] = mine.get((h1, h2), 0) + n
                total[column] = total.get(column, 0) + n
            for column, mine in held.items():
                if len(mine) > counters:  # take the (counters + 1)-th largest count off all
                    cut = sorted(mine.values(), reverse=True)[counters]
                    off[column] = off.get(column, 0) + cut
                    held[column] = {k: n - cut for k, n in mine.items() if n > cut}
        out = [(column, None, None, n, off.get(column, 0)) for column, n in total.items()]
        out += [(column, *k, n, 0) for column, mine in held.items() for k, n in mine.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["column", "h1", "h2", "low", "off"])

    import pyarrow as pa

    return _long(df, cols).mapInArrow(work, "column int, h1 long, h2 long, low long, off long")


def merged(parts: DataFrame) -> DataFrame:
    """Summaries added up: one row for each value, and one without a hash for each column."""
    return parts.groupBy("column", "h1", "h2").agg(F.sum("low").alias("low"), F.sum("off").alias("off"))


def profile_texts(df: DataFrame, cols: Sequence[str], counters: int = COUNTERS, candidates: int = CANDIDATES) -> DataFrame:
    """(column, count, unique, top, freq) as ``profile_categorical`` gives them; ties go to the smallest text; without values top and freq are NULL."""
    spark = df.sparkSession
    held = write_and_read(merged(summaries(df, cols, counters)), "heavy-summaries")
    unique = write_and_read(_long(df, cols).distinct().groupBy("column").agg(F.count("*").alias("unique")), "heavy-unique")
    error = F.max(F.when(F.col("h1").isNull(), F.col("off")))
    totals = held.groupBy("column").agg(F.max(F.when(F.col("h1").isNull(), F.col("low"))).alias("count"), error.alias("error"),
                                        F.max(F.when(F.col("h1").isNotNull(), F.col("low"))).alias("best"))
    totals = {r["column"]: r for r in totals.collect()}  # a row for each column
    rest = F.lit(None).cast("long")
    for k, r in totals.items():
        rest = F.when(F.col("column") == k, F.lit((r["best"] or 0) - r["error"])).otherwise(rest)
    able = held.where(F.col("h1").isNotNull() & (F.col("low") >= rest)).select("column", "h1", "h2")
    few = able.groupBy("column").agg(F.count("*").alias("n")).collect()
    per_column = max(1, candidates // max(1, len(cols)))
    open_ = [k for k, r in totals.items() if r["best"] is None]
    open_ += [r["column"] for r in few if r["n"] > per_column]
    sent = [k for k in totals if k not in open_]
    found = _counted(df, cols, able.where(F.col("column").isin(sent))) if sent else None
    best = {r["column"]: r for r in found.collect()} if found is not None else {}
    # nothing outside the candidates reaches more than the error
    sure = {k: r for k, r in best.items() if r["freq"] > totals[k]["error"] or totals[k]["error"] == 0}
    open_ = [k for k in totals if k not in sure]
    if open_:
        sure |= {r["column"]: r for r in _all_counted(df, cols, open_).collect()}
    uniques = {r["column"]: r["unique"] for r in unique.collect()}
    rows = [(c, totals[i]["count"] if i in totals else 0, uniques.get(i, 0), sure[i]["top"] if i in sure else None, sure[i]["freq"] if i in sure else None)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "`column` string, count long, `unique` long, top string, freq long")


def _hashed(df: DataFrame, cols: Sequence[str], some: Sequence[int]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("column"), text_hash(named(cols[i])).alias("h"), named(cols[i]).cast("string").alias("text")) for i in some])
    return df.select(F.explode(cells).alias("c")).where("c.text IS NOT NULL").select("c.column", "c.h.h1", "c.h.h2", "c.text")


def _counted(df: DataFrame, cols: Sequence[str], able: DataFrame) -> DataFrame:
    """The most frequent of the candidates (a bounded table), exactly counted; its text is the smallest of equals."""
    some = sorted(r[0] for r in able.select("column").distinct().collect())
    rows = _hashed(df, cols, some).join(F.broadcast(able), ["column", "h1", "h2"])
    counts = rows.groupBy("column", "h1", "h2").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    return counts.groupBy("column").agg(F.min_by("text", F.struct((-F.col("n")).alias("m"), "text")).alias("top"), F.max("n").alias("freq"))


def _all_counted(df: DataFrame, cols: Sequence[str], some: Sequence[int]) -> DataFrame:
    """The same from the counts of all hashes; only the texts that tie for the top are read again."""
    rows = _hashed(df, cols, some)
    counts = write_and_read(rows.groupBy("column", "h1", "h2").agg(F.count("*").alias("n")), "heavy-counts")
    most = counts.groupBy("column").agg(F.max("n").alias("freq"))
    once = [r["column"] for r in most.collect() if r["freq"] == 1]  # all values tie
    tied = counts.join(F.broadcast(most), "column").where((F.col("n") == F.col("freq")) & ~F.col("column").isin(once)).select("column", "h1", "h2", "freq")
    smallest = rows.join(tied, ["column", "h1", "h2"]).groupBy("column").agg(F.min("text").alias("top"), F.max("freq").alias("freq"))
    first = rows.where(F.col("column").isin(once)).groupBy("column").agg(F.min("text").alias("top"), F.lit(1).cast("long").alias("freq"))
    return smallest.unionByName(first)
