"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles.  Two fingerprints at most ``radius`` bits apart share a point at most
``radius / 2`` (rounded up) bits from each, so every distinct fingerprint emits all
variants within that distance; fingerprints that meet at a variant are
verified by their bit distance.

Scale: variants are emitted for distinct fingerprints only, so a group of exact
copies costs one row.  With radius 2 at most 65 fingerprints can meet at one
variant, so no group grows with the data.  In a group each member links to
the smallest (for an even radius any two members are within the radius of each
other, so this loses no component); components come from ``components.star_of``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quoted, save, ship
from .components import star_of

BITS = 64
SEED = 42  # Fixed value: the hash seed.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text (null and wordless texts: 0).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a
    text of fewer words than ``shingle`` is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        octets = hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long): one row for each input row."""
    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fingerprint"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fingerprint", T.LongType())])
    return rows.mapInArrow(work, schema)


def _masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ceil(radius / 2) bits, as signed longs."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``fingerprint`` rows -> (u, v): verified links that join exactly
    the fingerprints which chains of at most ``radius`` bits join."""
    fp = F.col("fingerprint")
    variants = distinct.select(fp, F.explode(F.array(*[fp.bitwiseXOR(F.lit(m)) for m in _masks(radius)])).alias("variant"))
    group = Window.partitionBy("variant")
    if radius % 2 == 0:
        met = variants.withColumn("v", F.min("fingerprint").over(group)).select(F.col("fingerprint").alias("u"), "v")
    else:
        # an odd radius rounds half of it up: members of a group may be one bit too far apart, so all pairs are tried;
        # a group has at most as many members as there are masks
        met = (variants.withColumn("all", F.collect_list("fingerprint").over(group))
               .select(F.col("fingerprint").alias("u"), F.explode("all").alias("v")))
    return met.where(F.col("u") > F.col("v")).where(distance(F.col("u"), F.col("v")) <= radius)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id of the rows whose fingerprints links
    reach.  Null texts count as empty (fingerprint 0, linked like any other); a
    null id takes part but never names a component unless all its ids are null;
    repeated rows are rows of the same component; an empty table gives no
    rows; other columns are not read, whatever their names."""
    rows = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _named(rows, radius).select("fingerprint", "component_id")
    return rows.join(named, "fingerprint", "left").select("id", "fingerprint", "component_id")


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints -> (fingerprint, low: smallest id that has it, root, component_id)."""
    own = save(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), "distinct-fingerprints")
    star = star_of(links(own.select("fingerprint"), radius), "simhash-links")
    rooted = (own.join(star.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
              .select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(names, "root").select("fingerprint", "low", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """The documents that stay: of each component the row with the smallest id.

    Same columns as ``docs``.  Where several rows qualify (repeated rows, or a
    component whose ids are all null) the smallest by all columns stays."""
    rows = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    stay = save(_named(rows, radius).where(F.col("low").eqNullSafe(F.col("component_id")))
                .groupBy("root").agg(F.min("component_id").alias("id"), F.min("fingerprint").alias("fingerprint"))
                .drop("root"), "simhash-stay")
    twice = save(rows.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).select("id"), "simhash-twice")
    key, one = quoted(id_col), free_name(docs, "only")
    if twice.isEmpty():
        ids = stay.select(F.col("id").alias(one))
        return docs.join(ids, docs[key] == ids[one], "left_semi")
    ids = stay.join(twice, "id", "left_anti").where(F.col("id").isNotNull()).select(F.col("id").alias(one))
    once = docs.join(ids, docs[key] == ids[one], "left_semi")
    return once.union(_of_repeated(docs, twice, stay, key, text_col, shingle))


def _of_repeated(docs: DataFrame, twice: DataFrame, stay: DataFrame, key: str, text_col: str, shingle: int) -> DataFrame:
    """Rows that stay among those whose id is null or repeated: one for each id and fingerprint asked for."""
    mark = F.udf(lambda x: int(np.uint64(fingerprint(x, shingle)).view(np.int64)), T.LongType())
    rows = docs.select(F.col(key).alias("id"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("r"),
                       F.col(quoted(text_col)).alias("text"))
    some = rows.join(twice, rows["id"].eqNullSafe(twice["id"]), "left_semi").select("id", mark("text").alias("fingerprint"), "r")
    same = some["id"].eqNullSafe(stay["id"]) & (some["fingerprint"] == stay["fingerprint"])
    return some.join(stay, same, "left_semi").groupBy("id", "fingerprint").agg(F.min("r").alias("r")).select("r.*")
