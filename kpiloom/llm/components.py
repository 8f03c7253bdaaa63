"""Connected components of a link table, as Spark jobs.

Alternating large-star / small-star contraction: every round replaces links by
links to the smallest known neighbour, until each component is a star around
its smallest node.  A round is aggregation (partial before the shuffle) plus a
join whose hub side is unique, so a hub with a third of all links is split by
adaptive skew handling; no neighbour list is ever gathered.  Rounds are written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def star_of(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (u, v: long) -> (node, root): one row for every node that is
    not the smallest of its component, ``root`` being that smallest node.

    Self links, repeated links, either direction and null ends are allowed
    (null ends and self links are ignored); an empty table gives no rows."""
    edges = save(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = _state(edges)
    while state[0]:
        edges = save(_small_star(_large_star(edges)), name)
        seen, state = state, _state(edges)
        if seen == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (itself included)."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return (edges.select(F.col("v").alias("u"), F.col("u").alias("big")).join(low, "u")
            .select(F.col("big").alias("u"), F.col("low").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = (edges.join(low, "u").where(F.col("v") != F.col("low"))
             .select(F.col("v").alias("u"), F.col("low").alias("v")))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()
