"""Embedding near-duplicates by E8 lattice hashing.

Vectors are scaled to length 1 and projected to 8 dimensions, several times
(tables).  In each table a vector lives in the cell of its nearest E8 lattice point,
its home, and probes the neighbouring cells nearest to it.  Vectors that meet in a cell
are compared by cosine in double precision.

Scale: exact copies are one node.  Cells with a single vector are dropped before vectors are
shuffled.  Members of a cell are dealt to blocks of about BLOCK, and each pair of blocks
is one piece of work, so no cell is ever gathered.  A linked pair is counted in one place only (the
first table where it meets), so no list of pairs is kept: pieces give sums for each
node, and links to the smallest node of each linked set.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, save, ship
from .components import star_of

COSINE = 0.95
TABLES, PROBES, STEP, SEED = 6, 4, 0.55, 7  # STEP: the lattice's scale against projected vectors
BLOCK = 512


# --- the lattice -----------------------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring lattice points."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    return np.vstack([out, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    out = np.rint(y)
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    off = y[odd] - out[odd]
    worst = np.abs(off).argmax(axis=1)
    out[odd, worst] += np.where(off[np.arange(len(odd)), worst] > 0, 1, -1)
    return out


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the whole and the half-shifted candidate."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=64)
def _projections(dim: int) -> tuple[np.ndarray, ...]:
    out = []
    for table in range(TABLES):
        m = np.random.default_rng([SEED, dim, table]).standard_normal((dim, 8))
        out.append((np.linalg.qr(m)[0] * np.sqrt(8) if dim >= 8 else m) / STEP)
    return tuple(out)


def _cell(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit name of lattice points (..., 8); a clash only adds candidates."""
    key = np.full(points.shape[:-1], (table * 1_000_003 + dim) & 0xFFFF_FFFF, dtype=np.uint64)
    for k in range(8):
        key = (key ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cells(unit: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, PROBES): in each table the home cell, then the nearest neighbouring cells."""
    n, dim = unit.shape
    out = np.empty((n, TABLES, PROBES), dtype=np.int64)
    for t, m in enumerate(_projections(dim)):
        y = unit @ m
        home = nearest(y)
        step = np.argsort(-((y - home) @ roots().T), axis=1, kind="stable")[:, :PROBES - 1]
        points = np.concatenate([home[:, None, :], home[:, None, :] + roots()[step]], axis=1)
        out[:, t] = _cell(points, t, dim)
    return out


def unit_vectors(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares within range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


# --- one piece of work: a block of members against a block of members at home ----------------------------------------

def _meet(i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(pairs, TABLES): whether the vectors meet in the table; ``at``: their cells."""
    a, b = at[i], at[j]
    return (a[:, :, 0, None] == b).any(axis=2) | (b[:, :, 0, None] == a).any(axis=2)


def linked(node: np.ndarray, copies: np.ndarray, side: np.ndarray, table: int, unit: np.ndarray, cosine: float):
    """(nodes, linked vectors counted here, smallest node linked to in this piece).

    ``side``: 1 member on the left, 2 at home on the right, 3 both (at home)."""
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    i, j = np.nonzero(unit[left] @ unit[right].T >= cosine)
    i, j = left[i], right[j]
    other = node[i] != node[j]
    i, j = i[other], j[other]
    if not len(i):
        return None
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = back[:len(i)], back[len(i):]
    node, copies, at = node[used], copies[used], cells(unit[used])
    low = np.arange(len(used))[np.argsort(np.argsort(node, kind="stable"), kind="stable")]  # ranks by node
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        if (low == before).all():
            break
    smallest = np.sort(node)[low]
    here = _meet(i, j, at).argmax(axis=1) == table
    i, j = i[here], j[here]
    home_i, home_j = at[i, table, 0], at[j, table, 0]
    neighbours = home_i != home_j
    twice = neighbours & (home_i[:, None] == at[j, table]).any(axis=1)  # met in the other's home as well
    keep = ~twice | (node[i] < node[j])
    i, j, neighbours = i[keep], j[keep], neighbours[keep]
    count = np.bincount(i, copies[j], minlength=len(used)) + np.bincount(j[neighbours], copies[i[neighbours]], minlength=len(used))
    return node, count.astype(np.int64), smallest


# --- Spark -----------------------------------------------------------------------------------------------------------

def _valid(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dim(column: pa.Array):
    """(rows, matrix) for each length of the lists."""
    sizes = np.asarray(column.value_lengths())
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, _matrix(column.take(pa.array(at)))


def _members(nodes: DataFrame) -> DataFrame:
    """(cell, home, node, table): where each node lives and probes."""
    def work(batches):
        for b in batches:
            for at, m in _by_dim(b.column(1)):
                found = cells(unit_vectors(m)).reshape(-1)
                per = TABLES * PROBES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.arange(len(found)) % PROBES == 0), b.column(0).take(pa.array(np.repeat(at, per))),
                     pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), PROBES), len(at)))], names=["cell", "home", "node", "table"])

    return nodes.select("node", "vector").mapInArrow(work, "cell long, home boolean, node long, table int")


def _pieces(members: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Members of cells where a pair can meet, dealt to pieces (cell, lb, rb), with their vectors."""
    sizes = (members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home"))
             .where("n > 1 and n_home > 0"))
    rows = members.join(sizes, "cell").join(nodes.select("node", "copies", "vector"), "node")
    lefts, rights = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("n_home") / block).cast("int")
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), blocks - 1)
    whole = F.array(F.struct(F.lit(0).alias("lb"), F.lit(0).alias("rb"), F.when(F.col("home"), 3).otherwise(1).alias("side")))
    as_left = F.transform(every(rights), lambda r: F.struct(own(lefts).alias("lb"), r.alias("rb"), F.lit(1).alias("side")))
    as_right = F.when(F.col("home"), F.transform(every(lefts), lambda x: F.struct(x.alias("lb"), own(rights).alias("rb"), F.lit(2).alias("side"))))
    split = F.concat(as_left, F.coalesce(as_right, F.array().cast("array<struct<lb:int,rb:int,side:int>>")))
    places = F.when((lefts == 1) & (rights == 1), whole).otherwise(split)
    return rows.withColumn("p", F.explode(places)).select("cell", "p.lb", "p.rb", "p.side", "table", "node", "copies", "vector")


def _whole_groups(batches, keys: list[str]):
    """Arrow tables of whole groups of rows that follow one another with equal keys."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
        if not len(t):
            continue
        k = np.stack([t[c].to_numpy() for c in keys])
        starts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)])
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s > 1:
                yield t.slice(s, e - s)
        rest = t.slice(int(starts[-1]))
    if rest is not None and len(rest) > 1:
        yield rest


def _compare(pieces: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root): for each piece the linked vectors counted there and the smallest node reached there."""
    def group(t: pa.Table):
        vectors = t["vector"].combine_chunks()
        side = t["side"].to_numpy()
        for at, m in _by_dim(vectors):
            found = linked(t["node"].to_numpy()[at], t["copies"].to_numpy()[at], side[at], int(t["table"][int(at[0])].as_py()), unit_vectors(m), cosine)
            if found:
                yield found

    def work(batches):
        ready: list = []
        for t in _whole_groups(batches, ["cell", "lb", "rb"]):
            ready += group(t)
            if sum(len(x[0]) for x in ready) > 50_000:
                yield _links(ready)
                ready = []
        if ready:
            yield _links(ready)

    dealt = pieces.repartition("cell", "lb", "rb").sortWithinPartitions("cell", "lb", "rb")
    return dealt.mapInArrow(work, "node long, links long, root long")


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)], names=["node", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors of different lengths never link; nor do vectors that are null, zero, empty or hold
    null or non-finite components.  Copies are linked vectors.  A null id
    takes part but names a component only if all its ids are null;
    ``kept`` is true for each row whose id names its component, repeated rows included;
    an empty table gives no rows; other columns are not read, whatever their names."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector"))
    good = rows.where(_valid(F.col("vector")))
    nodes = good.groupBy("vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    met = save(_compare(_pieces(_members(nodes), nodes, block), cosine), "lattice-links")
    star = star_of(met.select(F.col("node").alias("u"), F.col("root").alias("v")), "lattice-components")
    sums = met.groupBy("node").agg(F.sum("links").alias("links"))
    facts = (nodes.select("node", "low", "copies").join(sums, "node", "left").join(star, "node", "left")
             .select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    facts = save(facts, "lattice-facts")
    names = facts.groupBy("root").agg(F.min("low").alias("component_id"))
    named = save(facts.join(names, "root").select("node", "n_links", "component_id"), "lattice-named")
    of_vector = nodes.select("vector", "node").join(named, "node").select(F.col("vector").alias("v"), "n_links", "component_id", F.lit(True).alias("good"))
    out = rows.join(of_vector, rows["vector"] == of_vector["v"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
