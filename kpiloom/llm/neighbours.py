"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from random cells (signs of random projections; cells above LEAF vectors are dealt out) in several
tables: each vector's best neighbours in its cells.  Then rounds of NN-descent: every vector introduces its neighbours, and those that have it as a
neighbour, to each other; whoever is nearer than the worst of somebody's K neighbours takes its place.  Pairs that met
before are not tried again (neighbours are fresh once), and a round takes SAMPLE fresh ones each way.  A search keeps a beam of the BEAM
best vectors found, looks at the neighbours of the best EXPAND not yet expanded, and ends when the whole beam is expanded.  The nearest found are
measured again in double precision.

Nearness is the largest inner product.  The graph is built on vectors divided by the largest norm, with one more component that makes
their norm 1, so that a vector of large norm is not everybody's neighbour; searches use the vectors as they are.

Scale: equal vectors are one node with its ``k + 1`` smallest ids, so a group of copies costs nothing.  Introductions are joins of neighbours of
neighbours: nodes are dealt to blocks by hash, and a block gets each vector that it needs once, however many of its nodes name it.  Lists of those who
name a node are cut to SAMPLE by hash before they move, so no group grows with the data.  Rounds are written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, save, ship

K = 32  # neighbours of a node in the graph
TABLES, LEAF = 4, 2048  # random cells: tables, and vectors compared at once
SAMPLE, ROUNDS, SETTLED = 12, 5, 0.01  # fresh neighbours introduced each way; rounds, and the share of changed neighbours below which they end
BEAM, EXPAND, STEPS = 160, 64, 40  # of a search
BLOCK = 8192  # nodes dealt to a block, about
LEAST_BLOCKS = 8
SEED = 11
ENTRIES = 64  # nodes where searches for vectors outside the table start

_NEAR = "node long, ids array<long>, sims array<float>, state array<tinyint>"
OLD, WAITING, FRESH = 0, 1, 2  # neighbours introduced before, not yet taken, and to be introduced in the next round


# -- arrays -------------------------------------------------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _list(offsets: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _offsets(of: np.ndarray, n: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(of, minlength=n))]


def _ranked(of: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (of, by...), and each place's rank within its ``of``."""
    order = np.lexsort((*by[::-1], of))
    o = of[order]
    starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, dtype=np.int64)
    return order, np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)]))


def _best(of: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int, state: np.ndarray | None = None):
    """Of each ``of`` the most similar ids, each once (the one of lower state), ties to the smaller id."""
    state = np.zeros(len(of), dtype=np.int8) if state is None else state
    order = np.lexsort((state, ids, of))
    of, ids, sims, state = of[order], ids[order], sims[order], state[order]
    once = np.r_[True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])] if len(of) else np.zeros(0, dtype=bool)
    of, ids, sims, state = of[once], ids[once], sims[once], state[once]
    order, rank = _ranked(of, -sims, ids)
    order = order[rank < most]
    return of[order], ids[order], sims[order], state[order]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two ids, for draws that are the same in every run."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(8)


# -- nodes --------------------------------------------------------------------------------------------------------------

def _valid(v: Column) -> Column:
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, usable) & F.exists(v, lambda x: x != 0)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(id, vector) -> (node, vector, ids, dim, block, unit): each distinct usable vector once, with its k + 1 smallest ids."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last()))
    few = rows.where(_valid(F.col("vector"))).withColumn("at", place).where(F.col("at") <= k + 1)
    own = few.groupBy("vector").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    nodes = save(own.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector").cast("long")), "ann-vectors")
    square = F.aggregate(F.col("vector"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top = nodes.agg(F.count("*"), F.max(square)).first()
    blocks = max(LEAST_BLOCKS, math.ceil(n / BLOCK))
    scale = F.lit(math.sqrt(top or 1.0))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - square / F.lit(top or 1.0)))
    unit = F.concat(F.transform("vector", lambda x: (x.cast("double") / scale).cast("float")), F.array(rest.cast("float")))
    return save(nodes.select("*", _block("node", "dim", blocks).alias("block"), unit.alias("unit")), "ann-nodes")


def _block(node: str, dim: str, blocks: int) -> Column:
    return F.col(dim) * blocks + F.pmod(F.xxhash64(node), F.lit(blocks))


# -- blocks of rows in a task -------------------------------------------------------------------------------------------

def _by_block(vectors: DataFrame, rows: DataFrame, task, schema: str) -> DataFrame:
    """``task(ids, matrix, values, rows)`` for each block: its ``vectors`` (block, node, vector, value), then its ``rows`` in Arrow batches."""
    wide = vectors.select("block", F.lit(0).alias("kind"), "node", "vector", "value", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "block"])
    names = [c for c in rows.columns if c != "block"]
    tall = rows.select("block", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in vectors.dtypes if c != "block"], *names)
    both = wide.unionByName(tall).repartition("block").sortWithinPartitions("block", "kind")

    def blocks(batches):
        for b in batches:
            key = b.column("block").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    yield int(key[s]) // 2, int(key[s]) % 2, b.slice(s, e - s)

    def run(batches):
        stream = blocks(batches)
        part = next(stream, None)
        while part:
            at, held, tail = part[0], [], []
            while part and part[0] == at and part[1] == 0:
                held.append(part[2])
                part = next(stream, None)

            def rest():
                nonlocal part
                while part and part[0] == at:
                    yield part[2]
                    part = next(stream, None)

            tail = rest()
            if held:
                ids = np.concatenate([h.column("node").to_numpy() for h in held])
                order = np.argsort(ids)
                matrix = np.concatenate([_matrix(h.column("vector")) for h in held])[order]
                value = np.concatenate([h.column("value").to_numpy() for h in held])[order]
                held.clear()
                yield from task(ids[order], matrix, value, tail)
            for _ in tail:
                pass

    return both.mapInArrow(run, schema)


# -- the graph ----------------------------------------------------------------------------------------------------------

def _cells(nodes: DataFrame, tables: int, leaf: int) -> DataFrame:
    """(cell, part, node, unit): nodes in the random cells of each table, dealt out where a cell holds more than ``leaf``.

    One more table has a single cell, so that no node is left alone."""
    def work(batches):
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                m = _matrix(b.column(1).take(pa.array(at)))
                normals = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), tables * bits)).astype(np.float32)
                signs = (m @ normals > 0).reshape(len(at), tables, bits)
                key = np.zeros((len(at), tables + 1), dtype=np.int64)
                key[:, :tables] = (signs << np.arange(bits)).sum(axis=2)
                key += (int(dim) * (tables + 1) + np.arange(tables + 1)) << bits
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), b.column(0).take(pa.array(np.repeat(at, tables + 1)))], names=["cell", "node"])

    bits = max(0, math.ceil(math.log2(max(1, nodes.count()) / leaf)))
    keys = save(nodes.select("node", "unit").mapInArrow(work, "cell long, node long"), "ann-cells")
    parts = save(keys.groupBy("cell").agg(F.ceil(F.count("*") / leaf).alias("parts")), "ann-cell-sizes")
    dealt = keys.join(parts, "cell").select("cell", F.pmod(F.xxhash64("node", "cell"), F.col("parts")).alias("part"), "node")
    return dealt.join(nodes.select("node", "unit"), "node")


def _start(nodes: DataFrame, k: int, tables: int, leaf: int) -> DataFrame:
    """Each node's best neighbours in its cells: (node, ids, sims, state)."""
    def group(ids, m):
        n = len(ids)
        most = min(k, n - 1)
        for s in range(0, n if most > 0 else 0, 512):
            sims = m[s:s + 512] @ m.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -np.inf
            at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            count = len(sims)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[s:s + count]), _list(np.arange(count + 1) * most, ids[at].reshape(-1), pa.int64()),
                 _list(np.arange(count + 1) * most, np.take_along_axis(sims, at, 1).reshape(-1), pa.float32()),
                 _list(np.arange(count + 1) * most, np.full(count * most, WAITING, dtype=np.int8), pa.int8())], names=["node", "ids", "sims", "state"])

    def work(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            if not len(t):
                continue
            key = np.stack([t["cell"].to_numpy(), t["part"].to_numpy()])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for s, e in zip(starts, starts[1:]):
                yield from group(t["node"].to_numpy()[s:e], _matrix(t["unit"].slice(s, e - s).combine_chunks()))
            rest = t.slice(starts[-1])
        if rest is not None:
            yield from group(rest["node"].to_numpy(), _matrix(rest["unit"].combine_chunks()))

    dealt = _cells(nodes, tables, leaf).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.select("cell", "part", "node", "unit").mapInArrow(work, _NEAR)


def _merge(found: DataFrame, k: int, sample: int) -> DataFrame:
    """Rows of ``_NEAR`` -> each node's k best; ``sample`` of the waiting ones become fresh."""
    def work(batches):
        for b in batches:
            lists = b.column("lists")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            ids, sims, state = (flat.field(c) for c in ("ids", "sims", "state"))
            of = np.repeat(row, np.asarray(ids.value_lengths()))
            of, ids, sims, state = _best(of, ids.flatten().to_numpy(), sims.flatten().to_numpy(), k, state.flatten().to_numpy())
            node = b.column("node").to_numpy()
            open_ = np.flatnonzero(state != OLD)
            order, rank = _ranked(of[open_], _mixed(node[of[open_]], ids[open_]))
            state = np.where(state == OLD, OLD, WAITING).astype(np.int8)
            state[open_[order[rank < sample]]] = FRESH
            cuts = _offsets(of, len(node))
            yield pa.RecordBatch.from_arrays([b.column("node"), _list(cuts, ids, pa.int64()), _list(cuts, sims, pa.float32()), _list(cuts, state, pa.int8())],
                                             names=["node", "ids", "sims", "state"])

    lists = found.groupBy("node").agg(F.collect_list(F.struct("ids", "sims", "state")).alias("lists"))
    return lists.mapInArrow(work, _NEAR)


def _introduced(graph: DataFrame, sample: int) -> DataFrame:
    """(node, fresh, old): whom each node introduces: its neighbours, and a sample of those who name it."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "state")).alias("e")).select(
        F.col("node").alias("who"), F.col("e.ids").alias("named"), (F.col("e.state") == FRESH).alias("fresh"), F.col("e.state").alias("state"))
    edges = edges.where(F.col("state") != WAITING)
    place = F.row_number().over(Window.partitionBy("named", "fresh").orderBy(F.xxhash64("who", "named"), "who"))
    back = edges.withColumn("at", place).where(F.col("at") <= sample)
    back = back.groupBy("named").agg(F.collect_list(F.when(F.col("fresh"), F.col("who"))).alias("f"), F.collect_list(F.when(~F.col("fresh"), F.col("who"))).alias("o"))
    own = lambda state: F.transform(F.filter(F.arrays_zip("ids", "state"), lambda e: e["state"] == state), lambda e: e["ids"])
    none = F.array().cast("array<long>")
    fresh = F.array_union(own(FRESH), F.coalesce("f", none))
    return (graph.join(back, graph["node"] == back["named"], "left").select("node", fresh.alias("fresh"), F.array_union(own(OLD), F.coalesce("o", none)).alias("o"))
            .where(F.size("fresh") > 0).select("node", "fresh", F.array_except("o", "fresh").alias("old")))


def _padded(ids: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of listed ids among ``ids`` as a matrix of one row per list, and which of its cells are used."""
    sizes = np.asarray(lists.value_lengths())
    at = np.searchsorted(ids, lists.flatten().to_numpy())
    used = np.arange(max(1, sizes.max(initial=0))) < sizes[:, None]
    out = np.zeros(used.shape, dtype=np.int64)
    out[used] = at
    return out, used


def _propose(ids, m, worst, batches, k: int):
    """The k nearest of the nearer vectors for the nodes of a block, from the introductions of its ``batches``."""
    held: list[tuple] = []
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            left, left_used = _padded(ids, part.column("fresh"))
            old, old_used = _padded(ids, part.column("old"))
            right, right_used = np.concatenate([left, old], axis=1), np.concatenate([left_used, old_used], axis=1)
            sims = np.einsum("nid,njd->nij", m[left], m[right], optimize=True)
            ok = left_used[:, :, None] & right_used[:, None, :] & (left[:, :, None] != right[:, None, :])
            ok &= sims > np.minimum(worst[left][:, :, None], worst[right][:, None, :])
            n, i, j = np.nonzero(ok)
            x, y, v = left[n, i], right[n, j], sims[n, i, j]
            x, y, v = np.r_[x, y], np.r_[y, x], np.r_[v, v]
            nearer = v > worst[x]
            held.append((x[nearer], y[nearer], v[nearer]))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held = [_best(*(np.concatenate(c) for c in zip(*held)), k)[:3]]
    if held:
        x, y, v, _ = _best(*(np.concatenate(c) for c in zip(*held)), k)
        nodes, first, count = np.unique(x, return_index=True, return_counts=True)
        for s in range(0, len(nodes), 10_000):
            f, c = first[s:s + 10_000], count[s:s + 10_000]
            at = slice(f[0], f[-1] + c[-1])
            cuts = np.r_[f, f[-1] + c[-1]] - f[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[nodes[s:s + 10_000]]), _list(cuts, ids[y[at]], pa.int64()), _list(cuts, v[at], pa.float32()),
                 _list(cuts, np.full(cuts[-1], WAITING, dtype=np.int8), pa.int8())], names=["node", "ids", "sims", "state"])


def neighbour_graph(nodes: DataFrame, k: int = K, rounds: int = ROUNDS, sample: int = SAMPLE, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """``nodes_of`` -> (node, ids, sims, state): about the k nearest other nodes of each, nearest first."""
    graph = save(_merge(_start(nodes, k, tables, leaf), k, sample), "ann-graph")
    size = F.size("ids").cast("long")
    for _ in range(rounds):
        names = save(_introduced(graph, sample).join(nodes.select("node", "block"), "node").select("block", "node", "fresh", "old"), "ann-introduced")
        wanted = names.select("block", F.explode(F.concat("fresh", "old")).alias("node")).distinct()
        worst = graph.select("node", F.when(F.size("ids") >= k, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("value"))
        vectors = wanted.join(nodes.select("node", F.col("unit").alias("vector")), "node").join(worst, "node").select("block", "node", "vector", "value")
        near = _by_block(vectors, names.select("block", F.col("node").alias("v"), "fresh", "old"), lambda i, m, w, b: _propose(i, m, w, b, k), _NEAR)
        before = graph.select("node", "ids", "sims", F.transform("state", lambda s: F.when(s == FRESH, OLD).otherwise(s).cast("tinyint")).alias("state"))
        graph = save(_merge(before.unionByName(near), k, sample), "ann-graph")
        new = F.size(F.filter("state", lambda s: s != OLD)).cast("long")
        total, changed = graph.agg(F.sum(size), F.sum(new)).first()
        if not total or changed < SETTLED * total:
            break
    return graph


def links(graph: DataFrame, k: int = K) -> DataFrame:
    """(node, near): a node's neighbours and at most k of those who name it."""
    edges = graph.select(F.col("node").alias("who"), F.explode("ids").alias("named"))
    place = F.row_number().over(Window.partitionBy("named").orderBy(F.xxhash64("who", "named"), "who"))
    back = edges.withColumn("at", place).where(F.col("at") <= k).groupBy("named").agg(F.collect_list("who").alias("back"))
    both = graph.join(back, graph["node"] == back["named"], "left")
    return save(both.select("node", F.array_union("ids", F.coalesce("back", F.array().cast("array<long>"))).alias("near")), "ann-links")


# -- searches -----------------------------------------------------------------------------------------------------------

def _scores(ids, m, _, batches, beam: int):
    """Best of the asked ids by inner product, for each asker of a block."""
    for b in batches:
        asked = b.column("asked")
        of = np.repeat(np.arange(b.num_rows), np.asarray(asked.value_lengths()))
        wanted = asked.flatten().to_numpy()
        at = np.searchsorted(ids, wanted)
        q, floor = _matrix(b.column("wish")), b.column("floor").to_numpy()
        sims = np.concatenate([np.einsum("nd,nd->n", m[at[s:s + 65536]], q[of[s:s + 65536]]) for s in range(0, len(at), 65536)] or [np.zeros(0, np.float32)])
        good = sims > floor[of]
        of, found, sims, _ = _best(of[good], wanted[good], sims[good], beam)
        cuts = _offsets(of, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("q"), _list(cuts, found, pa.int64()), _list(cuts, sims, pa.float32())], names=["q", "ids", "sims"])


def search(nodes: DataFrame, near: DataFrame, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND, steps: int = STEPS) -> DataFrame:
    """Greedy graph search.  ``queries`` (q, vector, dim, start: array of nodes) -> (q, ids, sims): the beam, nearest first.

    Starts are measured first; the search of a query ends when its whole beam is expanded (or after ``steps`` rounds)."""
    n = nodes.count()
    blocks = max(LEAST_BLOCKS, math.ceil(n / BLOCK))
    vectors = nodes.select("block", "node", F.transform("vector", lambda x: x.cast("float")).alias("vector"), F.lit(0.0).cast("float").alias("value"))
    schema = "q long, wish array<float>, dim long, ids array<long>, sims array<float>, open array<boolean>"
    state = queries.select("q", F.transform("vector", lambda x: x.cast("float")).alias("wish"), "dim", F.array().cast("array<long>").alias("ids"),
                           F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("open"), "start")
    state = save(state, "ann-search")
    asked = state.select("q", F.col("start").alias("asked"))
    ask = state

    def dealt(batches):
        for b in batches:
            rows = b.to_pylist() if not b.num_rows else None
            if rows is not None:
                continue
            lists = b.column("asked")
            of = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            ids, block = lists.flatten(), b.column("blocks").flatten().to_numpy()
            order = np.lexsort((block, of))
            o, k = of[order], block[order]
            first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])]) if len(o) else np.zeros(0, dtype=np.int64)
            rows_at = pa.array(o[first])
            cuts = np.r_[first, len(o)]
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), *[b.column(c).take(rows_at) for c in ("q", "wish", "floor")],
                                              _list(cuts, ids.to_numpy()[order], pa.int64())], names=["block", "q", "wish", "floor", "asked"])

    def advance(batches):
        for b in batches:
            lists = b.column("found")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            new = np.repeat(row, np.asarray(flat.field("ids").value_lengths()))
            own = np.repeat(np.arange(b.num_rows), np.asarray(b.column("ids").value_lengths()))
            pick = lambda c: np.r_[b.column(c).flatten().to_numpy(zero_copy_only=False), flat.field(c).flatten().to_numpy()]
            opened = np.r_[b.column("open").flatten().to_numpy(zero_copy_only=False).astype(np.int8), np.ones(len(new), dtype=np.int8)]
            of, ids, sims, opened = _best(np.r_[own, new], pick("ids"), pick("sims"), beam, opened)
            cuts = _offsets(of, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("wish"), b.column("dim"), _list(cuts, ids, pa.int64()), _list(cuts, sims, pa.float32()),
                                              _list(cuts, opened.astype(bool), pa.bool_())], names=["q", "wish", "dim", "ids", "sims", "open"])

    done = None
    for _ in range(steps + 1):
        floor = F.when(F.size("ids") >= beam, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        put = ask.select("q", "wish", "dim", floor.alias("floor")).join(asked, "q").select(
            "q", "wish", "floor", "asked", F.transform("asked", lambda x: F.col("dim") * blocks + F.pmod(F.xxhash64(x), F.lit(blocks))).alias("blocks"))
        rows = put.mapInArrow(dealt, "block long, q long, wish array<float>, floor float, asked array<long>")
        found = _by_block(vectors, rows, lambda i, m, v, b: _scores(i, m, v, b, beam), "q long, ids array<long>, sims array<float>")
        found = found.groupBy("q").agg(F.collect_list(F.struct("ids", "sims")).alias("found"))
        none = F.array().cast("array<struct<ids:array<long>,sims:array<float>>>")
        now = save(ask.select("q", "wish", "dim", "ids", "sims", "open").join(found, "q", "left").withColumn("found", F.coalesce("found", none))
                   .mapInArrow(advance, schema), "ann-search")
        alive = F.exists("open", lambda x: x)
        ended = now.where(~alive).select("q", "ids", "sims")
        done = ended if done is None else done.unionByName(ended)
        ask = now.where(alive)
        if ask.isEmpty():
            break
        # the best not yet expanded are expanded now
        best = F.slice(F.filter(F.arrays_zip("ids", "open"), lambda e: e["open"]), 1, expand)
        ask = save(ask.select("q", "wish", "dim", "ids", "sims", F.transform(best, lambda e: e["ids"]).alias("expanded")), "ann-expand")
        met = ask.select("q", F.explode("expanded").alias("node")).join(near, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("met"))
        asked = ask.select("q", "ids").join(met, "q").select("q", F.array_except("met", "ids").alias("asked"))
        opened = now.select(F.col("q").alias("oq"), "open")
        still = F.transform(F.arrays_zip("ids", "open"), lambda e: e["open"] & ~F.array_contains("expanded", e["ids"]))
        ask = ask.join(opened, F.col("q") == F.col("oq")).select("q", "wish", "dim", "ids", "sims", still.alias("open"))
    else:
        done = done.unionByName(ask.select("q", "ids", "sims"))
    return done


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **options) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` picks, the k nearest other rows found, by inner product.

    Ties go to the smaller id; fewer rows come back only where fewer are left.  Vectors that are null, empty, zero or hold null or non-finite components take no
    part; nor do vectors of another length than the query's.  Repeated rows are rows of their own, and a row is not its own
    neighbour; a null id can be found (after all others of its score); an empty table gives no rows; other columns
    are not read, whatever their names.  ``options``: those of ``neighbour_graph`` and ``search``."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    nodes = nodes_of(rows, k)
    graph_options = {o: v for o, v in options.items() if o in ("rounds", "sample", "tables", "leaf")}
    near = links(neighbour_graph(nodes, **graph_options))
    askers = save(rows.where("asks").join(nodes.select("vector", "node", "dim"), "vector").select(F.monotonically_increasing_id().alias("row"), "id", "node", "dim"), "ann-askers")
    wishes = askers.select("node").distinct().join(nodes.select("node", "vector", "dim"), "node").select(
        F.col("node").alias("q"), "vector", "dim", F.array("node").alias("start"))
    beams = search(nodes, near, wishes, **{o: v for o, v in options.items() if o in ("beam", "expand", "steps")})
    return _measured(askers, beams, nodes, k)


def nearest_to(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **options) -> DataFrame:
    """The same for ``queries`` (id, vector) that are not rows of the table; searches start at ENTRIES fixed nodes."""
    ship(vectors.sparkSession)
    nodes = nodes_of(vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector")), k)
    near = links(neighbour_graph(nodes, **{o: v for o, v in options.items() if o in ("rounds", "sample", "tables", "leaf")}))
    first = nodes.select("dim", "node", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("node"))).alias("at")).where(F.col("at") <= ENTRIES)
    starts = first.groupBy("dim").agg(F.collect_list("node").alias("start"))
    own = queries.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector")).where(_valid(F.col("vector")))
    own = save(own.withColumn("dim", F.size("vector").cast("long")).join(starts, "dim").withColumn("q", F.monotonically_increasing_id()), "ann-wishes")
    beams = search(nodes, near, own.select("q", "vector", "dim", "start"), **{o: v for o, v in options.items() if o in ("beam", "expand", "steps")})
    askers = own.select(F.col("q").alias("row"), "id", F.col("q").alias("node"), "vector", "dim")
    return _measured(askers, beams, nodes, k, own=False)


def _measured(askers: DataFrame, beams: DataFrame, nodes: DataFrame, k: int, own: bool = True) -> DataFrame:
    """The beams' best, measured in double precision, as rows of each asker."""
    pairs = beams.select(F.col("q"), F.explode(F.slice("ids", 1, 2 * k + 2)).alias("node"))
    wishes = nodes.select(F.col("node").alias("q"), F.col("vector").alias("wish")) if own else askers.select(F.col("node").alias("q"), F.col("vector").alias("wish"))
    pairs = pairs.join(nodes.select("node", "vector", "ids"), "node").join(wishes, "q")
    product = F.aggregate(F.zip_with("wish", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    measured = save(pairs.select("q", "node", product.alias("score"), "ids"), "ann-measured")
    rows = askers.select("row", F.col("id").alias("query_id"), F.col("node").alias("q")).join(measured, "q")
    # of its own node a row sees the other rows: its id goes once
    mine = (F.col("node") == F.col("q")) if own else F.lit(False)
    at = F.array_position("ids", F.col("query_id")).cast("int")
    without = F.when(at > 0, F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.size("ids")))).otherwise(F.slice("ids", 1, k))
    # ids and score are the same for all rows of a node, so k of each are enough
    found = rows.select("row", "query_id", "score", F.explode(F.when(mine, without).otherwise(F.col("ids"))).alias("id"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
