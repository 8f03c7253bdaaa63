"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most ``capacity`` tokens.  Only the number of
pieces of each length matters for packing, and there are at most ``capacity``
lengths, so the search works on that histogram: a filling is a list of lengths
with the number of sequences that use it.  The search takes the largest
remaining length, enumerates undominated fillings around it, prunes by the
waste that a better solution may still have, and starts from best-fit decreasing as incumbent.

Scale: tokenising is narrow; the histogram has at most ``capacity`` rows and is
the only thing the driver sees; pieces get their places by their rank among
the pieces of their length, counted in salted groups, so a length that a third
of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, save, ship
from .tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 0  # Fixed value: the id that ends a document.
#: Search limits: nodes of the tree, fillings tried at a node, steps to enumerate them.
NODES, WIDTH, STEPS = 6000, 4, 1500
GROUP = 1000  # pieces of one length ranked together, about
_CHARS = 1_000_000  # text encoded at a time

Filling = tuple[int, ...]  # lengths, largest first


# --- the search, on counts by length -------------------------------------------------------------------------------

class _Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.lengths = sorted(counts)

    def take(self, filling: Filling, times: int) -> None:
        for x in filling:
            self.counts[x] -= times
        for x in set(filling):
            if not self.counts[x]:
                del self.counts[x], self.lengths[bisect_right(self.lengths, x) - 1]

    def give(self, filling: Filling, times: int) -> None:
        for x in filling:
            if x not in self.counts:
                self.counts[x] = 0
                insort(self.lengths, x)
            self.counts[x] += times

    def times(self, filling: Filling) -> int:
        """How many sequences can be filled so."""
        return min(self.counts[x] // filling.count(x) for x in set(filling))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the larger of the volume bound and the bound from pieces over half the capacity."""
    if not counts:
        return 0
    total = sum(x * n for x, n in counts.items())
    large = {x: n for x, n in counts.items() if 2 * x > capacity}
    best = -(-total // capacity)
    for k in sorted({x for x in counts if 2 * x <= capacity} | {1}):
        alone = sum(n for x, n in large.items() if x > capacity - k)
        shared = {x: n for x, n in large.items() if x <= capacity - k}
        free = sum(n * (capacity - x) for x, n in shared.items())
        small = sum(x * n for x, n in counts.items() if k <= x and 2 * x <= capacity)
        best = max(best, alone + sum(shared.values()) + max(0, -(-(small - free) // capacity)))
    return best


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each piece, largest first, goes into the fullest open sequence that it fits.

    Open sequences are kept by gap; equal ones take equal pieces at once."""
    gaps: list[int] = []  # sorted, each once
    classes: dict[int, list[tuple[Filling, int]]] = {}

    def put(gap: int, filling: Filling, times: int) -> None:
        if times:
            if gap not in classes:
                classes[gap] = []
                insort(gaps, gap)
            classes[gap].append((filling, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(gaps, x)
            if at < len(gaps):
                gap = gaps[at]
                filling, times = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap], gaps[at]
            else:
                gap, filling, times = capacity, (), n
            most = gap // x  # with one piece more, a sequence is the fullest still, as long as it fits another
            full = min(times, n // most)
            put(gap - most * x, filling + (x,) * most, full)
            n -= full * most
            some = n if full < times else 0
            if some:
                put(gap - some * x, filling + (x,) * some, 1)
                n = 0
            if filling:
                put(gap, filling, times - full - (some > 0))
    return [c for gap in gaps for c in classes[gap]]


def _fillings(stock: _Stock, capacity: int, waste: int, width: int, steps: int) -> list[Filling]:
    """Undominated fillings around the largest piece that waste at most ``waste``, least waste first."""
    lengths = stock.lengths
    found: list[Filling] = []
    chosen = [lengths[-1]]
    levels: list[list] = []  # for each chosen piece: index of the length tried last, gap, whether any length did fit
    gap, top = capacity - chosen[0], len(lengths)

    def keep() -> None:
        if not _dominated(chosen, capacity - sum(chosen), stock):
            found.append(tuple(chosen))

    while steps > 0:
        steps -= 1
        if gap:
            levels.append([min(top, bisect_right(lengths, gap)), gap, False])
        else:
            keep()
            if len(found) >= width:
                break
            chosen.pop()
        while levels:
            level = levels[-1]
            level[0] -= 1
            while level[0] >= 0 and chosen.count(lengths[level[0]]) >= stock.counts[lengths[level[0]]]:
                level[0] -= 1
            if level[0] >= 0:
                level[2] = True
                break
            if not level[2] and level[1] <= waste:
                keep()
            levels.pop()
            chosen.pop()
        if not levels:
            break
        x = lengths[level[0]]
        chosen.append(x)
        gap, top = level[1] - x, level[0] + 1
    return sorted(dict.fromkeys(found), key=lambda f: capacity - sum(f))[:width]  # of equal waste, the larger pieces first


def _dominated(chosen: list[int], gap: int, stock: _Stock) -> bool:
    """Whether a piece left out could take the place of one or two (smaller) chosen ones and still fit."""
    if not gap:
        return False
    rest = sorted(set(chosen[1:]))
    for some in [*((x,) for x in rest), *combinations(chosen[1:9], 2)]:
        size = sum(some)
        at = bisect_right(stock.lengths, size + gap) - 1
        while at >= 0 and stock.lengths[at] > size:
            if chosen.count(stock.lengths[at]) < stock.counts[stock.lengths[at]]:
                return True
            at -= 1
    return False


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH,
             steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Pieces by length -> fillings with the number of sequences that use each.

    Every piece is placed.  The search ends when the lower bound is met or
    after ``nodes`` nodes, with the best solution so far."""
    counts = {x: n for x, n in counts.items() if n}
    best, goal = _best_fit(counts, capacity), lower_bound(counts, capacity)
    most = sum(n for _, n in best)
    total = sum(x * n for x, n in counts.items())
    stock, path, used = _Stock(counts), [], 0
    open_: list[list[Filling]] = []  # fillings still to try, for each step of the path
    while most > goal and nodes > 0:
        nodes -= 1
        waste = (most - 1) * capacity - total - sum(n * (capacity - sum(f)) for f, n in path)
        if not stock.lengths:
            if used < most:
                best, most = list(path), used
            choices = []
        elif waste < 0:
            choices = []
        else:
            choices = _fillings(stock, capacity, waste, width, steps)
        open_.append(choices[::-1])
        while open_ and not open_[-1]:
            open_.pop()
            if path:
                filling, n = path.pop()
                stock.give(filling, n)
                used -= n
        if not open_:
            break
        filling = open_[-1].pop()
        n = stock.times(filling)
        if (spare := capacity - sum(filling)) > 0 and waste >= spare:
            n = max(1, min(n, waste // spare))
        stock.take(filling, n)
        path.append((filling, n))
        used += n
    return best


# --- documents to pieces to places ---------------------------------------------------------------------------------

PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids_crc32", T.LongType())]


def _grouped(texts: list[str]):
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= _CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the documents' token ids, each followed by END_ID, cut at ``capacity``."""
    vocab = vocab or vocabulary()
    ship(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(raw: bytes):
        for start in range(0, len(raw) // 4, capacity):
            yield start, raw[4 * start:4 * (start + capacity)]

    def work(batches):
        tool = encoder(vocab)
        for b in batches:
            raws = [r + end for group in _grouped([x or "" for x in b.column(1).to_pylist()]) for r in tool.encode(group)]
            rows = [(k, n, start, ids) for k, raw in enumerate(raws) for n, (start, ids) in enumerate(cut(raw))]
            row, piece, start, ids = zip(*rows) if rows else ((), (), (), ())
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    ids = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return rows.mapInArrow(work, T.StructType([T.StructField("id", rows.schema["id"].dataType), *PIECE, *ids]))


def _ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank`` from 0 within each length, counted in salted groups of about GROUP rows.

    ``counts`` (pieces of each length) has at most ``capacity`` entries, so the salts of the lengths are broadcast."""
    order = ["id", "piece", "ids_crc32"]
    salts = rows.sparkSession.createDataFrame([(x, 1 + n // GROUP) for x, n in sorted(counts.items())], "length long, salts int")
    rows = (rows.join(F.broadcast(salts), "length")
            .withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts")).cast("int")).drop("salts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "salt").count()
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    return (rows.withColumn("inside", inside).join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("salt", "inside", "offset"))


def _slots(fillings: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: (first rank, first sequence, sequences, offset), in order of rank."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for filling, times in fillings:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            copies = filling.count(x)
            runs.setdefault(x, []).append((taken.get(x, 0), first, times, offset))
            taken[x] = taken.get(x, 0) + copies * times
            offset += copies * x
        first += times
    return {x: np.array(r, dtype=np.int64) for x, r in runs.items()}


def place(rows: DataFrame, capacity: int = CAPACITY, search: dict | None = None) -> DataFrame:
    """Pieces (any columns, among them id, piece, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(complete(counts, capacity, **(search or {})))
    ranked = _ranked(rows, counts)

    def work(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                run = slots[int(x)][np.searchsorted(slots[int(x)][:, 0], rank[at], side="right") - 1]
                copy, sequence_in = np.divmod(rank[at] - run[:, 0], run[:, 2])
                sequence[at], offset[at] = run[:, 1] + sequence_in, run[:, 3] + copy * x
            keep = [k for k, name in enumerate(b.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*(b.schema.names[k] for k in keep), "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(work, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None,
         capacity: int = CAPACITY, with_ids: bool = False, search: dict | None = None) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens.
    A null text counts as empty (one token, END_ID); repeated rows are
    documents of their own; ids may be null; an empty table gives no rows;
    other columns are not read, whatever their names."""
    return place(save(pieces(docs, id_col, text_col, vocab, capacity, with_ids), "pieces"), capacity, search)
