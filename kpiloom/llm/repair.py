"""Conversation structure repair by a cost DP and prefix-doubling path ranking.

A conversation's rows are kept, given another role, deleted, or joined by inserted empty turns,
so that the roles' initials read ``(s?(ua)+)?`` at the least cost; of equally cheap repairs the one whose
audit (the edits' initials in order) is least in ASCII is taken.

A node is a row and a state (nothing yet, after s, after u, after a); an arc is an edit.  The cost DP runs
backwards and leaves each node its optimal arcs, of which no two have the same initial.  Nodes are then ranked by
the least audit of 1, 2, 4, ... letters that leaves them: a rank of twice the length is the rank of (own rank,
rank of the node that a pointer of that length leads to), and pointers double as well.  Once all pointers
have reached the end, a rank names one audit, which is read off through the pointers once for each rank.

Scale: rows are placed in order by range partitioning, and a conversation is cut into blocks of at most
``block`` rows.  A block is a 4 x 4 matrix of costs (min, +); costs behind each block come from a doubling scan of joins
over the blocks of conversations that have several, and so does the state that each block is entered in.  A conversation with a
third of all rows is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_before
from .common import quoted, save, ship

BLOCK = 4096  # rows

# The edits' costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTS = ["blank", "duplicate", "truncated"]

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The next state by an initial, and the one that an inserted turn leads to.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)
#: Cost of ending in each state, with the turns still to be inserted.
_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40
_ROLE = {2: "user", 3: "assistant"}


# -- rows ---------------------------------------------------------------------------------------------------------------

def faulty_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(key, conv, pos, turn, role, text, previous_role, fault, code): every row with its place and its first fault.

    Rows go by turn, null turns first; ties by role, then text.  ``code`` is the role's initial if it is one of s, u, a, else o:
    as it is for rows that may stay, in capitals if truncated, and x for rows that must go."""
    role = F.coalesce(F.col(quoted(role_col)).cast("string"), F.lit(" "))
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(" "))
    conv = F.col(quoted(conv_col))
    rows = conversations.select(key_of(conv).alias("key"), conv.alias("conv"), F.col(quoted(turn_col)).alias("turn"),
                                role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = running_before(rows, ["key"], ["turn", "role", "text", "tie"], {}, last=["role"]).drop("tie").withColumnRenamed("n_before", "pos")
    same = F.md5(F.concat(F.char_length("role"), F.lit(":"), F.col("role"), F.col("text")))
    rows = save(rows.withColumn("same", same), "repair-rows")
    first = rows.groupBy("key", "same").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    rows = rows.drop("same").join(first, ["key", "pos"], "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(last == "", "blank").when(F.col("first").isNull(), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    rows = rows.withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.withColumn("code", code).drop("first")


def key_of(conv: Column) -> Column:
    """A conversation's id as text, null included."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


# -- cost DP of one row -------------------------------------------------------------------------------------------------

@lru_cache(maxsize=1 << 16)
def _row(code: str, after: tuple) -> tuple:
    """Costs in each state before a row, from those after it (less the least of them): (costs, letters, least cost).

    ``letters``: the least initial of an optimal edit in each state; I stays at the row, the others pass it."""
    low = code.lower()
    more = TRUNCATED if code != low else 0
    arcs = []
    for s in range(4):
        ways = [(DELETE + after[s], "D", s)]
        if code != "x":
            ways.append((REROLE + more + after[_NEXT[s]], "R", _NEXT[s]))
            if (s, low) in _KEEP:
                ways.append((more + after[_KEEP[s, low]], "K", _KEEP[s, low]))
        arcs.append(ways)
    cost = [min(w[0] for w in ways) for ways in arcs]
    for _ in range(2):
        cost = [min(c, INSERT + cost[_NEXT[s]]) for s, c in enumerate(cost)]
    letters, states = [], []
    for s, ways in enumerate(arcs):
        best = [(a, to) for c, a, to in ways if c == cost[s]] + [("I", _NEXT[s])] * (INSERT + cost[_NEXT[s]] == cost[s])
        letters.append(min(best)[0])
        states.append(min(best)[1])
    least = min(cost)
    return tuple(c - least for c in cost), tuple(letters), tuple(states), least


def costs(codes: str, end: tuple) -> tuple:
    """Cost of going from each state through all rows to the end, whose costs by state are given."""
    low = min(end)
    now, total = tuple(c - low for c in end), low
    for code in reversed(codes):
        now, _, _, least = _row(code, now)
        total += least
    return tuple(c + total for c in now)


def matrix(codes: str) -> list[int]:
    """Least cost from state i (before) to state j (after), row by row."""
    columns = [costs(codes, tuple(0 if s == j else _FAR for s in range(4))) for j in range(4)]
    return [min(columns[j][i], _FAR) for i in range(4) for j in range(4)]


# -- least audits by prefix doubling ------------------------------------------------------------------------------------

def least_audits(blocks: list[tuple[str, tuple]]) -> list[tuple[list[str], list[int]]]:
    """For (codes, costs behind) of each block: the least optimal audit from each state of entry, and the state it ends in."""
    starts, letter, to, final = [], [], [], []
    n = 0
    for codes, end in blocks:
        low = min(end)
        now = tuple(c - low for c in end)
        rows = []
        for code in reversed(codes):
            now, letters, states, _ = _row(code, now)
            rows.append((letters, states))
        starts.append(n)
        for letters, states in reversed(rows):
            letter += [ord(x) for x in letters]
            to += [n + s if x == "I" else n + 4 + s for x, s in zip(letters, states)]
            n += 4
        letter += [0] * 4
        to += range(n, n + 4)
        final += [False] * (4 * len(codes)) + [True] * 4
        n += 4
    letter, to, final = np.array(letter, dtype=np.int64), np.array(to, dtype=np.int64), np.array(final)
    ranks = np.unique(letter, return_inverse=True)[1].astype(np.int64)  # by audits of one letter
    pointers = [to]
    while not final[pointers[-1]].all():
        p = pointers[-1]
        ranks = np.unique(ranks * (ranks.max() + 1) + ranks[p], return_inverse=True)[1].astype(np.int64)
        pointers.append(p[p])
    entries = (np.array(starts, dtype=np.int64)[:, None] + np.arange(4)).reshape(-1)
    _, chosen, of = np.unique(ranks[entries], return_index=True, return_inverse=True)
    path = entries[chosen][:, None]
    for p in pointers[:-1] or pointers:
        path = np.concatenate([path, p[path]], axis=1)
    audits = [bytes(x).rstrip(b"\0").decode("ascii") for x in letter[path].astype(np.uint8)]
    ends = (pointers[-1][entries] % 4).reshape(-1, 4).tolist()
    of = of.reshape(-1, 4).tolist()
    return [([audits[k] for k in o], e) for o, e in zip(of, ends)]


def edits_of(codes: str, audit: str, state: int, last: bool) -> list[tuple[str, int | None, str | None]]:
    """(edit, row in the block or None, new role or None) of an audit entered in ``state``; ``last`` adds the turns missing at the end."""
    out, row = [], 0
    for a in audit:
        if a == "I":
            state = _NEXT[state]
            out.append(("I", None, _ROLE[state]))
            continue
        if a == "K":
            state = _KEEP[state, codes[row].lower()]
        elif a == "R":
            state = _NEXT[state]
        out.append((a, row, _ROLE[state] if a == "R" else None))
        row += 1
    while last and _END[state]:
        state = _NEXT[state]
        out.append(("I", None, _ROLE[state]))
    return out


# -- blocks -------------------------------------------------------------------------------------------------------------

def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, block, codes, n_blocks)."""
    own = rows.select("key", F.floor(F.col("pos") / block).alias("block"), F.struct("pos", "code").alias("c"))
    cut = own.groupBy("key", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["code"]), "").alias("codes"))
    cut = save(cut, "repair-blocks")
    many = cut.where("block > 0").groupBy(F.col("key").alias("k")).agg((F.max("block") + 1).alias("n_blocks"))
    return save(cut.join(many, F.col("key") == F.col("k"), "left").drop("k").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))), "repair-cut")


def _product(a: Column, b: Column) -> Column:
    """(min, +) product of two 4 x 4 matrices held as arrays."""
    return F.array(*[F.least(F.lit(_FAR), *[a[4 * i + k] + b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def _scan(blocks: DataFrame, value: str, step: int, compose, most: int) -> DataFrame:
    """Doubling scan of ``value`` over the blocks of each key, towards later blocks (step 1) or earlier ones (step -1).

    Returns (key, block, value): everything from the block to the last one (or from the first one to it), itself included."""
    now, reach = blocks.select("key", "block", value), 1
    while reach < most:
        far = now.select("key", (F.col("block") - step * reach).alias("block"), F.col(value).alias("far"))
        now = now.join(far, ["key", "block"], "left")
        now = save(now.select("key", "block", F.when(F.col("far").isNull(), F.col(value)).otherwise(compose(F.col(value), F.col("far"))).alias(value)),
                   "repair-scan")
        reach *= 2
    return now


def _per_block(df: DataFrame, work, schema: str) -> DataFrame:
    """``work``: list of row dicts -> list of row dicts, for blocks of alike length together."""
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            alike: dict[int, list] = {}
            for r in rows:
                alike.setdefault(len(r["codes"]).bit_length(), []).append(r)
            for size, group in alike.items():
                part = max(1, 65536 >> size)
                for k in range(0, len(group), part):
                    yield pa.RecordBatch.from_pylist(work(group[k:k + part]), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def _behind(blocks: DataFrame, most: int) -> DataFrame:
    """``blocks`` with ``behind``: the cost of all that follows each block, by state."""
    end = F.array(*[F.lit(c).cast("long") for c in _END])
    if most == 1:
        return blocks.withColumn("behind", end)
    many = blocks.where("n_blocks > 1").select("key", "block", "codes")
    matrices = save(_per_block(many, lambda rows: [{"key": r["key"], "block": r["block"], "m": matrix(r["codes"])} for r in rows],
                               "key string, block long, m array<long>"), "repair-matrices")
    later = _scan(matrices, "m", 1, _product, most)
    m = F.col("m")
    v = F.array(*[F.least(*[m[4 * i + j] + _END[j] for j in range(4)]) for i in range(4)])
    after = later.select("key", (F.col("block") - 1).alias("block"), v.alias("v"))
    return blocks.join(after, ["key", "block"], "left").withColumn("behind", F.coalesce("v", end)).drop("v")


def _entered(found: DataFrame, most: int) -> DataFrame:
    """``found`` with ``state``, in which each block is entered."""
    if most == 1:
        return found.withColumn("state", F.lit(0))
    many = found.where("n_blocks > 1").select("key", "block", "ends")
    through = _scan(many, "ends", -1, lambda own, before: F.transform(before, lambda s: own[s]), most)
    state = through.select("key", (F.col("block") + 1).alias("block"), F.col("ends")[0].alias("s"))
    return found.join(state, ["key", "block"], "left").withColumn("state", F.coalesce("s", F.lit(0))).drop("s")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``faulty_rows`` -> (key, block, at, edit, pos, new_role): the cheapest edits of each conversation, in order of (block, at).

    ``pos`` is the row that an edit concerns, null for inserted turns; ``new_role`` is set for inserted turns and changed roles.
    Every row has one edit; an empty table gives none."""
    ship(rows.sparkSession)
    blocks = _blocks(rows, block)
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    blocks = _behind(blocks, most)

    def audits(group: list[dict]) -> list[dict]:
        found = least_audits([(r["codes"], tuple(r["behind"])) for r in group])
        return [{"key": r["key"], "block": r["block"], "n_blocks": r["n_blocks"], "codes": r["codes"], "audits": a, "ends": e}
                for r, (a, e) in zip(group, found)]

    found = save(_per_block(blocks, audits, "key string, block long, n_blocks long, codes string, audits array<string>, ends array<int>"),
                 "repair-audits")
    chosen = _entered(found, most)

    def edits(group: list[dict]) -> list[dict]:
        out = []
        for r in group:
            first = r["block"] * block
            made = edits_of(r["codes"], r["audit"], r["state"], r["block"] == r["n_blocks"] - 1)
            out += [{"key": r["key"], "block": r["block"], "at": k, "edit": e, "pos": None if row is None else first + row, "new_role": role}
                    for k, (e, row, role) in enumerate(made)]
        return out

    picked = chosen.select("key", "block", "n_blocks", "codes", F.col("audits")[F.col("state")].alias("audit"), "state")
    return _per_block(picked, edits, "key string, block long, at int, edit string, pos long, new_role string")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, block, at, edit, role, text, cost): the edits with what they leave; role and text are null where a row is deleted."""
    own = rows.select(F.col("key").alias("k"), F.col("pos").alias("p"), F.col("role").alias("own_role"), "text", "fault")
    both = edits.join(own, (F.col("key") == F.col("k")) & (F.col("pos") == F.col("p")), "left")
    gone = F.col("edit") == "D"
    role = F.when(~gone, F.coalesce("new_role", "own_role"))
    text = F.when(~gone, F.coalesce("text", F.lit("")))
    price = F.when(gone, DELETE).when(F.col("edit") == "I", INSERT).otherwise(
        F.when(F.col("edit") == "R", REROLE).otherwise(0) + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0))
    return both.select("key", "block", "at", "edit", role.alias("role"), text.alias("text"), price.cast("long").alias("cost"))


def reports(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            block: int = BLOCK) -> DataFrame:
    """One row for each conversation of the table: its faults, what the repair costs, and digests of the repair.

    (key, conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): ``repaired`` is the repaired conversation as ``role:text``
    lines.  Null roles and texts read as one space; a null conversation id is a conversation of its own; null turns come first and count for no gap;
    an empty role has no initial and can't be kept; repeated rows are duplicates; an empty table gives no rows; other columns are
    not read, whatever their names."""
    rows = save(faulty_rows(conversations, conv_col, turn_col, role_col, text_col), "repair-faulty")
    pair = F.concat(F.substring("previous_role", 1, 1), F.substring("role", 1, 1))
    illegal = F.col("previous_role").isNotNull() & ~pair.isin("su", "ua", "au")
    counts = rows.groupBy("key").agg(
        F.first("conv").alias("conv"), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in FAULTS], F.count(F.when(illegal, 1)).alias("illegal"))
    turns = rows.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy(F.col("key").alias("k")).agg(F.count("*").alias("turns"))
    out = repaired(rows, repair(rows, block))
    line = F.when(F.col("role").isNotNull(), F.concat("role", F.lit(":"), "text"))
    lines = out.select("key", "block", "cost", F.struct("at", "edit", line.alias("line")).alias("e"))
    parts = lines.groupBy("key", "block").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list("e")).alias("es"))
    parts = parts.select("key", "cost", F.struct("block", F.array_join(F.transform("es", lambda e: e["edit"]), "").alias("audit"),
                                                 F.array_compact(F.transform("es", lambda e: e["line"])).alias("lines")).alias("b"))
    whole = parts.groupBy(F.col("key").alias("wk")).agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list("b")).alias("bs"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return (counts.join(turns, F.col("key") == F.col("k"), "left").join(whole, F.col("key") == F.col("wk"))
            .select("key", "conv", gaps.alias("gaps"), *FAULTS, "illegal", "cost",
                    F.array_join(F.transform("bs", lambda b: b["audit"]), "").alias("audit"),
                    F.array_join(F.flatten(F.transform("bs", lambda b: b["lines"])), "\n").alias("repaired")))
