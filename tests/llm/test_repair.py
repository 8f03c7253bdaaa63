"""Conversation repair against a search over all repairs, and the query against a plain version over the table."""

import hashlib
import heapq
import re
import zlib
from random import Random

import pytest

import cases
from kpiloom.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def prefix_ok(initials):
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def cheapest(rows):
    """Least (cost, audit) by a best-first search over whole repairs; each entry holds its own initials and texts."""
    marks = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if k == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, lines
        if (k, initials[-1:], audit) in done:
            continue
        done.add((k, initials[-1:], audit))
        ways = [(2, "I", k, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            ways.append((3, "D", k + 1, "", ()))
            if marks[k] not in ("blank", "duplicate"):
                more = marks[k] == "truncated"
                ways.append((more, "K", k + 1, role[:1] or "-", (f"{role}:{text}",)))
                ways += [(2 + more, "R", k + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, a, nk, i, line in ways:
            if prefix_ok(initials + i) and len(audit) < 2 * len(rows) + 4:
                heapq.heappush(heap, (cost + c, audit + a, nk, initials + i, lines + line))


def expected(rows):
    """Rows of one conversation, after damage, in order -> the report's values."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marks = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(rows)
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damaged(rows):
    """All rows (conv, turn, role, text) of a table -> rows of each conversation after damage."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def as_rows(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", *repair.FAULTS, "illegal", "cost", "audit", "repaired_sha256").collect()}


def check(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv"]: r for r in repair.reports(df, block=block).collect()}
    groups = {}
    for c, *r in rows:
        groups.setdefault(c, []).append((r[0], " " if r[1] is None else r[1], " " if r[2] is None else r[2]))
    assert set(found) == set(groups)
    for conv, own in groups.items():
        want = expected(in_order(own))
        r = found[conv]
        got = (*[r[c] for c in ["gaps", *repair.FAULTS, "illegal", "cost", "audit"]], hashlib.sha256(r["repaired"].encode()).hexdigest())
        assert got == want, (conv, in_order(own))


@pytest.mark.parametrize("block", [2, 4096])
def test_against_a_search_over_all_repairs(spark, block):
    rng = Random(7)
    rows = []
    for conv in range(90):
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None]),
                         rng.choice(["One.", "Two!", "three", "", " \n", "Four?\t", None, "Five. "])))
    check(spark, rows, block)


def test_codes_and_matrices_agree():
    rng = Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("suaoSUAOx", k=rng.randint(1, 12))) for _ in range(2))
        whole, left, right = repair.costs(a + b, repair._END), repair.matrix(a), repair.costs(b, repair._END)
        assert whole == tuple(min(left[4 * i + j] + right[j] for j in range(4)) for i in range(4))


def test_a_conversation_of_many_blocks(spark):
    rng = Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"Turn {k}.") for k in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by_block = [{r["conv"]: r for r in repair.reports(df, block=b).collect()} for b in (64, 100, 5000)]
    assert by_block[0] == by_block[1] == by_block[2]
    assert by_block[0][2]["audit"] == "KI" and by_block[0][2]["repaired"] == "user:Hi.\nassistant:"
    lines = by_block[0][1]["repaired"].split("\n")
    assert LEGAL.fullmatch("".join(x[0] for x in lines))


def test_null_ids_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (5, None, None, None)],
                               "conv_id long, turn long, role string, text string")
    extra = df.select("*", *[F.lit(1).alias(c) for c in ["key", "pos", "block", "fault", "code", "tie", "dotted.name"]])
    got = {r["conv"]: r for r in repair.reports(extra).collect()}
    assert got[None]["audit"] == "KK" and got[None]["cost"] == 0
    assert (got[5]["blank"], got[5]["audit"], got[5]["repaired"]) == (1, "D", "")
    assert repair.reports(df.limit(0)).collect() == []


def test_the_query_over_the_table(spark):
    got = as_rows(queries.QUERIES["op13_conversation_repair"](spark, cases.SF))
    table = [tuple(r) for r in cases.table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: expected(in_order(rows)) for conv, rows in damaged(table).items()}
    assert got == want
