"""Secret scanning with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived:
what any match must contain.  Every Arrow batch of documents is an index
segment: the postings of the trigrams asked for are the documents of the
segment that hold them; a rule's query is answered by intersecting and uniting postings, and
only the documents left are searched with the expression.  Rules that need no trigram
search every document.

Scale: segments are built, asked and dropped inside one task, so nothing is
shuffled, memory is bounded by the Arrow batch, and a lost task is simply done
again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ship

try:
    from re import _constants as C, _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

#: Literal strings followed at once when a query is derived, and letters of a class taken one by one.
MAX_STRINGS, MAX_CLASS = 24, 8


@dataclass(frozen=True)
class Query:
    """``all``: any document; ``tri``: documents with the trigram; ``and`` / ``or`` of parts."""

    op: str
    value: str = ""
    parts: tuple["Query", ...] = ()


ALL = Query("all")


def _and(parts) -> Query:
    parts = tuple(dict.fromkeys(p for q in parts for p in (q.parts if q.op == "and" else (q,)) if p is not ALL and p.op != "all"))
    return ALL if not parts else parts[0] if len(parts) == 1 else Query("and", parts=parts)


def _or(parts) -> Query:
    """Parts that ask for more than another part does are left out."""
    needs = {p: set(p.parts) if p.op == "and" else {p} for p in dict.fromkeys(parts)}
    parts = tuple(p for p in needs if not any(needs[q] < needs[p] for q in needs))
    if any(p.op == "all" for p in parts):
        return ALL
    return parts[0] if len(parts) == 1 else Query("or", parts=parts)


def _of_string(text: str) -> Query:
    return _and(Query("tri", text[k:k + 3]) for k in range(len(text) - 2))


def _of_strings(strings: set[str]) -> Query:
    return _or([_of_string(s) for s in sorted(strings)]) if strings else ALL


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What the lower-cased text of any match must hold."""
    exact, query = _derive(P.parse(pattern, flags))
    return _and([query, _of_strings(exact)]) if exact is not None else query


def _derive(nodes) -> tuple[set[str] | None, Query]:
    """(all lower-cased strings that it can match, if few; else None, and a query)."""
    query, run = ALL, {""}
    whole = True
    for op, value in nodes:
        exact, inner = _step(op, value)
        query = _and([query, inner])
        joined = {a + b for a, b in product(run, exact)} if exact is not None else None
        if joined is not None and len(joined) <= MAX_STRINGS:
            run = joined
        else:
            whole = False
            query = _and([query, _of_strings(run)])
            run = exact if exact is not None else {""}
    return (run, query) if whole else (None, _and([query, _of_strings(run)]))


def _step(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()} if value < 128 else None, ALL
    if op is C.IN:
        letters = _class(value)
        return letters, ALL
    if op is C.SUBPATTERN:
        return _derive(value[-1])
    if op is C.BRANCH:
        found = [_derive(x) for x in value[1]]
        if all(e is not None for e, _ in found) and len(union := set().union(*(e for e, _ in found))) <= MAX_STRINGS:
            return union, _or([q for _, q in found])
        return None, _or([_and([q, _of_strings(e)]) if e is not None else q for e, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        low, high, body = value
        exact, query = _derive(body)
        if low == 0:
            return (exact | {""}, ALL) if high == 1 and exact is not None else (None, ALL)
        if low == high == 1:
            return exact, query
        return None, _and([query, _of_strings(exact)]) if exact is not None else query
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL and value < 128:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 2 * MAX_CLASS and value[1] < 128:
            out |= {chr(k).lower() for k in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    accept: Callable[[re.Match], bool] | None = None  # matches that fail are dropped


_KEY = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The base rules, then the rules that this scanner adds.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)" + _KEY, re.IGNORECASE | re.ASCII, lambda m: len(m[2]) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{1,64}@"),
)
RULES = (*BASE_RULES, *MORE_RULES)


class Segment:
    """Postings of one batch of texts, made for the trigrams that are asked for."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lower = [x.lower() for x in texts]
        self.every = np.arange(len(texts))
        self.postings: dict[str, np.ndarray] = {}

    def posting(self, trigram: str) -> np.ndarray:
        if trigram not in self.postings:
            self.postings[trigram] = np.flatnonzero([trigram in x for x in self.lower])
        return self.postings[trigram]

    def ask(self, query: Query) -> np.ndarray:
        """Documents that may hold a match, in order."""
        if query.op == "all":
            return self.every
        if query.op == "tri":
            return self.posting(query.value)
        if query.op == "or":
            return np.unique(np.concatenate([self.ask(p) for p in query.parts]))
        left = self.every
        for part in query.parts:
            left = np.intersect1d(left, self.ask(part), assume_unique=True)
            if not len(left):
                break
        return left


def scan_texts(texts: list[str], rules=RULES) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every text's matches, by start, then rule; leftmost non-overlapping for each rule."""
    segment = Segment(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, rule in enumerate(rules):
        search = re.compile(rule.pattern, rule.flags)
        for k in segment.ask(trigram_query(rule.pattern, rule.flags)).tolist():
            for m in search.finditer(texts[k]):
                if rule.accept is None or rule.accept(m):
                    found[k].append((m.start(), n, m.end()))
    return [[(rules[n].kind, s, e) for s, n, e in sorted(x)] for x in found]


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array of kind, start, end) for every row of ``docs``.

    Offsets count code points, the end is exclusive.  A null text counts as
    empty; repeated rows and null ids give a row each; an empty table gives no rows;
    other columns are not read, whatever their names."""
    ship(docs.sparkSession)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for b in batches:
            spans = scan_texts([x or "" for x in b.column(1).to_pylist()], rules)
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, arrow)], names=["id", "spans"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(work, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))]))
