"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the spans of four exact patterns (they are always reported) and of wider
patterns that need a decision.  Regex, gazetteer and context labelers vote on each
candidate: 1 personal, -1 not, 0 abstains.  Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is and so a
probability for each pattern; a logistic classifier on features of the span and its
surroundings is then trained on those probabilities, and decides about the wider
candidates.

Scale: texts are read in Arrow batches and never shuffled.  What leaves the
tasks for training is a count for each combination of kind, votes and features;
there are fewer than MAX_PATTERNS of these whatever the input, so they come
to the driver.  All rows are counted.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "name")
LABELERS = ("shape", "checksum", "gazetteer", "cue", "counter_cue", "edges")
CONTEXT = 40  # characters before a span that the context labelers read
THRESHOLD = 0.5
ROUNDS = 60
#: kinds x votes (3 of 6 labelers) x features (4 x 4 x 3 x 3)
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 144

# The patterns of the base kinds.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Wider patterns: their spans are candidates only.
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
_NAME = re.compile(r"\b(?:Mrs?|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")

# Gazetteers.
_TLDS = frozenset("com org net edu gov io info biz co uk de fr es it nl eu us ca au ch at be se no pl pt".split())
_CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61",
            "81", "82", "86", "90", "91")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "6011", "65", "62", "35")
_IBAN_LANDS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_GIVEN = frozenset("James Mary John Anna Peter Maria Hans Julia Pierre Marie Jean Claire Carlos Lucia Jose Carmen Paul Laura "
                   "David Sarah Thomas Emma Michael Sofia Robert Elena".split())
# Words that speak for or against personal data.
_CUES = {
    "email": "mail email e-mail contact write correo courriel", "ip": "ip address host client login from", "card": "card visa mastercard amex pay paid tarjeta karte carte",
    "phone": "call phone tel telephone mobile cell fax contact telefon telefono", "ssn": "ssn social security", "iban": "iban account konto compte cuenta",
    "name": "dear from by contact regards sincerely",
}
_COUNTER = frozenset("version v release build isbn issn order invoice ref reference sku part serial model article figure table page id no".split())
_WORD = re.compile(r"[a-z-]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start; offsets in code points."""
    text = text or ""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def _wider(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "at]" in text or "at)" in text:
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        out += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
        out += [("card", *m.span()) for m in _CARD.finditer(text)
                if 13 <= m.end() - m.start() <= 31 and 13 <= len(d := _digits(m[0])) <= 15 and _luhn(d)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if any(x in text for x in ("Mr", "Ms", "Dr", "Prof")):
        out += [("name", *m.span()) for m in _NAME.finditer(text)]
    return out


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    features: tuple[int, ...]


def candidates(text: str | None) -> list[Candidate]:
    """All candidates of a text.  A wider span that overlaps a base span, or an earlier wider one, is left out."""
    text = text or ""
    base = base_spans(text)
    wide = _wider(text)
    out = [_candidate(text, *x, True) for x in base]
    if not wide:
        return out
    taken = _merged((s, e) for _, s, e in base)
    for kind, s, e in sorted(wide, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        k = bisect_left(taken, (s, e))
        if not any(a < e and s < b for a, b in taken[max(0, k - 1):k + 1]):
            taken.insert(k, (s, e))
            out.append(_candidate(text, kind, s, e, False))
    return out


def _merged(spans) -> list[tuple[int, int]]:
    """The same ground as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _candidate(text: str, kind: str, s: int, e: int, base: bool) -> Candidate:
    span, before = text[s:e], text[max(0, s - CONTEXT):s]
    return Candidate(kind, s, e, base, _votes(text, kind, s, e, span, before, base), _features(text, s, e, span))


def _votes(text, kind, s, e, span, before, base) -> tuple[int, ...]:
    digits, words = _digits(span), set(_WORD.findall(before.lower()))
    checksum = {"card": lambda: 1 if _luhn(digits) else -1, "iban": lambda: 1 if _mod97(span) else -1,
                "ssn": lambda: -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1,
                "ip": lambda: -1 if span.startswith(("0.", "255.")) else 0}.get(kind, lambda: 0)()
    listed = {"email": lambda: span.rpartition(".")[2].strip(" ])").lower() in _TLDS, "phone": lambda: digits.startswith(_CALLING),
              "card": lambda: digits.startswith(_ISSUERS), "iban": lambda: span[:2] in _IBAN_LANDS,
              "name": lambda: any(w in _GIVEN for w in span.split()[1:])}.get(kind)
    gazetteer = 0 if listed is None else 1 if listed() else -1
    joined = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
    return (1 if base else 0, checksum, gazetteer, 1 if words & set(_CUES[kind].split()) else 0,
            -1 if words & _COUNTER else 0, -1 if joined else 1)


def _mod97(span: str) -> bool:
    x = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _features(text: str, s: int, e: int, span: str) -> tuple[int, ...]:
    """Buckets: length, digits, character before, character after."""
    n = sum(c.isdigit() for c in span)
    edge = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    return (min(3, (e - s) // 8), min(3, n // 5), edge(text[s - 1:s]), edge(text[e:e + 1]))


@dataclass(frozen=True)
class Model:
    """What training found: the labelers' reliabilities and the classifier."""

    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    bias: float = -10.0
    reliability: dict[tuple[str, int, int], float] = field(default_factory=dict)  # (labeler, truth, vote) -> probability

    def probability(self, c: Candidate) -> float:
        x = self.bias + sum(self.weights.get(k, 0.0) for k in _inputs(c.kind, c.votes, c.features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _inputs(kind: str, votes, features) -> list[tuple[str, int]]:
    """One-hot inputs of the classifier: the kind, the features, and the context votes."""
    return [(f"kind:{kind}", 1), *((f"feature{k}", v) for k, v in enumerate(features)), *((name, v) for name, v in zip(LABELERS, votes) if v)]


def train(patterns: list[tuple[str, tuple, tuple, int]]) -> Model:
    """(kind, votes, features, count) of all candidates -> Model.  No candidates: a model that accepts none."""
    if not patterns:
        return Model()
    patterns = sorted(patterns)
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    votes = np.array([p[1] for p in patterns]) + 1
    counts = np.array([p[3] for p in patterns], dtype=float)
    belief = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))
    for _ in range(ROUNDS):
        log_odds, table = _m_step(kinds, votes, counts, belief)
        belief = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    names = {(LABELERS[j], y, v - 1): float(table[y][j, v]) for y in (0, 1) for j in range(len(LABELERS)) for v in range(3)}
    inputs = [_inputs(p[0], p[1], p[2]) for p in patterns]
    keys = {k: i for i, k in enumerate(sorted({k for row in inputs for k in row}))}
    x = np.zeros((len(patterns), len(keys) + 1))
    x[:, -1] = 1
    for r, row in enumerate(inputs):
        x[r, [keys[k] for k in row]] = 1
    w = _logistic(x, belief, counts)
    return Model({k: float(w[i]) for k, i in keys.items()}, float(w[-1]), names)


def _m_step(kinds, votes, counts, belief):
    """Vote probabilities for each truth from the beliefs; the log odds of each pattern from those."""
    table, log_odds = [], np.zeros(len(counts))
    for y, weight in ((0, counts * (1 - belief)), (1, counts * belief)):
        p = np.stack([np.bincount(votes[:, j], weight, minlength=3) for j in range(votes.shape[1])]) + [[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]][y]
        table.append(p / p.sum(axis=1, keepdims=True))
        prior = (np.bincount(kinds, weight, minlength=len(KINDS)) + 1) / (np.bincount(kinds, counts, minlength=len(KINDS)) + 2)
        log_odds += (2 * y - 1) * (np.log(prior[kinds]) + sum(np.log(table[y][j, votes[:, j]]) for j in range(votes.shape[1])))
    return log_odds, table


def _logistic(x, target, counts, ridge: float = 1.0, steps: int = 25):
    """Ridge logistic regression by Newton steps, rows weighted by count."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return w


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, features, count) over the candidates of all texts."""
    ship(docs.sparkSession)

    def work(batches):
        for b in batches:
            found = [c for x in b.column(0).to_pylist() if x for c in candidates(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.kind for c in found], pa.string()), pa.array([list(c.votes) for c in found], pa.list_(pa.int32())),
                 pa.array([list(c.features) for c in found], pa.list_(pa.int32()))], names=["kind", "votes", "features"])

    found = docs.select(quoted(text_col)).mapInArrow(work, "kind string, votes array<int>, features array<int>")
    return found.groupBy("kind", "votes", "features").agg(F.count("*").alias("count"))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Train on all texts of ``docs``; at most MAX_PATTERNS counts come to the driver."""
    rows = vote_patterns(docs, text_col).collect()
    return train([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in rows])


def decide(text: str | None, model: Model, threshold: float = THRESHOLD) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of the reported spans, by kind, then start."""
    found = [c for c in candidates(text) if c.base or model.probability(c) >= threshold]
    return [(c.kind, c.start, c.end, c.base) for c in sorted(found, key=lambda c: (KINDS.index(c.kind), c.start))]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans: array of kind, start, end, base) for every row of ``docs``.

    Offsets count code points, the end is exclusive.  A null text counts as empty
    and has no spans; repeated rows and null ids give a row each; an empty table
    gives no rows; other columns are not read, whatever their names."""
    ship(docs.sparkSession)
    names = [f.name for f in SPAN.fields]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def work(batches):
        for b in batches:
            spans = [[dict(zip(names, s)) for s in decide(x, model, threshold)] if x else [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, arrow)], names=["id", "spans"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(work, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(SPAN))]))


def redact(text: str | None, model: Model, threshold: float = THRESHOLD) -> str | None:
    """The text with each reported span replaced by its kind, such as [EMAIL]; overlapping spans by the first one's."""
    if not text:
        return text
    spans = sorted(decide(text, model, threshold), key=lambda x: (x[1], -x[2]))
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data masked in the text column; every row and every other column stays."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            text = pa.array([redact(x, model, threshold) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(b.columns)], schema=b.schema.set(at, pa.field(b.schema.names[at], pa.string())))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any names, dotted ones too
    return numbered.mapInArrow(work, numbered.schema).toDF(*docs.columns)
