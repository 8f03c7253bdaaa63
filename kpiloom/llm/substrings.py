"""Substring de-duplication by sliding sentence spans.

Texts are cut into sentences (long sentences into parts of at most
MAX_SENTENCE words).  Every run of RUN consecutive sentences is hashed; where these
hold fewer than MIN_WORDS words, as many more sentences as it takes.  Over all documents, a run that occurs more than
once keeps its first place, by document id, then position; sentences covered
by any later occurrence are removed from their documents.

With ``passage`` set, every window of that many words that has an earlier place goes as
well, wherever sentences begin or end.  Of each window the least hash of GRAM words marks an
anchor, the same in all its occurrences; only windows around anchors that occur more than once
are hashed, which loses none.  Left out are the windows inside stretches of runs that stand side by side in one
document with a smaller id too: the runs remove their words, and the other document holds the windows.

Scale: runs are shuffled twice on their 128-bit hash: once to count them and find first
places (with partial aggregation), once to meet the repeated ones.  The second join has unique
hashes on one side, so a passage that a third of all documents share is split by adaptive
skew handling; no list of occurrences is ever gathered.  Texts move once, by document id, to be cut.
For passages, anchors (about one in sixteen words) go with the runs; windows are shuffled in the same two steps,
and texts move a second time, to meet their anchors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, save, ship

RUN, MIN_WORDS, MAX_SENTENCE = 3, 15, 24
PASSAGE = 51  # words; what the registered query finds wherever it starts
GRAM = 20  # words of an anchor, in passages longer than that
PART = 200_000  # words hashed at once

_WORD = re.compile(r"\S+")


def sentences(text: str, most: int = MAX_SENTENCE) -> list[tuple[int, int]]:
    """(start, end) of each sentence with a word, in order.

    A sentence ends after full stops, question or exclamation marks before white
    space, and at a line feed; every ``most`` words it is cut.  The white space between
    two sentences belongs to neither."""
    out: list[tuple[int, int]] = []
    start = end = words = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        if words and (words >= most or text[end - 1] in ".!?" or text.find("\n", end, s) >= 0):
            out.append((start, end))
            words = 0
        if not words:
            start = s
        words += 1
        end = e
    if words:
        out.append((start, end))
    return out


def sentence_words(text: str, most: int = MAX_SENTENCE) -> list[list[str]]:
    """The words of each of ``sentences(text)``."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        start = 0
        for end in [k for k, w in enumerate(words, 1) if w[-1] in ".!?" or k == len(words)]:
            if end - start <= most:
                out.append(words[start:end])
            else:
                out += [words[k:min(k + most, end)] for k in range(start, end, most)]
            start = end
    return out


def run_places(sizes: list[int], run: int = RUN, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of at least ``run`` sentences and ``min_words`` words: for each sentence the
    shortest that starts with it and the shortest that ends with it, so that any longer passage is covered to both its ends."""
    total = [0, *accumulate(sizes)]
    if all(b - a >= min_words for a, b in zip(total, total[run:])):
        return [(k, k + run) for k in range(len(sizes) - run + 1)]
    found: set[tuple[int, int]] = set()
    end = 0
    for k in range(len(sizes)):
        end = max(end, k + run)
        while end <= len(sizes) and total[end] - total[k] < min_words:
            end += 1
        if end > len(sizes):
            break
        found.add((k, end))
    start = len(sizes)
    for k in range(len(sizes), 0, -1):
        start = min(start, k - run)
        while start >= 0 and total[k] - total[start] < min_words:
            start -= 1
        if start < 0:
            break
        found.add((start, k))
    return sorted(found)


def runs(text: str, run: int = RUN, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes, bool]]:
    """(first word, last + 1, 128-bit hash, whether it is the first such run of the text) of each run."""
    words = sentence_words(text)
    joined = [" ".join(x) for x in words]
    at = [0, *accumulate(len(x) for x in words)]
    seen: set[bytes] = set()
    out = []
    for k, end in run_places([len(x) for x in words], run, min_words):
        h = xxhash.xxh3_128_digest(" ".join(joined[k:end]))
        out.append((at[k], at[end], h, h not in seen))
        seen.add(h)
    return out


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling (the last step overlaps)."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = op(a[:-step], a[step:])
        done += step
    return a


def _blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _parts(texts: list[str | None], passage: int):
    """(numbers of texts, 128-bit word hashes, text of each word, whether a passage of one text starts at a word) of texts of some PART words."""
    numbers, words, sizes = [], [], []

    def part():
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)
        of = np.repeat(np.arange(len(sizes)), sizes)
        return np.array(numbers), h, of, of[:-passage + 1] == of[passage - 1:]

    for k, text in enumerate(texts):
        own = text.split() if text else []
        if len(own) >= passage:
            numbers.append(k)
            sizes.append(len(own))
            words += own
            if len(words) >= PART:
                yield part()
                numbers, words, sizes = [], [], []
    if words:
        yield part()


def _gram(passage: int) -> int:
    return min(GRAM, passage)


def anchors(texts: list[str | None], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of the anchors: in each window of ``passage`` words, the places of the least hash of GRAM words."""
    gram = _gram(passage)
    width, out = passage - gram + 1, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for numbers, h, of, whole in _parts(texts, passage):
        grams = _slide(h[:, 0], gram, _blend) | np.uint64(1)
        least = np.where(whole, _slide(grams, width, np.minimum), np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == grams)
        start = np.searchsorted(of, of[at])
        out.append((numbers[of[at]], at - start, grams[at].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def stretches(found: list[tuple[int, int | None]], passage: int = PASSAGE) -> list[tuple[int, int]]:
    """(first word, last + 1) of each stretch of ``passage`` words or more that runs with the same key cover without a gap; ``found``: (place, key)."""
    out, last = [], {}
    for place, key in sorted(x for x in found if x[0] >= 0 and x[1] is not None):
        start, end = place >> 32, place & 0xFFFF_FFFF
        span = last.get(key)
        if span and start <= span[1]:
            span[1] = max(span[1], end)
        else:
            last[key] = span = [start, end]
            out.append(span)
    return [(s, e) for s, e in out if e - s >= passage]


def windows(texts: list[str | None], near: list[list[int]], passage: int = PASSAGE,
            known: list[list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, 128-bit hash, whether it is, or overlaps, the first such window of the text) of each window
    of ``passage`` words that holds one of the anchors at the words ``near`` of its text and does not lie within
    one of the stretches ``known`` (first word, last + 1)."""
    gram = _gram(passage)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, bool))]
    for numbers, h, of, whole in _parts(texts, passage):
        starts = np.searchsorted(of, np.arange(len(numbers)))
        at = np.array([s + w for s, k in zip(starts.tolist(), numbers.tolist()) for w in near[k]], np.int64)
        open_ = np.zeros(len(whole) + 1, np.int64)
        np.add.at(open_, np.maximum(at + gram - passage, 0), 1)
        np.add.at(open_, np.minimum(at + 1, len(whole)), -1)
        wanted = (np.cumsum(open_)[:-1] > 0) & whole
        for s, k in zip(starts.tolist(), numbers.tolist()):
            for first, end in known[k] if known else ():
                wanted[s + first:s + end - passage + 1] = False
        at = np.flatnonzero(wanted)
        own = np.stack([_slide(h[:, k], passage, _blend)[at] for k in (0, 1)], axis=1)
        _, first, same = np.unique(own[:, 0] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        out.append((numbers[of[at]], at - starts[of[at]], own.view(np.int64), at - at[first[same]] < passage))
    return tuple(np.concatenate(x) for x in zip(*out))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): ``version`` tells texts of rows with the same id apart."""
    text = F.col(quoted(text_col))
    return docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def spans(texts: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, passage: int | None = None) -> DataFrame:
    """(id, version, place, own, h1, h2): every run of every text; ``place``: first word * 2^32 + (last + 1); ``own``: the first of its kind in the text.

    With ``passage``, its anchors too; their place is -1 - word."""
    ship(texts.sparkSession)

    def work(batches):
        for b in batches:
            found = [runs(x, run, min_words) if x else [] for x in b.column(2).to_pylist()]
            row = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            hashes = np.frombuffer(b"".join(r[2] for x in found for r in x), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array([(r[0] << 32) + r[1] for x in found for r in x], pa.int64()),
                 pa.array([r[3] for x in found for r in x], pa.bool_()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])],
                names=_SPAN)
            if passage:
                text, word, h = anchors(b.column(2).to_pylist(), passage)
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array(-1 - word), pa.array(np.ones(len(word), bool)),
                     pa.array(h), pa.array(np.zeros(len(h), np.int64))], names=_SPAN)

    return texts.mapInArrow(work, _span_type(texts))


def passage_spans(marked: DataFrame, passage: int) -> DataFrame:
    """(id, version, place, own, h1, h2) of the windows around the anchors of ``marked`` (id, version, text, found), but
    for those within known stretches; ``found``: places and keys of ``later_places``; ``place``: -1 - first word."""
    ship(marked.sparkSession)

    def work(batches):
        for b in batches:
            place, key = b.column(3).flatten().flatten()
            keys, ends = key.to_pylist(), b.column(3).value_lengths().to_numpy().cumsum().tolist()
            places = place.to_pylist()
            near, known = [], []
            for start, end in zip([0, *ends], ends):
                runs_from = bisect_left(places, 0, start, end)  # sorted: anchors, then runs
                near.append([-1 - p for p in places[start:runs_from]])
                known.append(stretches(list(zip(places[runs_from:end], keys[runs_from:end])), passage))
            text, word, h, own = windows(b.column(2).to_pylist(), near, passage, known)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(-1 - word), pa.array(own),
                 pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=_SPAN)

    return marked.mapInArrow(work, _span_type(marked))


_SPAN = ["id", "version", "place", "own", "h1", "h2"]


def _span_type(texts: DataFrame) -> T.StructType:
    return T.StructType([texts.schema["id"], texts.schema["version"], T.StructField("place", T.LongType()), T.StructField("own", T.BooleanType()),
                         T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def later_places(found: DataFrame, anchored: bool = False) -> DataFrame:
    """(id, version, found): of each text, the runs or windows whose first place is in another document or earlier in it.

    ``found``: (place, key), sorted.  With ``anchored``, places below 0 are anchors, and stay wherever there is more than one;
    a run that a document with a smaller id holds too has a key, the same for all runs that stand there at the same distance
    (in words) from here.  Which of several texts or places with that id is taken doesn't matter: each holds the run."""
    where = F.shiftleft(F.col("version"), 32).bitwiseOR(F.shiftright("place", 32))
    firsts = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"),
                                           *([F.min_by(where, "id").alias("at")] if anchored else []))
    firsts = firsts.where("n > 1").drop("n")
    firsts = save(firsts, "repeated-runs")  # read back, so that both sides of the join are dealt anew and a hot run can be split
    other = ~F.col("id").eqNullSafe(F.col("first"))
    later = other | ~F.col("own")
    key = F.lit(None).cast("long")
    if anchored:
        shift = F.col("at").bitwiseAND(0xFFFF_FFFF) - F.shiftright("place", 32)
        key = F.when((F.col("place") >= 0) & F.col("id").isNotNull() & other, F.xxhash64("first", F.shiftright("at", 32), shift))
        later = later | (F.col("place") < 0)
    again = found.join(firsts, ["h1", "h2"]).where(later)
    return again.groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("place", key.alias("key")))).alias("found"))


def cut(text: str, places: list[int], passage: int = PASSAGE) -> tuple[str, int]:
    """(text without the sentences covered by the runs, and the words by the windows (below 0), at ``places`` and the
    white space between them, number of sentences of which something is removed)."""
    if not places:
        return text, 0
    at = np.array(places, np.int64)
    first = np.where(at < 0, -1 - at, at >> 32)
    end = np.where(at < 0, passage - 1 - at, at & 0xFFFF_FFFF)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))  # what overlaps or abuts goes as one
    first, end = first[new], end[np.append(new[1:], len(end)) - 1]
    words = [m.span() for m in _WORD.finditer(text)]
    out, kept = [], 0
    for a, b in zip(first.tolist(), end.tolist()):
        out.append(text[kept:words[a][0]])
        kept = words[b - 1][1]
    starts = np.cumsum([0] + [len(x) for x in sentence_words(text)])
    touched = np.zeros(len(starts), np.int64)
    np.add.at(touched, np.searchsorted(starts, first, side="right") - 1, 1)
    np.add.at(touched, np.searchsorted(starts, end), -1)
    return "".join([*out, text[kept:]]), int((np.cumsum(touched) > 0).sum())


def _with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    places = places.withColumnsRenamed({"id": "g_id", "version": "g_version"})
    return texts.join(places, texts["id"].eqNullSafe(places["g_id"]) & (texts["version"] == places["g_version"]), how)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS,
          passage: int | None = None) -> DataFrame:
    """(id, n_removed, text) for every row of ``docs``: its text without repeated passages; ``n_removed``: the
    sentences of which something is removed.

    First places go by id, so of two copies the one with the smaller id keeps its
    text.  Rows with the same id are one document, as are rows without an id: a passage stays in each of
    their texts if it stays in one (rows with an id come first).  A null text stays null; an
    empty table gives no rows; other columns are not read, whatever their names."""
    texts = _texts(docs, id_col, text_col)
    gone = later_places(spans(texts, run, min_words, passage), passage is not None)
    if passage:
        gone = save(gone, "run-places")  # for the anchors and, with the windows, for the cuts
        anchored = gone.where(F.exists("found", lambda x: x["place"] < 0))
        marked = _with_places(texts, anchored, "inner").select("id", "version", "text", "found")
        windows_ = later_places(save(passage_spans(marked, passage), "passage-windows"))
        runs_ = gone.select("id", "version", F.filter("found", lambda x: x["place"] >= 0).alias("found")).where("size(found) > 0")
        gone = runs_.unionByName(windows_).groupBy("id", "version").agg(F.flatten(F.collect_list("found")).alias("found"))
    gone = gone.select("id", "version", F.col("found.place").alias("places"))
    joined = _with_places(texts, gone, "left").select("id", "text", "places")

    def work(batches):
        for b in batches:
            text, places = b.column(1), b.column(2)
            at = [k for k, x in enumerate(places.is_valid().to_pylist()) if x]
            some = pa.array(at, pa.int64())
            made = [cut(x, p, passage or PASSAGE) for x, p in zip(text.take(some).to_pylist(), places.take(some).to_pylist())]
            removed = np.zeros(len(text), dtype=np.int64)
            removed[at] = [n for _, n in made]
            if at:
                values = text.to_pylist()
                for k, (x, _) in zip(at, made):
                    values[k] = x
                text = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed), text], names=["id", "n_removed", "text"])

    fields = [texts.schema["id"], T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]
    return joined.mapInArrow(work, T.StructType(fields))
