"""Cross-tokenizer alignment: the tokens of two vocabularies over one text, linked where they end together.

Byte offsets at which a token of A and a token of B both end cut a text into groups; every token of A in a group is linked with every
token of B in it.  Groups come by divide and conquer: of an interval, a common end near the middle is found by bisecting B's ends for A's ends, going
outwards from the middle, and both halves are searched on; an interval without a common end inside is a group.

Texts are first cut where no token of either vocabulary can lie across (see ``Pair``): these are common ends at the top of the
recursion, and the groups of the pieces between them are kept in a bounded cache.

Scale: texts are encoded once, in one narrow pass that writes each document's distinct id pairs.  How many documents hold a pair is counted with partial
sums.  Counts come back in two ways: those of the most frequent pairs (at most HEAD of them, found from a histogram of the
counts) are sent to all tasks, all others meet the rest by a join on the pair, of which none can be hot, as hot pairs are in the head.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from bisect import bisect_left
from collections import ChainMap
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, save, ship
from .tokens import vocabulary

HEAD = 100_000  # pairs whose counts are sent to all tasks, at most
CACHE_PIECES, CACHE_CHARS = 200_000, 48  # pieces in each of a worker's two caches (of late, and before), and the longest one kept
DOCS = 256  # encoded at once
SHIFT = 32  # an id pair is one long: A's id, then B's in the lower bits

#: Marks before which a text may be cut after a letter, if no entry of B holds a letter and the mark after it.
MARKS = ",.;:!?#%&*$"
_CUT = re.compile(r"(?<=[^ ])(?= \S)")
_SPACES = re.compile(r"\s\s|\s\Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_PAIRS: dict[tuple, "Pair"] = {}


def groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """(end in A's tokens, end in B's tokens) of each group, for the tokens' byte ends; the last ends must be equal."""
    out, stack = [], [(0, len(a_ends), 0, len(b_ends))] if a_ends else []
    while stack:
        a0, a1, b0, b1 = stack.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:
            middle = (a0 + a1 - 1) // 2
            for step in range(a1 - a0 - 1):  # middle, one before it, one behind it, two before it ...
                at = middle + (step + 1) // 2 * (1 if step % 2 == 0 else -1)
                if a0 <= at < a1 - 1:
                    j = bisect_left(b_ends, a_ends[at], b0, b1 - 1)
                    if j < b1 - 1 and b_ends[j] == a_ends[at]:
                        cut = at + 1, j + 1
                        break
        if cut:
            stack.append((cut[0], a1, cut[1], b1))
            stack.append((a0, cut[0], b0, cut[1]))
        else:
            out.append((a1, b1))
    return out


def group_links(a: list[int], b: list[int]) -> tuple[list[int], list[int] | None]:
    """Id pairs of a group: one for each pair of occurrences, or, in large groups, the distinct ones and how many occurrences are of each."""
    if len(a) * len(b) <= 256:
        return [x << SHIFT | y for x in a for y in b], None
    (x, n), (y, m) = (np.unique(np.array(v, dtype=np.int64), return_counts=True) for v in (a, b))
    return ((x[:, None] << SHIFT) | y).reshape(-1).tolist(), (n[:, None] * m).reshape(-1).tolist()


class Pair:
    """Two vocabularies: A byte-level, whose pre-tokenizer parts letters, digits, other marks and white space, with one space at most before a word; B
    with U+2581 for spaces, a space put before the text, and bytes for characters that it lacks.

    ``cut`` parts a text where no token of either can lie across: before a space that a visible character follows and no space precedes, and, where no two
    white spaces meet, around line feeds and between a letter and MARKS at the end of a word.  Entries of B are checked on loading: none may hold both sides of
    such a place, else that kind of place is left out.  Pieces without a space before them are encoded behind a line feed, whose ids go again."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.merges = self.a.model
        self.b = SentencePieceProcessor(model_file=b_path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # every byte occurs in the UTF-8 of some character below; its sign in the vocabulary is at the same place
        signs: dict[str, int] = {}
        for char in chain(map(chr, range(0x800)), (chr(k << 12 | 0x800) for k in range(16) if k != 13), (chr(k << 18 | 0x10000) for k in range(4)), "\U00100000"):
            signs.update(zip(level.pre_tokenize_str(char)[0][0], char.encode("utf-8")))
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode("utf-8")
        self.latin = {k: level.pre_tokenize_str(chr(k))[0][0] for k in (32, *range(128, 256))}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes: list[bytes] = []
        for k, piece in enumerate(pieces):
            byte = _BYTE.fullmatch(piece) if self.b.is_byte(k) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8"))
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(pieces))))
        self.by_space = not any(re.search("[^▁]▁", x) for x in pieces)
        self.by_line = not any("\n" in x for x in pieces)
        self.marks = "".join(m for m in MARKS if not any(re.search(r"[^\W\d_]" + re.escape(m), x) for x in pieces))
        self.cache: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text that starts with a space."""
        if not self.by_space or _SPACES.search(text):
            return _CUT.split(text) if self.by_space else [text]
        out = []
        for piece in text[1:].split(" "):
            piece = " " + piece
            if not self.by_line:
                out.append(piece)
                continue
            for k, part in enumerate(piece.split("\n")) if "\n" in piece else ((0, piece),):
                if k:
                    out.append("\n")
                word = part.rstrip(self.marks)
                if word != part and word[-1:].isalpha():  # the marks go apart; what B puts before them goes with the guard
                    out.append(word)
                    part = part[len(word):]
                out.append(part)
        return out

    def _text(self, a: list[int], b: list[int]) -> str:
        return f"{','.join([self.a_text[k] for k in a])}|{','.join([self.b_text[k] for k in b])}"

    def _align(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(A's tokens, B's tokens, groups, links, the groups as text, pairs, times) of a text with its leading space; None where bytes differ."""
        a_parts, b_parts = [self.a_bytes[k] for k in a], [self.b_bytes[k] for k in b]
        raw = text.encode("utf-8")
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        if len(a) * len(b) <= 256 and (len(a) == 1 or len(b) == 1):  # nothing to divide
            return len(a), len(b), 1, len(a) * len(b), self._text(a, b), tuple([x << SHIFT | y for x in a for y in b]), None
        a0 = b0 = links = 0
        texts, pairs, times = [], [], None
        cuts = groups(list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts))))
        for a1, b1 in cuts:
            own_a, own_b = a[a0:a1], b[b0:b1]
            links += len(own_a) * len(own_b)
            texts.append(self._text(own_a, own_b))
            found, many = group_links(own_a, own_b)
            if many and times is None:
                times = [1] * len(pairs)
            pairs += found
            if times is not None:
                times += many or [1] * len(found)
            a0, b0 = a1, b1
        return len(a), len(b), len(cuts), links, ";".join(texts), tuple(pairs), times

    def whole(self, text: str) -> tuple | None:
        """The alignment of a text (without the space before it), encoded in one piece."""
        return self._align(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def _learn(self, pieces: list[str]) -> dict[str, tuple | None]:
        # B puts a space before what it encodes: the piece's own, or one that goes again together with the guard
        b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        b = [y if p[0] == " " else y[2:] for p, y in zip(pieces, b)]
        merge, latin = self.merges.tokenize, self.latin
        a = {}
        for p in pieces:  # single words of Latin letters go straight to the merges
            word = p[1:] if p[0] == " " else p
            if word.isalpha():
                if p.isascii():
                    a[p] = [t.id for t in merge(latin[32] + word if p[0] == " " else word)]
                elif max(word) <= "\xff":
                    a[p] = [t.id for t in merge(p.translate(latin))]
        rest = [p for p in pieces if p not in a]
        a.update(zip(rest, (x.ids for x in self.a.encode_batch_fast(rest, add_special_tokens=False))))
        return {p: self._align(p, a[p], y) for p, y in zip(pieces, b)}

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """The alignments of texts; None for texts without tokens.  The last two values are sorted arrays, each pair once."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        known, older = self.cache, self.older
        missing = set(chain.from_iterable(cut)).difference(known)
        known.update((p, older[p]) for p in missing.intersection(older))
        new = self._learn(list(missing.difference(older)))
        table = ChainMap(new, known) if any(len(p) > CACHE_CHARS for p in new) else known
        known.update((p, v) for p, v in new.items() if len(p) <= CACHE_CHARS)
        out = []
        for text, pieces in zip(texts, cut):
            found = [table[p] for p in pieces]
            if None in found:
                whole = self.whole(text) if len(found) > 1 else None
                found = [whole] if whole else []
            out.append(_joined(found) if found else None)
        return out


def _joined(found: list[tuple]) -> tuple:
    n_a, n_b, n_groups, n_links, texts, pairs, times = zip(*found)
    counts = sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(texts)
    flat = np.fromiter(chain.from_iterable(pairs), dtype=np.int64)
    if not any(times):
        return *counts, *np.unique(flat, return_counts=True)
    weights = np.fromiter(chain.from_iterable(t or repeat(1, len(p)) for p, t in zip(pairs, times)), dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    return *counts, flat[first], np.add.reduceat(weights[order], first)


def pair_of(a_path: str, b_path: str) -> Pair:
    """The worker's vocabularies; kept between tasks."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _lists(values: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.array(offsets), np.concatenate([*values, np.zeros(0, dtype=np.int64)])


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for every row of ``docs``."""
    def work(batches):
        tool = pair_of(a_path, b_path)
        none = (0, 0, 0, 0, None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                found = [x or none for x in tool.align(part.column(2).to_pylist())]
                hashes = ["" if x[4] is None else hashlib.sha256(x[4].encode("ascii")).hexdigest() for x in found]
                offsets, pairs = _lists([x[5] for x in found])
                _, times = _lists([x[6] for x in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([x[k] for x in found], pa.int64()) for k in range(4)], pa.array(hashes, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(work, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each id pair linked, and whether that is the most for A's id."""
    counts = save(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    a = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A: its vocabulary bounds them
    return save(counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-best")


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent pairs, at most so many, and all others."""
    size = F.floor(F.log2("n") * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    low, taken = math.inf, 0  # at most eight sizes for each doubling
    for size_, pairs in sizes:
        taken += pairs
        if taken > most:
            break
        low = size_
    least = F.lit(float(low))
    return counts.where(size >= least), counts.where(size < least)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``n_best`` counts the links whose id pair is linked in as many documents as any pair of its A id is; ``count_sum`` adds these document counts over
    all links.  Texts that are null, empty, or whose tokens' bytes differ from a space and the text have no
    tokens: zeros and an empty digest.  Repeated rows and null ids are rows of their own; an empty table gives no
    rows; other columns are not read, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    rows = save(aligned(docs, a_path, b_path, id_col, text_col), "alignment-rows")
    counts = pair_counts(rows)
    frequent, others = _head(counts, head)
    table = frequent.orderBy("pair").toArrow()  # at most ``head`` rows
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def sums(batches):
        pair, n, best = sent.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            sizes = np.asarray(pairs.value_lengths())
            of = np.repeat(np.arange(len(sizes)), sizes)
            flat = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            total, most = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            np.add.at(total, of[hit], n[at[hit]] * times[hit])
            np.add.at(most, of[hit], best[at[hit]] * times[hit])
            left = np.bincount(of[~hit], minlength=len(sizes))
            offsets = pa.array(np.r_[0, np.cumsum(left)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in plain], pa.array(total), pa.array(most), pa.ListArray.from_arrays(offsets, pa.array(flat[~hit])),
                 pa.ListArray.from_arrays(offsets, pa.array(times[~hit].astype(np.int32)))], names=[*plain, "total", "most", "pairs", "times"])

    plain = [c for c in rows.columns if c not in ("pairs", "times")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in plain]
    part = save(rows.mapInArrow(sums, ", ".join([*fields, "total long", "most long", "pairs array<long>", "times array<int>"])), "alignment-sums")
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = rare.join(others, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_total"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_most"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return part.drop("pairs", "times").join(met, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", more("most", "more_most").alias("n_best"), more("total", "more_total").alias("count_sum"), "groups_sha256")
