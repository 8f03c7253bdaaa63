"""Alignment against all common ends found by sets, and counts by plain loops."""

import hashlib
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from random import Random

import cases
from kpiloom.llm import alignment, queries
from kpiloom.llm.tokens import vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@lru_cache
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    # the byte-level alphabet: printable Latin-1 signs stand for themselves, the others follow from U+0100 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [k for k in range(256) if k not in own]
    signs = {chr(k): k for k in own} | {chr(256 + n): k for n, k in enumerate(other)}
    return a, SentencePieceProcessor(model_file=PATHS[1]), signs


def plain(text):
    """Groups of a text, as lists of ids; [] without tokens."""
    a, b, signs = tools()
    if not text:
        return []
    enc = a.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(signs[c] for c in t) for t in enc.tokens]
    ids = b.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, b.encode(text, out_type=str))]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return []

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    a_ends, b_ends = ends(a_bytes), ends(b_bytes)
    both = sorted(set(a_ends) & set(b_ends))
    out = [([], []) for _ in both]
    for side, tokens in enumerate((zip(enc.ids, a_ends), zip(ids, b_ends))):
        for k, e in tokens:
            out[bisect_left(both, e)][side].append(k)
    return out


def expected(rows):
    found = [(i, plain(t)) for i, t in rows]
    docs = defaultdict(set)
    for n, (_, gs) in enumerate(found):
        for a, b in gs:
            for x in a:
                for y in b:
                    docs[x, y].add(n)
    best = defaultdict(int)
    for (x, _), held in docs.items():
        best[x] = max(best[x], len(held))
    out = []
    for i, gs in found:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
                    sum(len(docs[p]) == best[p[0]] for p in links), sum(len(docs[p]) for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_divide_and_conquer_finds_all_common_ends():
    rng = Random(1)
    for _ in range(500):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
        want = [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
        assert alignment.groups(a, b) == want
    assert alignment.groups([], []) == []
    long = list(range(2, 200_001, 2))
    assert alignment.groups(long, [k + 1 for k in long[:-1]] + [long[-1]]) == [(100_000, 100_000)]
    assert len(alignment.groups(long, long)) == 100_000


def test_cut_texts_give_what_whole_texts_give():
    rng = Random(2)
    tool = alignment.Pair(*PATHS)
    assert tool.by_line and tool.cut(" one two; three\nFour") == [" one", " two", ";", " three", "\n", "Four"]
    parts = [" ", "  ", "\n", "\n\n", "\t", " the", "the", "don't", " 's", "é", "日本語", "　", " ", "​", "😀", "▁", "<s>", "<0x41>", "<|endoftext|>",
             "123", " 4", "...", "\x00", "\x1c", "\x85", "\r\n", "ﬁ", "é", "ünd", "--", "Word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "▁", "a▁b c"]
    for _ in range(2):  # the second time from the cache
        for text, got in zip(texts, tool.align(texts)):
            gs = plain(text)
            assert (got is None) == (not gs), text
            if got:
                assert got[4] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs), text
                assert got[:4] == (sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(len(a) * len(b) for a, b in gs))


def test_awkward_documents_whatever_the_head(spark):
    rows = [(r[0], r[1]) for r in cases.AWKWARD] + [(20, "a▁b c"), (21, "<|endoftext|> <s>")]
    df = cases.documents(spark, [*cases.AWKWARD, (20, "a▁b c", "en", "a"), (21, "<|endoftext|> <s>", "en", "a")])
    want = expected(rows)
    for head in (0, 7, alignment.HEAD):
        assert collected(alignment.align(df, head=head)) == want
    assert collected(alignment.align(df.limit(0))) == []


def test_the_query_over_the_table(spark):
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, cases.SF)
    rows = [tuple(r) for r in cases.table(spark, "documents").select("doc_id", "text").collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert collected(got) == expected(rows)
