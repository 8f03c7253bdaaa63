"""Tables for the operators' tests: awkward documents, and the smallest test tables."""

import os

SF = os.environ.get("KPILOOM_TEST_SF", "/root/testdata/sf0.001")

PROSE = ("The quick brown fox jumps over the lazy dog near the old river bank. It was a long day for everyone in the small town. "
         "Nobody knew what the next morning would bring to them all.")
LONG = " ".join(f"word{k % 977} item{k % 31}" for k in range(30_000))

#: (doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, and copies.
AWKWARD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "a"), (4, "", None, None),
    (5, " \t\n\x0b\x0c\r", "en", "b"), (6, LONG, "en", "b"), (None, PROSE + " Extra.", "de", "b"), (None, None, None, None),
    (7, "a a a a a a a a a a a a", "en", "a"), (8, "één ünï 日本語 😀 <|im_end|>\nline\nline\n\nline", "fr", "c"),
    (9, PROSE.replace("fox", "cat"), "en", "c"), (10, "x" * 5000, "en", "a"),
]


def documents(spark, rows=AWKWARD):
    """With columns whose names clash with what the operators make inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["id", "n", "host", "kept", "measures", "fingerprint", "root", "tokens", "p", "window", "node", "dotted.name"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def components(n, pairs):
    """Smallest member of each item's component."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
