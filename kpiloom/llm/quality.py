"""Host-level quality rules with an empirical beta prior (DataFrame functions only).

Every document is measured inside its row (words, symbols, repeated lines,
repeated 5-word windows) and fails the base rule or not.  Failures are then
counted by host; each host's failure rate is shrunk towards the rate of all hosts with a
beta prior fitted to the spread of the hosts' own rates, and a host whose
shrunk rate is above ``max_host_rate`` is rejected with all its documents.

Scale: the measures are narrow; only (host, rows, failures) is aggregated, with
partial sums before the shuffle, so a host with a third of all rows costs
nothing extra; verdicts are joined back as the list of rejected hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, free_name, let, quoted, save, whole_text

SYMBOLS = "[#*$%&|<>]"  # Fixed value: the characters that count as symbols.
WINDOW = 5
FEW = 64  # up to so many repeated windows are looked up one by one, more by sorting; the count is the same
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _windows(words: Column) -> Column:
    """64-bit hashes of all runs of WINDOW words, in order."""
    def runs(h):
        firsts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(firsts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice."""
    def add(seen, at):
        return F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"))

    def total(starts):
        return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), add, lambda x: x["n"])

    def few(values):
        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(values, F.get(hashes, i)))

    def many(pairs):
        same = lambda h, k: F.coalesce(F.get(pairs, k)["h"] == h, F.lit(False))
        hit = F.filter(pairs, lambda x, k: same(x["h"], k - 1) | same(x["h"], k + 1))
        return F.sort_array(F.transform(hit, lambda x: x["at"]))

    def starts(values):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(values) <= FEW, few(values)).otherwise(let(pairs, many))

    twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.get(s, k - 1) == h)))
    return let(twice, lambda values: total(starts(values)))


def _repeat_words(hashes: Column) -> Column:
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))


def measure(docs: DataFrame, text_col: str = "text", as_struct: str = "measures") -> DataFrame:
    """``docs`` with a struct column of MEASURES (long) and ``base_failed``.

    The windows are told apart by 64-bit hashes within one document.  A null
    text counts as empty: no words, so it fails the base rule."""
    text = whole_text(text_col)
    in_words = let(_words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"),
        let(_windows(w), _repeat_words).alias("n_repeat_words")))
    values = {"n_symbols": F.regexp_count(text, F.lit(SYMBOLS)), "n_dup_lines": _dup_lines(text)}

    def both(x):
        m = {k: (values[k] if k in values else x[k]).cast("long") for k in MEASURES}
        failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"].cast("long") > MAX_REPEAT_PERCENT * x["n_words"].cast("long"))
        return F.struct(*[v.alias(k) for k, v in m.items()], failed.alias("base_failed"))

    return docs.select(*[F.col(quoted(c)) for c in docs.columns if c != as_struct], let(in_words, both).alias(as_struct))


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, k): rows and failures of every host; null is a host of its own."""
    return rows.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("k"))


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior fitted to the hosts' rates by moments: two numbers come to the driver.

    The mean is that of all rows; the strength a + b follows from the spread of
    the hosts' rates beyond what chance within hosts explains, held between
    MIN_STRENGTH and MAX_STRENGTH.  No rows: (1, 1)."""
    s = rates.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("k").alias("k"),
                  F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not s["n"]:
        return 1.0, 1.0
    n, m = float(s["n"]), s["k"] / s["n"]
    spread = max(0.0, s["kk"] - n * m * m)
    chance = (s["hosts"] - 1) * m * (1 - m)
    size = n - s["nn"] / n
    between = (spread - chance) / size if size > 0 else 0.0
    strength = m * (1 - m) / between - 1 if between > 0 else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    return m * strength, (1 - m) * strength


def rejected_hosts(rates: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host) of the hosts whose shrunk failure rate is above the limit."""
    a, b = beta_prior(rates)
    return rates.where((F.col("k") + F.lit(a)) / (F.col("n") + F.lit(a + b)) > max_host_rate).select("host")


def judge(rows: DataFrame, host: str, failed: str, max_host_rate: float = MAX_HOST_RATE, as_col: str = "kept") -> DataFrame:
    """``rows`` with ``as_col``: neither failed itself nor of a rejected host."""
    rates = save(host_rates(rows, host, failed), "host-rates")
    bad, key = rejected_hosts(rates, max_host_rate), free_name(rows, "bad_host")
    bad = bad.select(F.col("host").alias(key), F.lit(True).alias(key + "_"))
    return (rows.join(bad, rows[host].eqNullSafe(bad[key]), "left")
            .select(*[rows[quoted(c)] for c in rows.columns if c != as_col],
                    (~rows[failed] & F.col(key + "_").isNull()).alias(as_col)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each input row: id, host, MEASURES, base_failed, kept.

    Null and empty texts fail the base rule; a null host is a host of its own;
    repeated rows are judged each; an empty table gives no rows; other columns are not
    read, whatever their names."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(host_col)).alias("host"),
                       F.col(quoted(text_col)).alias("text"))
    rows = measure(rows, "text", "m").select("id", "host", "m.*")
    return judge(save(rows, "quality-measures"), "host", "base_failed", max_host_rate)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source",
              max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass: all columns of ``docs``, rows that fail removed.

    Texts are measured twice (once for the host rates, once to filter), which
    costs less than writing them; nothing but rates is shuffled."""
    m = free_name(docs, "measures")
    rows = measure(docs, text_col, m)
    rates = save(host_rates(rows.select(F.col(quoted(host_col)).alias("host"), F.col(m)["base_failed"].alias("failed")),
                            "host", "failed"), "host-rates")
    bad, key = rejected_hosts(rates, max_host_rate), free_name(docs, "bad_host")
    bad = bad.select(F.col("host").alias(key))
    good = rows.where(~F.col(m)["base_failed"])
    return good.join(bad, good[quoted(host_col)].eqNullSafe(bad[key]), "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
