"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents are counted in cells of source, language and topic.  Raking scales the
cells' token weights to the target of each source, then of each language, then of
each topic, round after round.  A cell's keeping probability is its raked
weight for each token, scaled so that the expected tokens meet the budget, and
never above 1; a document is kept if a number drawn from its id is below that.  Cells that reach 1
lose part of their target to the others; with ``repeat``, p is the expected number of copies instead, documents
come as often as that, and all targets are met.

Scale: one partial aggregation makes the cells; all rounds work on the cells alone, as
aggregations and joins.  Documents meet their cell's probability in one join, whose cell side is
unique, so a source with a third of all rows is split by adaptive skew handling
(and the join is a broadcast while the cells are small by measured size).  The driver sees sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, free_name, quoted, save, whole_text

DIMS = ("source", "lang", "topic")
ALPHA = 0.7  # targets are the present shares to this power, unless given
ROUNDS = 8
BUDGET_SHARE = 0.7  # of all tokens
SEED = "mix-1"

# Patterns that tell topics, first match wins.
TOPICS = (("legal", "[Ll]icen[sc]e|[Cc]opyright|[Rr]ights reserved"), ("records", r"[0-9][0-9][0-9]|\[[A-Z]+\]"), ("promotion", "!!"))
OTHER_TOPIC = "prose"


def topic(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words, and 1 for a text without any."""
    bare = F.btrim(text, F.lit(WORD_SPACE))
    return F.regexp_count(bare, F.lit(r"[\x20\x09-\x0D]+")).cast("long") + 1


def draw(id_: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone (a null id counts as empty)."""
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))), "UTF-8")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) with the tokens of every cell; nulls are values of their own."""
    return rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))


def _with_targets(cells: DataFrame, targets: dict[str, dict[str, float]], alpha: float, total: float) -> DataFrame:
    """``cells`` with the target of its source, language and topic."""
    for dim in DIMS:
        share = F.col("now") / F.lit(total)
        target = F.pow(share, F.lit(alpha))
        given = targets.get(dim)
        if given:
            target = share
            for value, wanted in given.items():
                target = F.when(F.col("value") == value, F.lit(float(wanted))).otherwise(target)
        now = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("now")).select("value", target.alias("t_" + dim))
        cells = cells.join(now, cells[dim].eqNullSafe(now["value"]), "left").drop("value")
    return cells


def _rake(cells: DataFrame) -> DataFrame:
    """One round: weights scaled to the targets of each dimension in turn."""
    for dim in DIMS:
        now = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("w").alias("now"))
        cells = (cells.join(now, cells[dim].eqNullSafe(now["value"]), "left")
                 .withColumn("w", F.col("w") * F.col("t_" + dim) / F.col("now")).drop("value", "now"))
    return cells


def _scale(cells: DataFrame, budget: float) -> float:
    """The factor by which weights for each token become probabilities whose expected tokens meet the budget.

    Cells that reach 1 leave the rest to the others; each step can only add such cells."""
    scale, full = 0.0, -1
    for _ in range(100):
        sure = (F.col("f") * F.lit(scale) >= 1) if full >= 0 else F.lit(False)
        s = cells.agg(F.sum(sure.cast("long")).alias("full"), F.sum(F.when(sure, F.col("tokens")).otherwise(0)).alias("taken"),
                      F.sum(F.when(sure, F.lit(0.0)).otherwise(F.col("f") * F.col("tokens"))).alias("free")).first()
        if s["full"] is None or s["full"] == full or s["free"] <= 0:
            break
        full, scale = s["full"], max(0.0, budget - s["taken"]) / s["free"]
    return scale


def probabilities(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA,
                  rounds: int = ROUNDS, budget_share: float = BUDGET_SHARE, repeat: bool = False) -> DataFrame:
    """``cells_of`` rows -> (source, lang, topic, tokens, p); with ``repeat``, p can be above 1.

    ``targets`` gives shares for named values of a dimension (others keep their present share)."""
    cells = save(cells, "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("p", F.lit(1.0))
    cells = _with_targets(cells.withColumn("w", F.col("tokens") / F.lit(float(total))), targets or {}, alpha, float(total))
    for _ in range(rounds):
        cells = save(_rake(cells), "mix-round")
    cells = save(cells.withColumn("f", F.col("w") / F.col("tokens")).select(*DIMS, "tokens", "f"), "mix-raked")
    if repeat:
        weight = cells.agg(F.sum(F.col("f") * F.col("tokens"))).first()[0]
        return cells.select(*DIMS, "tokens", (F.col("f") * F.lit(budget_share * float(total) / weight)).alias("p"))
    if budget_share >= 1:
        return cells.select(*DIMS, "tokens", F.lit(1.0).alias("p"))
    scale = _scale(cells, budget_share * float(total))
    return cells.select(*DIMS, "tokens", F.least(F.lit(1.0), F.col("f") * F.lit(scale)).alias("p"))


def copies(id_: Column, p: Column) -> Column:
    """How often a document comes: the whole part of p, and once more if its draw is below the rest."""
    return F.floor(p) + (draw(id_) < p - F.floor(p)).cast("long")


def _facts(docs: DataFrame, text_col: str, source_col: str, lang_col: str, names) -> list[Column]:
    text = whole_text(text_col)
    values = {"source": F.col(quoted(source_col)).cast("string"), "lang": F.col(quoted(lang_col)).cast("string"), "topic": topic(text), "tokens": n_tokens(text)}
    return [values[n].alias(n) for n in names]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        **options) -> DataFrame:
    """(id, source, lang, topic, tokens, p, kept) for every row of ``docs``; with ``repeat``, also copies.

    Null sources and languages are values of their own; a null or empty text is
    one token of prose; rows with the same id share one draw; an empty table
    gives no rows; other columns are not read, whatever their names."""
    rows = save(docs.select(F.col(quoted(id_col)).alias("id"), *_facts(docs, text_col, source_col, lang_col, (*DIMS, "tokens"))), "mix-rows")
    p = probabilities(cells_of(rows), **options).select(*[F.col(d).alias("c_" + d) for d in DIMS], "p")
    same = [rows[d].eqNullSafe(p["c_" + d]) for d in DIMS]
    out = (rows.join(p, same[0] & same[1] & same[2], "left").select("id", *DIMS, "tokens", "p")
           .withColumn("kept", draw(F.col("id")) < F.col("p")))
    return out.withColumn("copies", copies(F.col("id"), F.col("p"))) if options.get("repeat") else out


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
           **options) -> DataFrame:
    """The documents that ``mix`` keeps, with the columns of ``docs``; with ``repeat``, a row for each copy.

    Texts are read twice (to count cells, to filter) and never shuffled while the cells can be broadcast."""
    p = save(probabilities(cells_of(docs.select(*_facts(docs, text_col, source_col, lang_col, (*DIMS, "tokens")))), **options), "mix-probabilities")
    c = free_name(docs, "cell")
    cells = p.select(F.struct(*DIMS).alias(c + "_key"), F.col("p").alias(c + "_p"))
    rows = docs.withColumn(c, F.struct(*_facts(docs, text_col, source_col, lang_col, DIMS)))
    same = None
    for d in DIMS:
        equal = rows[c][d].eqNullSafe(cells[c + "_key"][d])
        same = equal if same is None else same & equal
    kept = rows.join(cells, same, "left").where(draw(rows[quoted(id_col)]) < F.col(c + "_p"))
    if options.get("repeat"):
        n = copies(rows[quoted(id_col)], F.col(c + "_p")).cast("int")
        return kept.select(*[rows[quoted(x)] for x in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias(c + "_n")).drop(c + "_n")
    return kept.select(*[rows[quoted(x)] for x in docs.columns])
