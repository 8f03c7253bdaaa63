"""Question operators (Q1-Q8): a table of questions → a table of answers.

Each question row is classified with JVM-side string predicates (relevance
gate, intent, referenced region), then joined to its entity's fact row and
to the facts of the region it names; the answer fields are template renders
chosen by intent.  Without entity keys the fact row is one row and a question
can name twelve regions only, so both are broadcast (bounded size); with keys both are
equi-joins on them.

Prompt messages (Q8) are one row per message; each request points at the last
message of its history, so the tables stay linear in the turns.  Ranks and
totals over earlier turns come from ``ranks.running_before``, which spreads one very long
conversation over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import write_and_read
from .brief import question_prompts, render
from .ranks import running_before

# ---------------------------------------------------------------------------
# Relevance keywords (substring match on the lower-cased text),
# intent keywords in routing order, region words and region codes.
GATE_KEYWORDS = [
    "revenue", "sales", "profit", "margin", "date", "month", "year", "trend",
    "region", "product", "category", "risk", "recommendation", "health", "score",
    "swot", "performance", "grow", "decrease", "decline", "top", "worst",
    "underperform", "invest", "action", "focus", "business", "company", "executive",
    "ceo", "cfo", "coo", "sell", "cost", "cogs", "saas", "retail", "banking",
    "healthcare", "manufacturing", "technology", "telecom", "arr", "churn", "cac",
    "ltv", "customer", "retention", "fraud", "compliance", "digital", "inventory",
    "forecast", "demand", "capacity", "waste", "quality", "r&d", "roi", "development",
    "market", "arpu", "subscriber", "capex", "billing", "outperforming", "summary", "north", "east",
    "west", "south",
]
MIN_TOKENS = 3
DECLINE_WHY = ["why"]
DECLINE_WHAT = ["revenue", "sales"]
DECLINE_HOW = ["decrease", "decline", "drop", "down"]
INTENTS = [  # (intent, keywords, priority); decline and region are handled apart
    ("worst", ["worst", "underperform", "lagging"], "HIGH"),
    ("risk", ["risk", "danger"], "HIGH"),
    ("invest", ["invest", "funding"], "MEDIUM"),
    ("strategy", ["strategic", "initiative", "action", "improve"], "HIGH"),
    ("health", ["health", "score"], "MEDIUM"),
    ("swot", ["swot"], "MEDIUM"),
    ("summary", ["ceo", "summarize", "executive summary", "summary"], "HIGH"),
]
REGION_WORDS = ["north", "south", "east", "west"]
REGION_CODES = ["sp", "rj", "mg", "rs", "pr", "sc", "ba", "pe"]
ANSWER_HEADERS = ["Executive Answer", "Supporting Evidence", "Business Impact", "Recommendation", "Priority"]
REFUSAL_CONFIDENCE = 100
# ---------------------------------------------------------------------------

REFUSAL = "This question is not about the loaded figures."

# Answer templates per intent: (answer, evidence, impact, recommendation);
# a pair = (with profit, without profit).
ANSWERS = {
    "decline": (
        ("Look first at **{worst_product}** among the products and at **{worst_region}** among the regions: they keep "
         "the least of their sales.",
         "The figures show where sales are, not why they fell; nothing sells as much as **{top_product}**."),
        ("Margins: **{worst_product}** **{worst_product_margin}%**, **{worst_region}** **{worst_region_margin}%**.",
         "**{top_product}** sold **{top_product_rev}**."),
        ("All sales together keep **{profit_margin}%**; the score is **{health_score}/100**.",
         "The score is **{health_score}/100**."),
        ("Write down cost and discount of **{worst_product}** month by month and mark the change.",
         "Draw every product's months and mark the turn."),
    ),
    "worst": (
        ("Lowest margins: **{worst_product}** (product), **{worst_region}** (region).",
         "Without profit figures only sales can be compared: every region sells less than **{top_region}**."),
        ("**{worst_product}** **{worst_product_margin}%**; the best seller **{top_product}** **{top_product_margin}%**.",
         "**{top_region}** sold **{top_region_rev}**."),
        ("Profit so far is **{total_profit}**.", "Sales so far are **{total_revenue}**."),
        ("Decide on **{worst_product}**: other price, other cost, or the end of it.",
         "Ask customers in the smallest region what they miss."),
    ),
    "risk": (
        ("A small margin on **{worst_product}**, and one region with much of the business: **{top_region}**.",
         "One product with much of the business: **{top_product}**."),
        ("**{worst_product}** keeps **{worst_product_margin}%**; **{top_region}** sold **{top_region_rev}**.",
         "It sold **{top_product_rev}** of **{total_revenue}**."),
        ("A bad quarter in **{top_region}** shows in the total.", "A bad quarter of **{top_product}** shows in the total."),
        ("Fix the lowest margin that an offer may have.", "Name the product that should come second."),
    ),
    "invest": (
        "Going by sales, **{top_region}** and **{top_product}** come first.",
        "**{top_region}** sold **{top_region_rev}**.",
        "The money meets demand that is on record.",
        "Spend a little in **{top_region}**, compare after a quarter, and only then more.",
    ),
    "strategy": (
        "Find out what **{top_region}** does differently, try it in one other region, and watch the score.",
        "The score is **{health_score}/100** now.",
        "It counts as **{health_status}**; **Robust** starts at 80.",
        "Give each step an owner and a date, and begin with **{top_product}**.",
    ),
    "health": (
        "**{health_score}/100**, which counts as **{health_status}**.",
        "Growth, even months, spread over regions and, where recorded, margin make up the score.",
        "Below 80 there is room; below 60 there is need.",
        "Work on the lowest part of the score.",
    ),
    "swot": (
        "Four views of a **{industry}** business.",
        "Strong: **{top_product}** ({top_product_rev}). Weak: all that sells far less. Chance: **{top_region}**. "
        "Threat: leaning on both.",
        "Strength and threat carry the same names.",
        "Never run out of **{top_product}**, and build one alternative.",
    ),
    "summary": (
        "**{total_revenue}** in sales, most of all from **{top_product}**.",
        "The score is **{health_score}/100**: **{health_status}**.",
        "The total moves with the largest names.",
        "Ask next about one region, or about the lowest margin.",
    ),
    "region": (
        "Figures of **{ref_region}**.",
        ("Sales **{reg_rev}**, margin **{reg_margin}%**.", "Sales **{reg_rev}**."),
        "That is **{reg_share}%** of all sales.",
        ("Compare the margin with that of the whole, **{profit_margin}%**.", "Compare it with **{top_region}**."),
    ),
    "region_missing": (
        "That region is not in the data.",
        "No row carries its name.",
        "So there is nothing to say about it.",
        "Ask again with a name from the table of regions.",
    ),
    "general": (
        "Overview of a **{industry}** business.",
        ("Sales **{total_revenue}**, profit **{total_profit}**.", "Sales **{total_revenue}**."),
        "The score is **{health_score}/100**: **{health_status}**.",
        "Ask about risks, a region, the lowest margin or the score.",
    ),
}
PRIORITY = {"decline": "HIGH", **{i: p for i, _, p in INTENTS}, "region": "MEDIUM", "region_missing": "LOW",
            "general": "LOW"}
ROUTE = ["decline"] + [i for i, _, _ in INTENTS] + ["region", "general"]

REGION_PLACEHOLDERS = {
    "ref_region": lambda: F.col("ref_region"),
    "reg_rev": lambda: S.money("reg_rev"),
    "reg_margin": lambda: S.fmt_fixed("reg_margin", 1),
    "reg_share": lambda: S.fmt_fixed("reg_share", 1),
}


def _has_any(q: Column, words: Sequence[str]) -> Column:
    out = None
    for w in words:
        c = F.contains(q, F.lit(w))
        out = c if out is None else (out | c)
    return out


def n_tokens(text: Column) -> Column:
    parts = F.split(S.py_strip(text), f"{S.PY_SPACE}+")
    return F.size(F.filter(parts, lambda x: x != ""))


def gate(text: Column) -> Column:
    """Q1: short questions pass; longer ones need a business keyword."""
    return (n_tokens(text) < MIN_TOKENS) | _has_any(F.lower(text), GATE_KEYWORDS)


def region_hit(q: Column) -> Column:
    return _has_any(q, REGION_WORDS) | _has_any(q, REGION_CODES)


def intent(text: Column) -> Column:
    """Q2: first matching intent wins."""
    q = F.lower(text)
    e = F.when(_has_any(q, DECLINE_WHY) & _has_any(q, DECLINE_WHAT) & _has_any(q, DECLINE_HOW), "decline")
    for name, words, _ in INTENTS:
        e = e.when(_has_any(q, words), name)
    return e.when(region_hit(q), "region").otherwise("general")


def referenced_region(text: Column) -> Column:
    """Q3: north/south/east/west (capitalised) first, else a region code (upper)."""
    q = F.lower(text)
    e = None
    for w in REGION_WORDS + REGION_CODES:
        label = w.capitalize() if w in REGION_WORDS else w.upper()
        e = F.when(F.contains(q, F.lit(w)), label) if e is None else e.when(F.contains(q, F.lit(w)), label)
    return e


def classify(questions: DataFrame, text_col: str = "question") -> DataFrame:
    t = F.col(text_col)
    return questions.withColumn("accepted", gate(t)).withColumn("intent", intent(t)) \
        .withColumn("ref_region", F.when(F.col("intent") == "region", referenced_region(t)))


def answer_fields(has_profit: bool) -> list[Column]:
    """Q5: the four text fields + priority, by intent (region split on match)."""
    key = F.when((F.col("intent") == "region") & F.col("reg_rev").isNull(), "region_missing") \
        .otherwise(F.col("intent"))
    outs = []
    for i in range(4):
        e = None
        for name, tmpl in ANSWERS.items():
            v = render(tmpl[i], has_profit, extra=REGION_PLACEHOLDERS)
            e = F.when(key == name, v) if e is None else e.when(key == name, v)
        outs.append(e)
    pe = None
    for name, p in PRIORITY.items():
        pe = F.when(key == name, p) if pe is None else pe.when(key == name, p)
    outs.append(pe)
    return outs


def answer_markdown(fields: Sequence[Column]) -> Column:
    """Q6: five '###' sections."""
    parts = []
    for h, v in zip(ANSWER_HEADERS, fields):
        parts.append(F.concat(F.lit(f"### {h}\n"), v))
    return F.concat_ws("\n\n", *parts)


def _one_each(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``facts`` with a failure at run time where an entity has several rows."""
    rest = [c for c in facts.columns if c not in by]
    g = facts.groupBy(*by).agg(F.first(F.struct(*rest)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    check = F.when(F.col("_n") > 1, F.raise_error(F.lit("an entity has more than one fact row"))).otherwise(F.col("_f"))
    return g.select(*by, check.alias("_f")).where(F.col("_f").isNotNull()).select(*by, "_f.*")


def region_labels() -> list[str]:
    """The region names that a question can refer to."""
    return [w.capitalize() for w in REGION_WORDS] + [w.upper() for w in REGION_CODES]


def _with_regions(rows: DataFrame, region_facts: DataFrame, has_profit: bool, by: Sequence[str]) -> DataFrame:
    """``rows`` with the revenue and margin of the region that the question names."""
    margin = F.col("margin") if has_profit else F.lit(0.0)
    rf = region_facts.where(F.col("region").isin(region_labels())).select(
        *[F.col(b).alias(f"_r{k}") for k, b in enumerate(by)], F.col("region").alias("_reg"),
        F.col("revenue").alias("reg_rev"), margin.alias("reg_margin"))
    if not by:
        return rows.join(F.broadcast(rf), rows["ref_region"] == rf["_reg"], "left").drop("_reg")
    rf = write_and_read(rf, "region-facts")  # read back, so that both sides are dealt anew and a hot (entity, region) can be split
    # questions without a region meet nothing; their key is spread so that they don't pile up in one task
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("question"), F.lit(997)).cast("string"))
    rows = rows.withColumn("_key", F.coalesce("ref_region", spread))
    same = rows["_key"] == rf["_reg"]
    for k, b in enumerate(by):
        same = same & rows[b].eqNullSafe(rf[f"_r{k}"])
    return rows.join(rf, same, "left").drop("_reg", "_key", *[f"_r{k}" for k in range(len(by))])


def _with_entity(rows: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return (rows.withColumn("_one", F.lit(1))
                .join(F.broadcast(_one_each(facts, ()).withColumn("_one", F.lit(1))), "_one").drop("_one"))
    one = _one_each(facts, by)
    one = one.select(*[F.col(b).alias(f"_e{k}") for k, b in enumerate(by)], *[c for c in one.columns if c not in by])
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & rows[b].eqNullSafe(one[f"_e{k}"])
    return rows.join(one, same).drop(*[f"_e{k}" for k in range(len(by))])


def answer_confidence(questions: DataFrame, confidence: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                      text_col: str = "question") -> DataFrame:
    """Q7: the data confidence of an accepted question's entity, else the refusal's."""
    c = questions.withColumn("accepted", gate(F.col(text_col)))
    j = _with_entity(c, confidence.select(*by, F.col("confidence").alias("data_confidence")), by)
    return j.select(*keys, "accepted", F.when(F.col("accepted"), F.col("data_confidence"))
                    .otherwise(F.lit(REFUSAL_CONFIDENCE)).cast("int").alias("confidence"))


def region_answers(questions: DataFrame, region_facts: DataFrame, totals: DataFrame, has_profit: bool, keys: Sequence[str],
                   by: Sequence[str] = (), text_col: str = "question") -> DataFrame:
    """Q4: questions about a region, with what that region sold: revenue, margin and share of the entity's total.

    ``totals``: ``(by…, total_revenue)``."""
    c = classify(questions, text_col).where(F.col("intent") == "region").withColumn("question", F.col(text_col))
    j = _with_regions(_with_entity(c, totals.select(*by, "total_revenue"), by), region_facts, has_profit, by)
    return j.select(*keys, "ref_region", F.col("reg_rev").isNotNull().alias("region_found"), F.col("reg_rev").alias("revenue"),
                    F.when(F.col("reg_rev").isNotNull(), F.col("reg_margin")).alias("margin"),
                    (F.col("reg_rev") / F.col("total_revenue") * 100.0).alias("share"))


def answer_questions(questions: DataFrame, facts: DataFrame, region_facts: DataFrame, has_profit: bool,
                     confidence: DataFrame, keys: Sequence[str], text_col: str = "question", by: Sequence[str] = ()) -> DataFrame:
    """Q4-Q7 over a questions table (with the entity keys ``by``, if any).

    ``facts``: one row per entity (its brief facts incl. ``industry``);
    ``region_facts``: ``(by…, region, revenue, margin)``; ``confidence``: one row per entity
    with ``confidence`` (K2).
    """
    c = classify(questions, text_col).withColumn("question", F.col(text_col))
    j = _with_entity(c, facts, by)
    j = _with_entity(j, confidence.select(*by, F.col("confidence").alias("data_confidence")), by)
    j = _with_regions(j, region_facts, has_profit, by)
    j = j.withColumn("reg_share", F.col("reg_rev") / F.col("total_revenue") * 100.0)
    fields = answer_fields(has_profit)
    reply = F.when(F.col("accepted"), answer_markdown(fields)).otherwise(F.lit(REFUSAL))
    conf = F.when(F.col("accepted"), F.col("data_confidence")).otherwise(F.lit(REFUSAL_CONFIDENCE))
    names = ["answer", "evidence", "impact", "recommendation", "priority"]
    return j.select(*keys, "accepted", "intent", "ref_region",
                    (F.col("reg_rev").isNotNull()).alias("region_found"),
                    *[F.when(F.col("accepted"), f).alias(n) for n, f in zip(names, fields)],
                    reply.alias("reply"), conf.cast("int").alias("confidence"))


# --- Q8: prompt messages ------------------------------------------------------------

def prompt_messages(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Q8 in numbers: per user turn, the messages of its prompt (system and question included), the
    characters of the earlier turns, the previous turn's role, and the question."""
    r = running_before(conversations.select(conv, turn, role, text), [conv], [turn, role, text],
                       {"history_chars": F.coalesce(F.length(F.col(text)), F.lit(0))}, [role])
    return (r.filter(F.col(role) == "user")
            .select(conv, turn, (F.col("n_before") + 2).alias("n_messages"),
                    F.col("history_chars_before").cast("long").alias("history_chars"),
                    F.col(f"previous_{role}").alias("previous_role"), F.col(text).alias("question")))


def message_rows(conversations: DataFrame, facts: DataFrame, has_profit: bool, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Q8: one row per message ``(conv, seq, role, content)``: the system text at 0, then the turns in order.

    ``facts``: the one fact row that all conversations are about."""
    ranked = running_before(conversations.select(conv, turn, role, text), [conv], [turn, role, text], {})
    turns = ranked.select(conv, (F.col("n_before") + 1).alias("seq"), F.col(role).alias("role"), F.col(text).alias("content"))
    system = question_prompts(facts, (), has_profit, ANSWER_HEADERS)
    convs = conversations.select(conv).distinct()
    return turns.unionByName(_with_entity(convs, system, ()).select(
        conv, F.lit(0).cast("long").alias("seq"), F.lit("system").alias("role"), F.col("system_prompt").alias("content")))


def request_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Q8: one row per user turn ``(conv, seq, history_to, question)``: its prompt is the messages 0..history_to, then the question."""
    ranked = running_before(conversations.select(conv, turn, role, text), [conv], [turn, role, text], {})
    return ranked.where(F.col(role) == "user").select(conv, (F.col("n_before") + 1).alias("seq"),
                                                      F.col("n_before").alias("history_to"), F.col(text).alias("question"))
