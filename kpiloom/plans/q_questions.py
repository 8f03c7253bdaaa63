"""Registered queries: question gate, intent, answers, prompts (Q1-Q8).

The questions are the user turns of ``conversations``, whole texts.  They name no region and hardly any topic, so where a query is not a
``_plain`` one, a planted business question, chosen by conversation and turn, stands as a row of its own beside each of them, and the
sales fact's regions get names that questions can hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import PY_SPACE
from ..operators import kpis as K
from ..operators import questions as QN
from ..operators.brief import brief_facts
from ..operators.cube import fact_cube
from ..operators.kpis import confidence_from_cube, region_facts_from_cube
from ..session import write_and_read
from ..sources.tables import FACT_MAPPING, load_table, sales_fact
from . import expected as TT
from . import q_brief as QB
from . import sql as Q
from .registry import query

INDUSTRY = "SaaS"
KEYS = ["conv_id", "turn"]
ASKED_KEYS = [*KEYS, "planted"]

# One question for every intent, regions that exist and one that doesn't, and questions off the subject.
ASKED = ["Why did sales drop in March? ", "Which product performs the worst? ", "What are the major business risks? ",
         "Where should we invest next? ", "Suggest three strategic sales initiatives. ", "Is business health good? ", "Build a SWOT for us. ",
         "Summarize this dataset for the CEO. ", "How is the southeast market doing? ", "Show the north market please. ",
         "Revenue of RJ please. ", "Tell me a joke. ", "List all figures about quality. "]
_ASKED = f"CASE (conv_id * 3 + turn) % {len(ASKED)} " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(ASKED)) + " END"
_COMPASS = ("CASE CAST(substr(nation, 8) AS INT) % 6 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' "
            "WHEN 4 THEN 'SP' ELSE nation END")
COMPASS = FACT_MAPPING.with_overrides({"region": "compass"})


def _questions(spark, d):
    c = load_table(spark, d, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def _asked(spark, d):
    """The conversations' own questions and the planted ones; each is also about one of the five segments."""
    c = load_table(spark, d, "conversations").where("role = 'user'")
    both = F.explode(F.array(F.struct(F.lit(False).alias("planted"), F.col("text").alias("question")), F.struct(F.lit(True).alias("planted"), F.expr(_ASKED).alias("question"))))
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("conv_id") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", segment.alias("segment"), both.alias("q")).select("conv_id", "turn", "q.planted", "q.question", "segment")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _compass(spark, d, profit=True):
    return sales_fact(spark, d, with_profit=profit).withColumn("compass", F.expr(_COMPASS))


def _answers(questions, fact, mapping, by=(), keys=ASKED_KEYS):
    """One scan of the fact: brief facts, region facts and K2 all come from
    the same cube, written once (one row per region, product and month)
    because all three are used."""
    cube = write_and_read(fact_cube(fact, mapping, by, count_missing=True), "question-cube")
    facts = brief_facts(fact, mapping, by, industry=INDUSTRY, cube=cube)
    conf = confidence_from_cube(cube, len([c for c in fact.columns if c not in by]), by)
    return QN.answer_questions(questions, facts, region_facts_from_cube(cube, by), mapping.has_profit(fact), conf, keys, by=by)


# --- SQL twin --------------------------------------------------------------------

def _any(words):
    return "(" + " OR ".join(f"contains(ql, {Q.lit(w)})" for w in words) + ")"


_NTOK = (f"len(list_filter(regexp_split_to_array({Q.py_strip('question')}, '{PY_SPACE}+'), lambda x: x <> ''))")
_GATE = f"({_NTOK} < {TT.MIN_TOKENS} OR {_any(TT.GATE_KEYWORDS)})"
_INTENT = (f"CASE WHEN {_any(TT.DECLINE_WHY)} AND {_any(TT.DECLINE_WHAT)} AND {_any(TT.DECLINE_HOW)} THEN 'decline' "
           + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w, _ in TT.INTENTS)
           + f" WHEN {_any(TT.REGION_WORDS)} OR {_any(TT.REGION_CODES)} THEN 'region' ELSE 'general' END")
_REF = ("CASE " + " ".join(f"WHEN contains(ql, '{w}') THEN '{w.capitalize() if w in TT.REGION_WORDS else w.upper()}'"
                            for w in TT.REGION_WORDS + TT.REGION_CODES) + " END")

def _conf_sql(columns, by=()):
    keys = "".join(f"{b}, " for b in by)
    missing = " + ".join(f"({c} IS NULL)::INT" for c in columns)
    return f"""conf AS (SELECT {keys}CAST(CASE WHEN COUNT(*) = 0 THEN 50 ELSE LEAST(99, GREATEST(50, 80 + LEAST(10, FLOOR(COUNT(*) / 10))
  + FLOOR((1.0 - SUM({missing}) / (COUNT(*) * {len(columns)}.0)) * 10))) END AS INTEGER) AS data_confidence FROM f {'GROUP BY ' + ', '.join(by) if by else ''})"""


_COLUMNS = ["order_date", "region", "nation", "product", "brand", "segment", "revenue", "profit"]

_REG_PH = {"ref_region": "ref_region", "reg_rev": Q.money("reg_rev"), "reg_margin": Q.fmt("reg_margin", 1),
           "reg_share": Q.fmt("reg_share", 1)}


def _fields_sql(hp=True):
    key = "CASE WHEN intent = 'region' AND reg_rev IS NULL THEN 'region_missing' ELSE intent END"
    outs = []
    for i in range(4):
        outs.append("CASE " + " ".join(f"WHEN {key} = '{n}' THEN {Q.render(t[i], hp, extra=_REG_PH)}"
                                       for n, t in TT.ANSWERS.items()) + " END")
    outs.append("CASE " + " ".join(f"WHEN {key} = '{n}' THEN '{p}'" for n, p in TT.PRIORITY.items()) + " END")
    return outs


_PLAIN = "SELECT conv_id, turn, false AS planted, text AS question, lower(text) AS ql FROM conversations WHERE role = 'user'"
_SEGMENT_SQL = f"[{', '.join(Q.lit(x) for x in SEGMENTS)}][conv_id % 5 + 1] AS segment"
_ASKED_SQL = (f"SELECT *, lower(question) AS ql FROM (SELECT conv_id, turn, false AS planted, text AS question, {_SEGMENT_SQL} FROM conversations WHERE role = 'user' "
              f"UNION ALL SELECT conv_id, turn, true, {_ASKED}, {_SEGMENT_SQL} FROM conversations WHERE role = 'user')")


def answers_sql(select: str, questions: str = _PLAIN, region: str = "nation", profit: bool = True, by=(), columns=_COLUMNS) -> str:
    names = ["answer", "evidence", "impact", "recommendation", "priority"]
    fields = _fields_sql(profit)
    md = " || chr(10) || chr(10) || ".join(f"'### {h}' || chr(10) || {v}" for h, v in zip(TT.ANSWER_HEADERS, fields))
    on = lambda a, b: "".join(f" AND {a}.{k} = {b}.{k}" for k in by)
    keys = "".join(f"{b}, " for b in by)
    facts = [c for c in columns if c not in by]
    margin = Q.group_margin("SUM(profit)", "SUM(revenue)") if profit else "0.0"
    fact = f"SELECT *, {_COMPASS} AS compass FROM ({Q.FACT_SQL})"
    ctes = Q.kpi_facts_ctes(list(by), profit, region=region) + ",\n" + _conf_sql(facts, by) + f""",
bf AS (SELECT kf.*, {Q.lit(INDUSTRY)} AS industry FROM kf),
rf AS (SELECT {keys}{region} AS _reg, CAST(SUM(revenue) AS DOUBLE) AS reg_rev, {margin} AS reg_margin FROM f GROUP BY {keys}{region}),
qq AS ({questions}),
qc AS (SELECT *, {_GATE} AS accepted, {_INTENT} AS intent FROM qq),
qr AS (SELECT *, CASE WHEN intent = 'region' THEN {_REF} END AS ref_region FROM qc),
qj AS (SELECT qr.conv_id, qr.turn, qr.planted, qr.question, qr.accepted, qr.intent, qr.ref_region, bf.*, conf.data_confidence, rf._reg, rf.reg_rev, rf.reg_margin
       FROM qr JOIN bf ON TRUE{on('qr', 'bf')} JOIN conf ON TRUE{on('qr', 'conf')} LEFT JOIN rf ON qr.ref_region = rf._reg{on('qr', 'rf')}),
qk AS (SELECT *, reg_rev / total_revenue * 100.0 AS reg_share FROM qj),
ans AS (SELECT conv_id, turn, planted, accepted, intent, ref_region, reg_rev IS NOT NULL AS region_found,
   {', '.join(f'CASE WHEN accepted THEN {f} END AS {n}' for f, n in zip(fields, names))},
   CASE WHEN accepted THEN {md} ELSE {Q.lit(TT.REFUSAL)} END AS reply,
   CAST(CASE WHEN accepted THEN data_confidence ELSE {TT.REFUSAL_CONFIDENCE} END AS INTEGER) AS confidence,
   reg_rev AS revenue, CASE WHEN reg_rev IS NOT NULL THEN reg_margin END AS margin, reg_share AS share
 FROM qk)"""
    return Q.with_fact(select, fact=fact, extra_ctes=ctes)


_ALL = "SELECT * EXCLUDE (revenue, margin, share) FROM ans"
_ALL_PLAIN = "SELECT * EXCLUDE (planted, revenue, margin, share) FROM ans"


# --- queries ---------------------------------------------------------------------

@query("question_gate", f"""
SELECT conv_id, turn, CAST({_NTOK} AS INTEGER) AS n_tokens, {_GATE} AS accepted
FROM (SELECT conv_id, turn, text AS question, lower(text) AS ql FROM conversations WHERE role = 'user')""")
def q_question_gate(spark, d):
    q = _questions(spark, d)
    return q.select(*KEYS, QN.n_tokens(F.col("question")).alias("n_tokens"), QN.gate(F.col("question")).alias("accepted"))


@query("question_intent", f"""
SELECT conv_id, turn, {_INTENT} AS intent
FROM (SELECT conv_id, turn, lower(text) AS ql FROM conversations WHERE role = 'user')""")
def q_question_intent(spark, d):
    q = _questions(spark, d)
    return q.select(*KEYS, QN.intent(F.col("question")).alias("intent"))


@query("question_region", f"""
SELECT conv_id, turn, {_REF} AS ref_region
FROM (SELECT conv_id, turn, lower(text) AS ql FROM conversations WHERE role = 'user') WHERE {_INTENT} = 'region'""")
def q_question_region(spark, d):
    q = _questions(spark, d)
    return (q.filter(QN.intent(F.col("question")) == "region")
            .select(*KEYS, QN.referenced_region(F.col("question")).alias("ref_region")))


@query("asked_gate_intent", f"""
SELECT conv_id, turn, planted, {_GATE} AS accepted, {_INTENT} AS intent, CASE WHEN {_INTENT} = 'region' THEN {_REF} END AS ref_region
FROM ({_ASKED_SQL})""")
def q_asked_gate_intent(spark, d):
    """Q1-Q3 over questions of every intent."""
    return QN.classify(_asked(spark, d)).select(*ASKED_KEYS, "accepted", "intent", "ref_region")


_REGION_PLAIN = "SELECT conv_id, turn, ref_region, region_found, revenue, margin, share FROM ans WHERE intent = 'region'"
_REGION = _REGION_PLAIN.replace("turn,", "turn, planted,")


@query("region_answers", answers_sql(_REGION, _ASKED_SQL, "compass"))
def q_region_answers(spark, d):
    """Q4: regions found and not found."""
    fact = _compass(spark, d)
    return QN.region_answers(_asked(spark, d), K.segment_performance(fact, COMPASS, "region"), K.totals(fact, COMPASS), True, ASKED_KEYS)


@query("region_answers_plain", answers_sql(_REGION_PLAIN, _PLAIN, "compass"))
def q_region_answers_plain(spark, d):
    """Q4 over the conversations' own, whole texts."""
    fact = _compass(spark, d)
    return QN.region_answers(_questions(spark, d), K.segment_performance(fact, COMPASS, "region"), K.totals(fact, COMPASS), True, KEYS)


@query("region_answers_by_segment", answers_sql(_REGION, _ASKED_SQL, "compass", by=["segment"]))
def q_region_answers_by(spark, d):
    """Q4 for questions that are about one segment each."""
    fact, by = _compass(spark, d), ["segment"]
    return QN.region_answers(_asked(spark, d), K.segment_performance(fact, COMPASS, "region", by), K.totals(fact, COMPASS, by), True, ASKED_KEYS, by)


@query("question_answers", answers_sql(_ALL, _ASKED_SQL, "compass", columns=[*_COLUMNS, "compass"]))
def q_question_answers(spark, d):
    return _answers(_asked(spark, d), _compass(spark, d), COMPASS)


@query("question_answers_noprofit", answers_sql(_ALL, _ASKED_SQL, "compass", profit=False, columns=[c for c in _COLUMNS if c != "profit"] + ["compass"]))
def q_question_answers_np(spark, d):
    return _answers(_asked(spark, d), _compass(spark, d, False), COMPASS.with_overrides({"profit": None}))


@query("question_answers_by_entity", answers_sql(_ALL, _ASKED_SQL, "compass", by=["segment"], columns=[*_COLUMNS, "compass"]))
def q_question_answers_by(spark, d):
    return _answers(_asked(spark, d), _compass(spark, d), COMPASS, ["segment"])


@query("question_answers_plain", answers_sql(_ALL_PLAIN))
def q_question_answers_plain(spark, d):
    """The conversations' own texts."""
    return _answers(_questions(spark, d), sales_fact(spark, d), FACT_MAPPING, keys=KEYS)


@query("answer_confidence", answers_sql("SELECT conv_id, turn, planted, accepted, confidence FROM ans", _ASKED_SQL))
def q_answer_confidence(spark, d):
    return QN.answer_confidence(_asked(spark, d), K.data_confidence(sales_fact(spark, d)), ASKED_KEYS)


@query("answer_confidence_plain", answers_sql("SELECT conv_id, turn, accepted, confidence FROM ans"))
def q_answer_confidence_plain(spark, d):
    """Q7 over the conversations' own, whole texts."""
    return QN.answer_confidence(_questions(spark, d), K.data_confidence(sales_fact(spark, d)), KEYS)


@query("message_rows", QB.brief_sql(f"""
SELECT conv_id, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS seq, role, text AS content FROM conversations
UNION ALL SELECT conv_id, CAST(0 AS BIGINT), 'system', system_prompt
FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT {QB.question_prompt_sql(True)} AS system_prompt FROM bt)""", by=[]))
def q_message_rows(spark, d):
    """Q8: every message of every conversation, after one system text."""
    return QN.message_rows(load_table(spark, d, "conversations"), QB.facts(spark, d, by=[]), True)


@query("request_rows", """
SELECT conv_id, seq, CAST(seq - 1 AS BIGINT) AS history_to, text AS question
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS seq FROM conversations) WHERE role = 'user'""")
def q_request_rows(spark, d):
    """Q8: every user turn as a request with the last message of its history."""
    return QN.request_rows(load_table(spark, d, "conversations"))


@query("prompt_messages", """
SELECT conv_id, turn, n_messages, history_chars, previous_role, question FROM (
  SELECT conv_id, turn, role, text AS question,
         CAST(COUNT(*) OVER w + 1 AS BIGINT) AS n_messages,
         CAST(SUM(length(text)) OVER w - length(text) AS BIGINT) AS history_chars,
         LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE role = 'user'""")
def q_prompt_messages(spark, d):
    return QN.prompt_messages(load_table(spark, d, "conversations"))
