"""Registered queries: briefs, report tables and prompts per segment (B*, R*)."""

from __future__ import annotations

from ..operators import brief as B
from ..operators import questions as QN
from ..sources.tables import FACT_MAPPING, FACT_MAPPING_NO_PROFIT, sales_fact
from . import expected as TT
from . import sql as Q
from .registry import query

BY = ["segment"]
REPORT_DATE = "2001-08-31"
TEMPLATE_KEYS = list(TT.INDUSTRY_TEXT["SaaS"])


def facts(spark, d, profit=True, industry="SaaS", by=BY):
    m = FACT_MAPPING if profit else FACT_MAPPING_NO_PROFIT
    return B.brief_facts(sales_fact(spark, d, with_profit=profit), m, by, industry=industry,
                         report_date=REPORT_DATE)


# --- SQL twin of brief_facts + the render helpers ------------------------------

def _tt_sql(has_profit):
    rows = ", ".join("(" + ", ".join([Q.lit(ind)] + [Q.lit(Q.pick(TT.INDUSTRY_TEXT[ind][k], has_profit))
                                                     for k in TEMPLATE_KEYS]) + ")"
                     for ind in TT.RULE_INDUSTRIES)
    cols = ", ".join(["_tind"] + [f"t_{k}" for k in TEMPLATE_KEYS])
    return f"tt AS (SELECT * FROM (VALUES {rows}) AS v({cols}))"


def _guidance_sql():
    e = "''"
    for k, v in TT.GUIDANCE.items():
        e = f"CASE WHEN industry = {Q.lit(k)} THEN {Q.lit(v)} ELSE {e} END"
    return e


def brief_sql(body: str, profit=True, industry="SaaS", by=BY, industry_sql=None) -> str:
    """``industry_sql``: the industry of each row of ``kf`` as an expression; else the given one."""
    rule = ", ".join(Q.lit(i) for i in TT.RULE_INDUSTRIES)
    ctes = Q.kpi_facts_ctes(by, profit) + ",\n" + _tt_sql(profit) + f""",
bf AS (SELECT kf.*, {industry_sql or Q.lit(industry)} AS industry, {Q.lit(REPORT_DATE)} AS report_date FROM kf),
bg AS (SELECT bf.*, CASE WHEN industry IN ({rule}) THEN industry ELSE {Q.lit(TT.FALLBACK_INDUSTRY)} END AS _tind,
              {_guidance_sql()} AS guidance FROM bf),
bt AS (SELECT * FROM bg LEFT JOIN tt USING (_tind))"""
    return Q.with_fact(body, extra_ctes=ctes)


def _t(key, hp):
    fields = [f for ind in TT.RULE_INDUSTRIES for f in Q.fields_of(Q.pick(TT.INDUSTRY_TEXT[ind][key], hp))]
    return Q.render(None, hp, base=f"t_{key}", fields=list(dict.fromkeys(fields)))


def _block_sql(fields):
    parts = []
    for label, val in zip(TT.BLOCK_FIELDS, fields):
        parts.append(f"'- **{label}**: ' || {val}")
    return " || chr(10) || ".join(parts)


def _risks_sql(hp):
    r2 = TT.RISK2
    return [[_t("risk_name", hp), Q.lit(TT.RISK_BLOCKS[0][0]), Q.lit(f"{TT.RISK_BLOCKS[0][1]}%"),
             _t("risk_evidence", hp), _t("risk_impact", hp), _t("risk_rec", hp)],
            [Q.render(r2["issue"], hp), Q.lit(TT.RISK_BLOCKS[1][0]), Q.lit(f"{TT.RISK_BLOCKS[1][1]}%"),
             Q.render(r2["evidence"], hp), Q.render(r2["impact"], hp), Q.render(r2["rec"], hp)]]


def _opps_sql(hp):
    o2 = TT.OPP2
    return [[_t("opp_name", hp), Q.lit(TT.OPPORTUNITY_BLOCKS[0][0]), Q.lit(f"{TT.OPPORTUNITY_BLOCKS[0][1]}%"),
             _t("opp_evidence", hp), _t("opp_impact", hp), _t("opp_rec", hp)],
            [Q.render(o2["issue"], hp), Q.lit(TT.OPPORTUNITY_BLOCKS[1][0]), Q.lit(f"{TT.OPPORTUNITY_BLOCKS[1][1]}%"),
             Q.render(o2["evidence"], hp), Q.render(o2["impact"], hp), Q.render(o2["rec"], hp)]]


def _bodies_sql(hp):
    nl2 = "chr(10) || chr(10)"
    blocks = lambda bs: f" || {nl2} || ".join(f"({_block_sql(b)})" for b in bs)
    recs = " || chr(10) || ".join(f"'- ' || {_t(k, hp)}" for k in ("rec1", "rec2", "rec3"))
    return [Q.render(TT.EXEC_SUMMARY, hp), Q.render(TT.FINDINGS, hp), blocks(_risks_sql(hp)),
            blocks(_opps_sql(hp)), recs, _t("impact", hp)]


def _records_sql(names, rows, no):
    items = []
    for i, r in enumerate(rows):
        kv = [f"'{no}': {i + 1}"] + [f"'{n}': {v}" for n, v in zip(names, r)]
        items.append("{" + ", ".join(kv) + "}")
    return f"UNNEST([{', '.join(items)}], recursive := true)"


def _records_query(names, rows, no, by=BY):
    keys = "".join(f"{b}, " for b in by)
    return f"SELECT {keys}{', '.join([no, *names])} FROM (SELECT {keys}{_records_sql(names, rows, no)} FROM bt)"


# --- queries ---------------------------------------------------------------------

_FACT_COLS = ("segment, n_rows, total_revenue, total_profit, profit_margin, top_region, top_region_rev, "
              "top_product, top_product_rev, health_score, health_status, worst_region, worst_region_margin, "
              "worst_product, worst_product_margin, top_product_margin, growth_statement, industry")


@query("brief_facts", brief_sql(f"SELECT {_FACT_COLS} FROM bt"))
def q_brief_facts(spark, d):
    return facts(spark, d).select(*[c.strip() for c in _FACT_COLS.split(",")])


def _section_rows(hp):
    return [[Q.lit(t), b] for t, b in zip(TT.SECTIONS, _bodies_sql(hp))]


def markdown_sql(hp):
    return " || chr(10) || chr(10) || ".join(f"'## {t}' || chr(10) || {b}" for t, b in zip(TT.SECTIONS, _bodies_sql(hp)))


def _markdown_query(hp, by=BY, **options):
    keys = "".join(f"{b}, " for b in by)
    return brief_sql(f"SELECT {keys}{markdown_sql(hp)} AS brief FROM bt", hp, by=by, **options)


@query("brief_markdown", _markdown_query(True))
def q_brief_markdown(spark, d):
    return B.brief_markdown(facts(spark, d), BY, True)


@query("brief_markdown_all", _markdown_query(True, by=[]))
def q_brief_markdown_all(spark, d):
    """The whole dataset as one entity."""
    return B.brief_markdown(facts(spark, d, by=[]), [], True)


@query("brief_markdown_all_noprofit", _markdown_query(False, by=[]))
def q_brief_markdown_all_np(spark, d):
    return B.brief_markdown(facts(spark, d, profit=False, by=[]), [], False)


@query("brief_markdown_retail", _markdown_query(True, industry="Retail"))
def q_brief_markdown_retail(spark, d):
    return B.brief_markdown(facts(spark, d, industry="Retail"), BY, True)


# Per-row industry: brands 1x are Retail, 2x Banking, the rest carry none; the most frequent one is the segment's.
_INDUSTRY_OF = "CASE WHEN brand LIKE 'Brand#1%' THEN 'Retail' WHEN brand LIKE 'Brand#2%' THEN 'Banking' END"


@query("brief_markdown_by_industry", _markdown_query(True, industry_sql=f"""(
  SELECT arg_min(ind, (-n, ind)) FROM (SELECT segment AS s, {_INDUSTRY_OF} AS ind, COUNT(*) AS n FROM f GROUP BY 1, 2)
  WHERE ind IS NOT NULL AND s = kf.segment)"""))
def q_brief_by_industry(spark, d):
    """Each segment's own industry, from a column of its rows."""
    from pyspark.sql import functions as F
    fact = sales_fact(spark, d).withColumn("trade", F.expr(_INDUSTRY_OF))
    f = B.brief_facts(fact, FACT_MAPPING, BY, industry_col="trade", report_date=REPORT_DATE)
    return B.brief_markdown(f, BY, True)


@query("industry_facts_all", brief_sql("SELECT industry, _tind AS template_industry, total_revenue FROM bt", by=[], industry_sql=f"""(
  SELECT arg_min(ind, (-n, ind)) FROM (SELECT {_INDUSTRY_OF} AS ind, COUNT(*) AS n FROM f GROUP BY 1) WHERE ind IS NOT NULL)"""))
def q_industry_facts_all(spark, d):
    """B7 for the whole dataset."""
    from pyspark.sql import functions as F
    fact = sales_fact(spark, d).withColumn("trade", F.expr(_INDUSTRY_OF))
    f = B.brief_facts(fact, FACT_MAPPING, [], industry_col="trade", report_date=REPORT_DATE)
    return f.select("industry", F.col("_tind").alias("template_industry"), "total_revenue")


@query("industry_template", brief_sql(
    f"SELECT segment, industry, _tind AS template_industry, {_t('risk_name', True)} AS risk_name FROM bt",
    industry="Banking"))
def q_industry_template(spark, d):
    """An industry without rule templates (Banking) falls back to SaaS."""
    from pyspark.sql import functions as F
    f = facts(spark, d, industry="Banking")
    return f.select("segment", "industry", F.col("_tind").alias("template_industry"),
                    B._t("risk_name", True).alias("risk_name"))


def _render_rows(rows, hp):
    return [[Q.render(x, hp) for x in r] for r in rows]


def _roadmap_rows(hp):
    return [[str(mi), Q.lit(month), Q.lit(theme), str(ai), Q.render(a, hp)]
            for mi, (month, theme, actions) in enumerate(TT.ROADMAP, 1) for ai, a in enumerate(actions, 1)]


def _decision_rows(hp):
    return [[Q.lit("conclusion"), Q.render(TT.CONCLUSION, hp)], *[[Q.lit("decision"), Q.render(x, hp)] for x in TT.DECISIONS]]


_BLOCKS = ["issue", "priority", "confidence", "evidence", "impact", "recommendation"]

# operator → (key column, columns, expected rows)
RECORDS = {
    B.brief_sections: ("section_no", ["section", "body"], _section_rows),
    B.brief_risks: ("block_no", _BLOCKS, _risks_sql),
    B.brief_opportunities: ("block_no", _BLOCKS, _opps_sql),
    B.brief_recommendations: ("rec_no", ["text"], lambda hp: [[_t(k, hp)] for k in ("rec1", "rec2", "rec3")]),
    B.risk_register: ("row_no", ["risk", "severity", "impact", "recommendation", "due"], lambda hp: _render_rows(TT.RISK_REGISTER, hp)),
    B.opportunity_table: ("row_no", ["opportunity", "value", "difficulty", "roi"], lambda hp: _render_rows(TT.OPPORTUNITY_TABLE, hp)),
    B.initiative_table: ("row_no", ["objective", "value", "priority", "owner", "timeline"], lambda hp: _render_rows(TT.INITIATIVES, hp)),
    B.roadmap_table: ("row_no", ["month_no", "month", "theme", "action_no", "action"], _roadmap_rows),
    B.decision_table: ("item_no", ["kind", "text"], _decision_rows),
    B.report_metadata: ("field_no", ["field", "value"], lambda hp: [[Q.lit(k), Q.render(v, hp)] for k, v in TT.METADATA]),
}


def _register(op, no, names, rows, hp, by):
    name = op.__name__ + ("" if by else "_all") + ("" if hp else "_noprofit")

    @query(name, brief_sql(_records_query(names, rows(hp), no, by), hp, by=by))
    def run(spark, d):
        return op(facts(spark, d, profit=hp, by=by), by, hp)


_TABLES = (B.risk_register, B.opportunity_table, B.initiative_table, B.roadmap_table, B.decision_table)
for _op, (_no, _names, _rows) in RECORDS.items():
    _register(_op, _no, _names, _rows, True, BY)
    if _op in (B.brief_sections, B.report_metadata, *_TABLES):
        _register(_op, _no, _names, _rows, False, BY)
    if _op in _TABLES:
        _register(_op, _no, _names, _rows, True, [])


def _prompt_parts(hp):
    return {"profit_lines": Q.render(TT.PROMPT_PROFIT, hp), "section_list": Q.lit(", ".join(TT.SECTIONS)),
            "field_list": Q.lit(", ".join(TT.BLOCK_FIELDS)), "header_list": Q.lit(", ".join(TT.ANSWER_HEADERS))}


def question_prompt_sql(hp):
    return Q.render(TT.PROMPT_QUESTION, hp, extra=_prompt_parts(hp))


def _prompt_sql(hp):
    extra = _prompt_parts(hp)
    system = Q.render(TT.PROMPT_SYSTEM, hp)
    user = Q.render(TT.PROMPT_USER, hp, extra=extra)
    return brief_sql(f"SELECT segment, trim({system}) AS system_prompt, {user} AS user_prompt FROM bt", hp)


@query("brief_prompts", _prompt_sql(True))
def q_brief_prompts(spark, d):
    return B.brief_prompts(facts(spark, d), BY, True)


@query("brief_prompts_noprofit", _prompt_sql(False))
def q_brief_prompts_np(spark, d):
    return B.brief_prompts(facts(spark, d, profit=False), BY, False)


@query("question_prompts", brief_sql(f"SELECT segment, {question_prompt_sql(True)} AS system_prompt FROM bt"))
def q_question_prompts(spark, d):
    return B.question_prompts(facts(spark, d), BY, True, QN.ANSWER_HEADERS)


@query("question_prompts_all_noprofit", brief_sql(f"SELECT {question_prompt_sql(False)} AS system_prompt FROM bt", False, by=[]))
def q_question_prompts_np(spark, d):
    return B.question_prompts(facts(spark, d, profit=False, by=[]), [], False, QN.ANSWER_HEADERS)
