"""Briefs, report tables and prompts per entity.

All text is rendered from templates (``templates.py``) with JVM-side
``replace`` chains over the per-entity fact row from ``kpi_facts``, so a
million entities get a million briefs in one job with no Python UDF.  The
industry text is looked up with a join on a two-row template table
(broadcast: its size is fixed), so each entity may carry its own industry.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..mapping import Mapping
from . import templates as TT
from .cube import fact_cube
from .kpis import kpi_facts

_FIELD = re.compile(r"\{(\w+)\}")


def _c(name: str) -> Column:
    return F.col(name)


def _num1(name: str) -> Column:
    return S.fmt_fixed(name, 1)


# Placeholder → value text (Spark).  Number text follows the HALF_UP contract.
PLACEHOLDERS = {
    "total_revenue": lambda: S.money("total_revenue"),
    "total_profit": lambda: S.money("total_profit"),
    "profit_margin": lambda: _num1("profit_margin"),
    "health_score": lambda: _c("health_score").cast("string"),
    "health_status": lambda: _c("health_status"),
    "top_region": lambda: _c("top_region"),
    "top_product": lambda: _c("top_product"),
    "worst_region": lambda: _c("worst_region"),
    "worst_product": lambda: _c("worst_product"),
    "top_region_rev": lambda: S.money("top_region_rev"),
    "top_product_rev": lambda: S.money("top_product_rev"),
    "top_region_rev0": lambda: S.money0("top_region_rev"),
    "worst_region_margin": lambda: _num1("worst_region_margin"),
    "worst_product_margin": lambda: _num1("worst_product_margin"),
    "top_product_margin": lambda: _num1("top_product_margin"),
    "growth_statement": lambda: _c("growth_statement"),
    "top_region15": lambda: S.truncate_label("top_region", 15),
    "top_product15": lambda: S.truncate_label("top_product", 15),
    "worst_product15": lambda: S.truncate_label("worst_product", 15),
    "industry": lambda: _c("industry"),
    "report_date": lambda: _c("report_date"),
    "guidance": lambda: _c("guidance"),
}


def pick(t, has_profit: bool) -> str:
    if isinstance(t, tuple):
        return t[0] if has_profit else t[1]
    return t


def fields_of(text: str) -> list[str]:
    return list(dict.fromkeys(_FIELD.findall(text)))


def template_fields(key: str, has_profit: bool) -> list[str]:
    """Fields used by any rule industry's template for ``key``."""
    out: list[str] = []
    for ind in TT.RULE_INDUSTRIES:
        out += fields_of(pick(TT.INDUSTRY_TEXT[ind][key], has_profit))
    return list(dict.fromkeys(out))


def render(template, has_profit: bool, base: Column | None = None, extra: dict | None = None,
           fields: list[str] | None = None) -> Column:
    """Fill ``{field}`` slots; ``base`` = a template held in a column (then
    ``fields`` lists the slots it may hold)."""
    text = pick(template, has_profit)
    values = {**PLACEHOLDERS, **(extra or {})}
    out = base if base is not None else F.lit(text)
    names = fields_of(text) if base is None else (fields if fields is not None else list(values))
    for n in names:
        if n in values:
            out = F.replace(out, F.lit("{" + n + "}"), F.coalesce(values[n](), F.lit("nan")))
    return out


def block_markdown(fields: Sequence[Column]) -> Column:
    parts = []
    for label, val in zip(TT.BLOCK_FIELDS, fields):
        parts += [F.lit(f"- **{label}**: "), val, F.lit("\n")]
    return F.concat(*parts[:-1])


# --- facts + industry templates --------------------------------------------------

TEMPLATE_KEYS = list(TT.INDUSTRY_TEXT["SaaS"].keys())


def template_table(spark: SparkSession, has_profit: bool) -> DataFrame:
    """One row per rule industry, one column per template key (fixed size)."""
    rows = [(ind, *[pick(TT.INDUSTRY_TEXT[ind][k], has_profit) for k in TEMPLATE_KEYS])
            for ind in TT.RULE_INDUSTRIES]
    return spark.createDataFrame(rows, ["_tind"] + [f"t_{k}" for k in TEMPLATE_KEYS])


def _with_industry(facts: DataFrame, df: DataFrame, by: Sequence[str], industry_col: str, default: str) -> DataFrame:
    seen = df.select(*[S.named(b).alias(f"_i{k}") for k, b in enumerate(by)], S.named(industry_col).cast("string").alias("_ind"))
    keys = [f"_i{k}" for k in range(len(by))]
    counted = seen.where(F.col("_ind").isNotNull()).groupBy(*keys, "_ind").agg(F.count(F.lit(1)).alias("_n"))
    one = counted.groupBy(*keys).agg(F.min_by("_ind", F.struct((-F.col("_n")).alias("n"), F.col("_ind").alias("v"))).alias("_ind"))
    if not by:  # both sides are one row
        joined = facts.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    else:
        same = F.lit(True)
        for k, b in enumerate(by):
            same = same & facts[b].eqNullSafe(one[f"_i{k}"])
        joined = facts.join(one, same, "left").drop(*keys)
    return joined.withColumn("industry", F.coalesce("_ind", F.lit(default))).drop("_ind")


def brief_facts(df: DataFrame, m: Mapping, by: Sequence[str] = (), industry: str = "SaaS",
                industry_col: str | None = None, report_date: str = "",
                cube: DataFrame | None = None) -> DataFrame:
    """B1 + B7: fact row per entity with its industry's template columns.

    ``industry_col``: the entity's industry is the most frequent value of that
    column among its rows, of equally frequent ones the smallest; without any
    value it is ``industry``.  Pass ``cube`` to reuse a fact cube the caller also
    uses elsewhere.
    """
    has_profit = m.has_profit(df)
    facts = kpi_facts(cube if cube is not None else fact_cube(df, m, by), by, has_profit, m.revenue in df.columns)
    if industry_col:
        facts = _with_industry(facts, df, by, industry_col, industry)
    else:
        facts = facts.withColumn("industry", F.lit(industry))
    tind = F.when(F.col("industry").isin(TT.RULE_INDUSTRIES), F.col("industry")).otherwise(TT.FALLBACK_INDUSTRY)
    guidance = F.lit("")
    for k, v in TT.GUIDANCE.items():
        guidance = F.when(F.col("industry") == k, F.lit(v)).otherwise(guidance)
    facts = facts.withColumn("_tind", tind).withColumn("guidance", guidance) \
        .withColumn("report_date", F.lit(report_date))
    tmpl = F.broadcast(template_table(df.sparkSession, has_profit))
    return facts.join(tmpl, "_tind", "left")


def _t(key: str, has_profit: bool) -> Column:
    return render(None, has_profit, base=F.col(f"t_{key}"), fields=template_fields(key, has_profit))


def risks(has_profit: bool):
    """Two risk blocks as lists of six field Columns."""
    b1 = [_t("risk_name", has_profit), F.lit(TT.RISK_BLOCKS[0][0]), F.lit(f"{TT.RISK_BLOCKS[0][1]}%"),
          _t("risk_evidence", has_profit), _t("risk_impact", has_profit), _t("risk_rec", has_profit)]
    r2 = TT.RISK2
    b2 = [render(r2["issue"], has_profit), F.lit(TT.RISK_BLOCKS[1][0]), F.lit(f"{TT.RISK_BLOCKS[1][1]}%"),
          render(r2["evidence"], has_profit), render(r2["impact"], has_profit), render(r2["rec"], has_profit)]
    return [b1, b2]


def opportunities(has_profit: bool):
    """Two opportunity blocks."""
    b1 = [_t("opp_name", has_profit), F.lit(TT.OPPORTUNITY_BLOCKS[0][0]),
          F.lit(f"{TT.OPPORTUNITY_BLOCKS[0][1]}%"), _t("opp_evidence", has_profit),
          _t("opp_impact", has_profit), _t("opp_rec", has_profit)]
    o2 = TT.OPP2
    b2 = [render(o2["issue"], has_profit), F.lit(TT.OPPORTUNITY_BLOCKS[1][0]),
          F.lit(f"{TT.OPPORTUNITY_BLOCKS[1][1]}%"), render(o2["evidence"], has_profit),
          render(o2["impact"], has_profit), render(o2["rec"], has_profit)]
    return [b1, b2]


def section_bodies(has_profit: bool) -> list[Column]:
    """The six section bodies in order."""
    blocks = lambda bs: F.concat_ws("\n\n", *[block_markdown(b) for b in bs])
    recs = F.concat_ws("\n", *[F.concat(F.lit("- "), _t(k, has_profit)) for k in ("rec1", "rec2", "rec3")])
    return [render(TT.EXEC_SUMMARY, has_profit), render(TT.FINDINGS, has_profit),
            blocks(risks(has_profit)), blocks(opportunities(has_profit)), recs, _t("impact", has_profit)]


def brief_sections(facts: DataFrame, by: Sequence[str], has_profit: bool) -> DataFrame:
    """Long form ``(by…, section_no, section, body)``; empty entity → one notice."""
    bodies = section_bodies(has_profit)
    empty = F.col("n_rows") == 0
    arr = F.array(*[F.struct(F.lit(i + 1).alias("section_no"), F.lit(t).alias("section"), b.alias("body"))
                    for i, (t, b) in enumerate(zip(TT.SECTIONS, bodies))])
    notice = F.array(F.struct(F.lit(1).alias("section_no"), F.lit(TT.SECTIONS[0]).alias("section"),
                              F.lit(TT.EMPTY_NOTICE).alias("body")))
    return facts.select(*by, F.inline(F.when(empty, notice).otherwise(arr)))


def markdown_column(has_profit: bool) -> Column:
    """B9 as a Column over the fact row."""
    bodies = section_bodies(has_profit)
    doc = F.concat_ws("\n\n", *[F.concat(F.lit(f"## {t}\n"), b) for t, b in zip(TT.SECTIONS, bodies)])
    notice = F.lit(f"## {TT.SECTIONS[0]}\n{TT.EMPTY_NOTICE}")
    return F.when(F.col("n_rows") == 0, notice).otherwise(doc)


def brief_markdown(facts: DataFrame, by: Sequence[str], has_profit: bool) -> DataFrame:
    """One markdown document per entity, six ``##`` sections."""
    return facts.select(*by, markdown_column(has_profit).alias("brief"))


def _records(facts: DataFrame, by, names: Sequence[str], rows: Sequence[Sequence[Column]], no: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i + 1).alias(no), *[v.alias(n) for n, v in zip(names, r)])
                    for i, r in enumerate(rows)])
    return facts.select(*by, F.inline(arr))


BLOCK_COLS = ["issue", "priority", "confidence", "evidence", "impact", "recommendation"]


def brief_risks(facts, by, has_profit):
    return _records(facts, by, BLOCK_COLS, risks(has_profit), "block_no")


def brief_opportunities(facts, by, has_profit):
    return _records(facts, by, BLOCK_COLS, opportunities(has_profit), "block_no")


def brief_recommendations(facts, by, has_profit):
    return _records(facts, by, ["text"], [[_t(k, has_profit)] for k in ("rec1", "rec2", "rec3")], "rec_no")


def risk_register(facts, by, has_profit):
    """R1."""
    rows = [[render(x, has_profit) for x in r] for r in TT.RISK_REGISTER]
    return _records(facts, by, ["risk", "severity", "impact", "recommendation", "due"], rows, "row_no")


def opportunity_table(facts, by, has_profit):
    """R2."""
    rows = [[render(x, has_profit) for x in r] for r in TT.OPPORTUNITY_TABLE]
    return _records(facts, by, ["opportunity", "value", "difficulty", "roi"], rows, "row_no")


def initiative_table(facts, by, has_profit):
    """R3."""
    rows = [[render(x, has_profit) for x in r] for r in TT.INITIATIVES]
    return _records(facts, by, ["objective", "value", "priority", "owner", "timeline"], rows, "row_no")


def roadmap_table(facts, by, has_profit):
    """Three months, three actions each ``(month_no, month, theme, action_no, action)``."""
    rows = []
    for mi, (month, theme, actions) in enumerate(TT.ROADMAP):
        for ai, a in enumerate(actions):
            rows.append([F.lit(mi + 1), F.lit(month), F.lit(theme), F.lit(ai + 1), render(a, has_profit)])
    return _records(facts, by, ["month_no", "month", "theme", "action_no", "action"], rows, "row_no")


def decision_table(facts, by, has_profit):
    """Conclusion + four decisions ``(item_no, kind, text)``."""
    rows = [[F.lit("conclusion"), render(TT.CONCLUSION, has_profit)]]
    rows += [[F.lit("decision"), render(d, has_profit)] for d in TT.DECISIONS]
    return _records(facts, by, ["kind", "text"], rows, "item_no")


def report_metadata(facts, by, has_profit):
    """Cover rows ``(field_no, field, value)``; the date is an argument."""
    rows = [[F.lit(k), render(v, has_profit)] for k, v in TT.METADATA]
    return _records(facts, by, ["field", "value"], rows, "field_no")


def brief_prompts(facts, by, has_profit):
    """System + user prompt text per entity."""
    extra = _prompt_parts(has_profit)
    system = render(TT.PROMPT_SYSTEM, has_profit)
    user = render(TT.PROMPT_USER, has_profit, extra=extra)
    return facts.select(*by, F.trim(system).alias("system_prompt"), user.alias("user_prompt"))


def _prompt_parts(has_profit: bool) -> dict:
    return {
        "profit_lines": lambda: render(TT.PROMPT_PROFIT, has_profit),
        "section_list": lambda: F.lit(", ".join(TT.SECTIONS)),
        "field_list": lambda: F.lit(", ".join(TT.BLOCK_FIELDS)),
    }


def question_prompts(facts: DataFrame, by: Sequence[str], has_profit: bool, headers: Sequence[str]) -> DataFrame:
    """B10 for questions: one system text per entity with its facts, the rules and the answer headers."""
    extra = {**_prompt_parts(has_profit), "header_list": lambda: F.lit(", ".join(headers))}
    return facts.select(*by, render(TT.PROMPT_QUESTION, has_profit, extra=extra).alias("system_prompt"))


def summary_default(has_profit: bool) -> Column:
    return render(TT.SUMMARY_DEFAULT, has_profit)
