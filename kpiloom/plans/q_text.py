"""Registered queries: markdown sections / blocks over whole documents and
over generated briefs (X1, X2, P15, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import PY_SPACE
from ..operators import brief as B
from ..operators import textops as X
from ..sources.tables import load_table
from . import expected as TT
from . import q_brief as QB
from . import sql as Q
from .registry import query

ASCII_ONLY = r"regexp_replace({x}, '[^\x00-\x7F]+', '', 'g')"


def _strip(x):
    return Q.py_strip(x)


def _bold(x):
    return f"replace(regexp_replace({x}, '(?s)\\*\\*(.*?)\\*\\*', '<b>\\1</b>', 'g'), '**', '<b>')"


def section_sql(source: str, id_col: str, text_col: str, section: str) -> str:
    """X1 twin: lines with ordinality + windowed start/end positions."""
    tgt = Q.lit(section.lower())
    return f"""
xl AS (SELECT {id_col} AS id, o AS i, l FROM {source}, unnest(string_split({text_col}, chr(10))) WITH ORDINALITY AS u(l, o)),
xf AS (SELECT *, starts_with(l, '#') AS is_head,
              starts_with(l, '#') AND contains(lower({ASCII_ONLY.format(x='l')}), {tgt}) AS is_match FROM xl),
xs AS (SELECT *, MIN(i) FILTER (WHERE is_match) OVER (PARTITION BY id) AS st FROM xf),
xe AS (SELECT *, MIN(i) FILTER (WHERE i > st AND is_head AND NOT is_match) OVER (PARTITION BY id) AS en FROM xs),
xk AS (SELECT id, i, {_strip("replace(replace(l, '**', ''), '- ', '• ')")} AS c FROM xe
       WHERE st IS NOT NULL AND i > st AND i < COALESCE(en, 9223372036854775807) AND NOT is_head),
xr AS (SELECT id, {_strip("string_agg(c, chr(10) || chr(10) ORDER BY i)")} AS section FROM xk WHERE c <> '' GROUP BY id)"""


@query("markdown_section", f"""
WITH {section_sql('documents', 'doc_id', 'text', 'Key Findings').strip()}
SELECT d.doc_id, COALESCE(xr.section, '') AS section FROM documents d LEFT JOIN xr ON d.doc_id = xr.id""")
def q_markdown_section(spark, d):
    docs = load_table(spark, d, "documents")
    return X.markdown_section(docs, "text", "Key Findings").select("doc_id", "section")


# Every document as a Markdown report made from its own lines: title, findings as bullets (for even ids once more under a
# second heading), numbered points, bold words that close, stay open, or run over a carriage return.  NL, CR: line ends.
_REPORT = """'# Report ' || CAST(doc_id AS {string}) || {nl} || '## Key Findings' || {nl} || '- ' || replace(text, {nl}, {nl} || '- ')
  || CASE WHEN doc_id % 3 = 0 THEN {nl} || '## Other points' || {nl} || '1. **first**' || {nl} || '2. second ' || {cr} || '**third' || {cr} || 'part**' || {nl}
          ELSE {nl} || '* **open' || {nl} END
  || CASE WHEN doc_id % 2 = 0 THEN '## Key Findings again' || {nl} || 'more **bold** text' || {nl} || '### Small' || {nl} || 'end'
          ELSE '# Major' || {nl} || {nl} || 'end **' END"""
_REPORTS = f"reports AS (SELECT doc_id, {_REPORT.format(string='VARCHAR', nl='chr(10)', cr='chr(13)')} AS text FROM documents)"


def _reports(spark, d):
    text = F.expr(_REPORT.format(string="string", nl="char(10)", cr="char(13)"))
    return load_table(spark, d, "documents").select("doc_id", text.alias("text"))


@query("markdown_section_reports", f"""
WITH {_REPORTS}, {section_sql('reports', 'doc_id', 'text', 'Key Findings').strip()}
SELECT d.doc_id, COALESCE(xr.section, '') AS section FROM documents d LEFT JOIN xr ON d.doc_id = xr.id""")
def q_markdown_section_reports(spark, d):
    """X1 over documents that have headings: sections with bullets, some in two parts."""
    return X.markdown_section(_reports(spark, d), "text", "Key Findings").select("doc_id", "section")


def _briefs_cte():
    return f"briefs AS (SELECT bt.*, {QB.markdown_sql(True)} AS brief FROM bt)"


def _brief_section_sql(section, select):
    body = f"WITH {section_sql('briefs', 'segment', 'brief', section).strip()}\n{select}"
    # splice the brief CTEs in front of the section CTEs
    sql = QB.brief_sql("SELECT 1")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return head + ",\n" + _briefs_cte() + ",\n" + body[len("WITH "):]


@query("brief_section_extract", _brief_section_sql(
    "Critical Risks",
    "SELECT b.segment, COALESCE(xr.section, '') AS section FROM briefs b LEFT JOIN xr ON b.segment = xr.id"))
def q_brief_section_extract(spark, d):
    md = B.brief_markdown(QB.facts(spark, d), QB.BY, True)
    return X.markdown_section(md, "brief", "Critical Risks").select("segment", "section")


# Briefs of segments whose name is longer than 9 characters lose their first heading, so that the default takes over.
_CUT = "CASE WHEN length(segment) > 9 THEN replace(brief, '## Executive Summary', '## Foreword') ELSE brief END"


def _summary_sql():
    sql = QB.brief_sql("SELECT 1")
    return (sql[: sql.rindex("SELECT 1")].rstrip() + ",\n" + _briefs_cte() + f",\ncut AS (SELECT * REPLACE ({_CUT} AS brief) FROM briefs),\n"
            + section_sql("cut", "segment", "brief", "Executive Summary").strip()
            + f"\nSELECT b.segment, COALESCE(NULLIF(xr.section, ''), {Q.render(TT.SUMMARY_DEFAULT, True)}) AS summary "
            "FROM cut b LEFT JOIN xr ON b.segment = xr.id")


@query("summary_or_default", _summary_sql())
def q_summary_or_default(spark, d):
    """The brief's Executive Summary section, else a generated sentence."""
    facts = QB.facts(spark, d)
    md = facts.select("segment", B.markdown_column(True).alias("brief"), B.summary_default(True).alias("_default"))
    sec = X.markdown_section(md.withColumn("brief", F.expr(_CUT)), "brief", "Executive Summary")
    return sec.select("segment", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.col("_default")).alias("summary"))


def blocks_sql(source: str, id_col: str, text_col: str) -> str:
    s = _strip("l")
    clean = lambda x: _strip(ASCII_ONLY.format(x=x))
    return f"""
bl AS (SELECT {id_col} AS id, CAST(o - 1 AS INTEGER) AS line_no, {s} AS s
       FROM {source}, unnest(string_split({text_col}, chr(10))) WITH ORDINALITY AS u(l, o)),
bk AS (SELECT id, line_no, s,
  starts_with(s, '- ') OR starts_with(s, '* ') AS is_bullet,
  regexp_matches(s, '^[0-9]\\. ') AND length(s) > 2 AS is_num FROM bl WHERE s <> ''),
bo AS (SELECT id, line_no,
  CASE WHEN starts_with(s, '## ') THEN 'heading' WHEN starts_with(s, '# ') THEN 'major'
       WHEN is_bullet OR is_num THEN 'bullet' ELSE 'body' END AS kind,
  CASE WHEN starts_with(s, '## ') THEN {clean('substring(s, 4)')}
       WHEN starts_with(s, '# ') THEN {clean('substring(s, 3)')}
       WHEN is_bullet THEN {_bold(clean('substring(s, 3)'))}
       WHEN is_num THEN {_bold(clean('substring(s, 4)'))}
       ELSE {_bold(clean('s'))} END AS text FROM bk)"""


@query("markdown_blocks", f"WITH {blocks_sql('documents', 'doc_id', 'text').strip()}\n"
                          "SELECT id AS doc_id, line_no, kind, text FROM bo")
def q_markdown_blocks(spark, d):
    return X.markdown_blocks(load_table(spark, d, "documents"), "doc_id", "text")


@query("markdown_blocks_reports", f"WITH {_REPORTS}, {blocks_sql('reports', 'doc_id', 'text').strip()}\n"
                                  "SELECT id AS doc_id, line_no, kind, text FROM bo")
def q_markdown_blocks_reports(spark, d):
    """X2 over documents that have headings, bullets, numbers and bold words: all four kinds."""
    return X.markdown_blocks(_reports(spark, d), "doc_id", "text")


def _brief_blocks_sql():
    sql = QB.brief_sql("SELECT 1")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return (head + ",\n" + _briefs_cte() + ",\n" + blocks_sql("briefs", "segment", "brief").strip()
            + "\nSELECT id AS segment, line_no, kind, text FROM bo")


@query("brief_blocks", _brief_blocks_sql())
def q_brief_blocks(spark, d):
    md = B.brief_markdown(QB.facts(spark, d), QB.BY, True)
    return X.markdown_blocks(md, "segment", "brief")


def _decorate_sql(x):
    out = x
    for old, new in TT.HEADING_DECORATION.items():
        out = f"replace({out}, {Q.lit(old)}, {Q.lit(new)})"
    return out


@query("decorate_headings", (lambda s: s[: s.rindex("SELECT 1")] + "SELECT segment, "
                             + _decorate_sql(QB.markdown_sql(True)) + " AS brief FROM bt")(QB.brief_sql("SELECT 1")))
def q_decorate_headings(spark, d):
    md = B.brief_markdown(QB.facts(spark, d), QB.BY, True)
    return md.select("segment", X.decorate_headings(F.col("brief")).alias("brief"))
