"""Markdown text tables (X1, X2, P15) over whole documents.

* ``markdown_section`` (X1) works inside each row with array functions on
  the document's lines: no explode, no shuffle, any document size.
* ``markdown_blocks`` (X2) explodes lines with their position (narrow
  transform, no shuffle) and classifies each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# ---------------------------------------------------------------------------
# Line markers.
HEADING, MAJOR = "## ", "# "
BULLETS = ["- ", "* "]
NUMBERED = r"^[0-9]\. "
SECTION_BULLET = ("- ", "• ")      # "- " becomes "• " in extracted sections
# ---------------------------------------------------------------------------


def section_target(name: str) -> str:
    import re
    return re.sub(r"[^\x00-\x7F]+", "", name).lower().strip()


def markdown_section(df: DataFrame, text_col: str, section: str, out: str = "section") -> DataFrame:
    """Adds ``out`` = the paragraphs under the first heading containing
    ``section``.

    Capture starts after a line beginning with '#' whose ASCII-only lower
    text contains the target; further matching headings are skipped; the
    first other heading ends it.  '**' is dropped, '- ' becomes '• ', lines
    are stripped, blanks dropped, and the rest joined by blank lines.

    Each step is its own projection over materialised arrays, so every line
    is visited a constant number of times (linear in the document size).
    """
    target = F.lit(section_target(section))
    text = F.col(text_col)
    d = df.withColumn("_x_lines", F.split(text, "\n", -1))
    d = d.withColumn("_x_marks", F.transform(F.col("_x_lines"), lambda l, i: F.struct(
        (i + 1).alias("i"), F.startswith(l, F.lit("#")).alias("h"),
        (F.startswith(l, F.lit("#")) & F.contains(F.lower(S.strip_non_ascii(l)), target)).alias("m"))))
    d = d.withColumn("_x_st", F.coalesce(F.array_min(F.transform(F.filter("_x_marks", lambda x: x["m"]),
                                                                 lambda x: x["i"])), F.lit(0)))
    d = d.withColumn("_x_en", F.coalesce(
        F.array_min(F.transform(F.filter("_x_marks", lambda x: (x["i"] > F.col("_x_st")) & x["h"] & ~x["m"]),
                                lambda x: x["i"])),
        F.size("_x_lines") + 1))
    kept = F.filter(F.transform(F.col("_x_lines"), lambda l, i: F.struct((i + 1).alias("i"), l.alias("l"))),
                    lambda x: (F.col("_x_st") > 0) & (x["i"] > F.col("_x_st")) & (x["i"] < F.col("_x_en"))
                    & ~F.startswith(x["l"], F.lit("#")))
    cleaned = F.transform(kept, lambda x: S.py_strip(F.replace(F.replace(x["l"], F.lit("**"), F.lit("")),
                                                               F.lit(SECTION_BULLET[0]), F.lit(SECTION_BULLET[1]))))
    joined = S.py_strip(F.array_join(F.filter(cleaned, lambda x: x != ""), "\n\n"))
    d = d.withColumn(out, F.when(text.isNull() | (text == ""), F.lit("")).otherwise(joined))
    return d.drop("_x_lines", "_x_marks", "_x_st", "_x_en")


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line_no, kind, text)`` per non-blank line; kinds heading /
    major / bullet / body; text ASCII-only, ``**x**`` → ``<b>x</b>`` (not in
    headings).  Each step is its own projection over plain columns, so no
    regex runs twice on a line."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "raw"))
    t = (lines.select(id_col, F.col("line_no").cast("int").alias("line_no"), S.py_strip_fast("raw").alias("s"))
         .filter(F.col("s") != ""))
    c = F.col("s")
    is_bullet = F.startswith(c, F.lit(BULLETS[0])) | F.startswith(c, F.lit(BULLETS[1]))
    is_num = c.rlike(NUMBERED) & (F.length(c) > 2)
    kind = (F.when(F.startswith(c, F.lit(HEADING)), "heading").when(F.startswith(c, F.lit(MAJOR)), "major")
            .when(is_bullet, "bullet").when(is_num, "numbered").otherwise("body"))
    t = t.select(id_col, "line_no", "s", kind.alias("_k"))
    k = F.col("_k")
    # text after the marker: '## ' / numbered '1. ' → from char 4, '# ' / bullets → from char 3
    t = t.select(id_col, "line_no", "_k",
                 F.expr("substring(s, CASE _k WHEN 'heading' THEN 4 WHEN 'major' THEN 3 WHEN 'bullet' THEN 3 "
                        "WHEN 'numbered' THEN 4 ELSE 1 END)").alias("_b"))
    t = t.select(id_col, "line_no", "_k", S.strip_non_ascii("_b").alias("_a"))
    t = t.select(id_col, "line_no", "_k", S.py_strip_fast("_a").alias("_c"))
    text = F.when(k.isin("heading", "major"), F.col("_c")).otherwise(S.bold_to_html("_c"))
    out_kind = F.when(k == "numbered", "bullet").otherwise(k)
    return t.select(id_col, "line_no", out_kind.alias("kind"), text.alias("text"))


# Our decoration of the six brief headings for display.
HEADING_DECORATION = {
    "## Executive Summary": "### ◆ Executive Summary",
    "## Key Business Findings": "### ◆ Key Business Findings",
    "## Critical Risks": "### ▲ Critical Risks",
    "## Growth Opportunities": "### ▶ Growth Opportunities",
    "## Strategic Recommendations": "### ● Strategic Recommendations",
    "## Expected Business Impact": "### ■ Expected Business Impact",
}


def decorate_headings(text: Column) -> Column:
    return S.decorate_headings(text, HEADING_DECORATION)
