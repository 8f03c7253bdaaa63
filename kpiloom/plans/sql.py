"""DuckDB oracle SQL builders.

The statements use plain GROUP BYs and ROW_NUMBER windows instead of grouping
sets and ``min_by`` structs, and texts from ``expected.py`` instead of the
operators' templates.  Every statement starts from the same fact text
(``FACT_SQL``), over the driver's pre-registered parquet views.
"""

from __future__ import annotations

import re

from ..sources.tables import FACT_SQL

INF = "CAST('infinity' AS DOUBLE)"


def with_fact(body: str, fact: str = FACT_SQL, extra_ctes: str = "") -> str:
    ctes = f"f AS ({fact})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def group_margin(p: str, r: str) -> str:
    """P3 in SQL: x/0 → ±inf, 0/0 → NULL."""
    return (f"CASE WHEN CAST({r} AS DOUBLE) <> 0 THEN CAST({p} AS DOUBLE) / CAST({r} AS DOUBLE) * 100.0 "
            f"WHEN {p} < 0 THEN -{INF} WHEN {p} > 0 THEN {INF} END")


def clamp(x: str) -> str:
    return f"LEAST(100.0, GREATEST(0.0, {x}))"


def fmt(x: str, digits: int, thousands: bool = False, sign: bool = False) -> str:
    spec = "{:" + ("+" if sign else "") + ("," if thousands else "") + f".{digits}f" + "}"
    v = f"CAST({x} AS DOUBLE)"
    return (f"CASE WHEN isnan({v}) THEN 'nan' WHEN {v} = {INF} THEN '{'+inf' if sign else 'inf'}' "
            f"WHEN {v} = -{INF} THEN '-inf' ELSE format('{spec}', ROUND({v}, {digits})) END")


def money(x: str) -> str:
    return f"('$' || {fmt(x, 2, True)})"


def money0(x: str) -> str:
    return f"('$' || {fmt(x, 0, True)})"


def pct1(x: str) -> str:
    return f"({fmt(x, 1)} || '%')"


def format_metric(x: str) -> str:
    a = f"ABS(CAST({x} AS DOUBLE))"
    body = (f"CASE WHEN {a} >= 1000000 THEN {fmt(a + ' / 1000000', 2)} || 'M' "
            f"WHEN {a} >= 1000 THEN {fmt(a + ' / 1000', 1)} || 'K' "
            f"ELSE {fmt(a, 0, True)} END")
    return (f"CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) THEN 'N/A' "
            f"ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || '$' || {body} END")


PY_SPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def truncate_label(x: str, n: int) -> str:
    s = py_strip(f"CAST({x} AS VARCHAR)")
    return (f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN length({s}) > {n} "
            f"THEN substring({s}, 1, {n - 3}) || '...' ELSE {s} END")


def trend_class(p: str) -> str:
    return f"CASE WHEN {p} > 5 THEN 'upward' WHEN {p} < -5 THEN 'downward' ELSE 'stable' END"


def growth_statement(n: str, p: str, first: str, last: str) -> str:
    return (f"CASE WHEN {n} > 1 THEN 'a ' || {trend_class(p)} || ' revenue path of ' || "
            f"{fmt(p, 1, sign=True)} || '% between ' || {first} || ' and ' || {last} "
            f"ELSE 'a single billing month, so no trend can be measured yet' END")


def health_class(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'Robust' WHEN {s} >= 60 THEN 'Stable' ELSE 'Vulnerable' END"


def margin_band(m: str) -> str:
    return f"CASE WHEN {m} >= 15 THEN 'positive' WHEN {m} >= 5 THEN 'neutral' ELSE 'negative' END"


def _by(by):
    b = ", ".join(by)
    return b, (b + ", " if by else ""), (f"PARTITION BY {b}" if by else "")


def _join(names, by):
    first, rest = names[0], names[1:]
    if by:
        return first + "".join(f" JOIN {n} USING ({', '.join(by)})" for n in rest)
    return first + "".join(f" CROSS JOIN {n}" for n in rest)


def kpi_facts_ctes(by, profit: bool = True, region: str = "nation", product: str = "product") -> str:
    """CTEs ending in ``kf``: one row per entity with KPI + brief facts."""
    B, Bc, part = _by(by)
    pr = "SUM(profit)" if profit else "CAST(NULL AS DOUBLE)"
    m = group_margin("prof", "rev")
    top_m = f"CASE WHEN top_product IS NULL THEN 0.0 ELSE top_product_margin END" if profit else "0.0"
    ctes = f"""
t AS (SELECT {Bc} COUNT(*) AS n_rows, SUM(revenue) AS rev, {pr} AS prof FROM f GROUP BY ALL),
r AS (SELECT {Bc} {region} AS k, SUM(revenue) AS rev, {pr} AS prof FROM f GROUP BY ALL),
p AS (SELECT {Bc} {product} AS k, SUM(revenue) AS rev, {pr} AS prof FROM f GROUP BY ALL),
mth AS (SELECT {Bc} strftime(order_date, '%Y-%m') AS k, SUM(revenue) AS rev FROM f GROUP BY ALL),
rs AS (SELECT {Bc} COUNT(*) AS n_regions, SUM(CAST(rev AS DOUBLE) * CAST(rev AS DOUBLE)) AS sumsq FROM r GROUP BY ALL),
rt AS (SELECT {Bc} k AS top_region, CAST(rev AS DOUBLE) AS top_region_rev
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY rev DESC, k) AS rn FROM r) WHERE rn = 1),
pt AS (SELECT {Bc} k AS top_product, CAST(rev AS DOUBLE) AS top_product_rev, {m} AS top_product_margin
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY rev DESC, k) AS rn FROM p) WHERE rn = 1),
rw AS (SELECT {Bc} k AS worst_region, mg AS worst_region_margin
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY mg, k) AS rn
             FROM (SELECT *, {m} AS mg FROM r) WHERE mg IS NOT NULL) WHERE rn = 1),
pw AS (SELECT {Bc} k AS worst_product, mg AS worst_product_margin
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY mg, k) AS rn
             FROM (SELECT *, {m} AS mg FROM p) WHERE mg IS NOT NULL) WHERE rn = 1),
ms AS (SELECT {Bc} COUNT(*) AS n_months, MIN(k) AS first_month, MAX(k) AS last_month,
              AVG(CAST(rev AS DOUBLE)) AS mean_m, STDDEV_SAMP(CAST(rev AS DOUBLE)) AS std_m FROM mth GROUP BY ALL),
mf AS (SELECT {Bc} CAST(rev AS DOUBLE) AS first_rev
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY k) AS rn FROM mth) WHERE rn = 1),
ml AS (SELECT {Bc} CAST(rev AS DOUBLE) AS last_rev
       FROM (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY k DESC) AS rn FROM mth) WHERE rn = 1),
x AS (SELECT * FROM {_join(['t', 'rs', 'rt', 'pt', 'rw', 'pw', 'ms', 'mf', 'ml'], by) if profit
                      else _join(['t', 'rs', 'rt', 'pt', 'ms', 'mf', 'ml'], by)}),
y AS (SELECT *,
        CAST(rev AS DOUBLE) AS total,
        CASE WHEN first_rev <> 0 THEN (last_rev - first_rev) / first_rev ELSE 0.0 END AS growth,
        CASE WHEN first_rev <> 0 THEN (last_rev - first_rev) / first_rev * 100.0 ELSE 0.0 END AS pct_change,
        CASE WHEN mean_m > 0 THEN std_m / mean_m ELSE 1.0 END AS cv
      FROM x),
z AS (SELECT *,
        CASE WHEN n_months > 1 THEN {clamp('50.0 + growth * 100.0 * 2.5')} ELSE 75.0 END AS gs,
        CASE WHEN n_months > 1 THEN {clamp('100.0 - cv * 100.0')} ELSE 85.0 END AS cs,
        CASE WHEN total > 0 AND n_regions > 1
             THEN {clamp('(1.0 - sumsq / (total * total)) / (1.0 - 1.0 / CAST(n_regions AS DOUBLE)) * 100.0')}
             ELSE 50.0 END AS bs,
        {'CASE WHEN CAST(rev AS DOUBLE) <> 0 THEN CAST(prof AS DOUBLE) / CAST(rev AS DOUBLE) * 100.0 ELSE 0.0 END' if profit else '0.0'} AS pm
      FROM y),
w AS (SELECT *, {clamp('pm / 40.0 * 100.0') if profit else 'CAST(NULL AS DOUBLE)'} AS msc FROM z),
v AS (SELECT *, CAST(ROUND_EVEN({'0.30 * msc + 0.25 * gs + 0.25 * cs + 0.20 * bs' if profit
                              else '0.35 * gs + 0.35 * cs + 0.30 * bs'}, 0) AS INTEGER) AS score FROM w),
kf AS (SELECT {Bc}
        CAST(n_rows AS BIGINT) AS n_rows, total AS total_revenue,
        {'CAST(prof AS DOUBLE)' if profit else '0.0'} AS total_profit, pm AS profit_margin,
        top_region, top_region_rev, top_product, top_product_rev,
        ROUND(gs, 6) AS growth_score, ROUND(cs, 6) AS consistency_score, ROUND(bs, 6) AS balance_score,
        ROUND(msc, 6) AS margin_score, score AS health_score, {health_class('score')} AS health_status,
        n_regions, n_months, first_month, last_month, pct_change,
        {growth_statement('n_months', 'pct_change', 'first_month', 'last_month')} AS growth_statement,
        {"COALESCE(worst_region, 'N/A')" if profit else "'N/A'"} AS worst_region,
        {'COALESCE(worst_region_margin, 0.0)' if profit else '0.0'} AS worst_region_margin,
        {"COALESCE(worst_product, 'N/A')" if profit else "'N/A'"} AS worst_product,
        {'COALESCE(worst_product_margin, 0.0)' if profit else '0.0'} AS worst_product_margin,
        {top_m} AS top_product_margin, {'TRUE' if profit else 'FALSE'} AS has_profit
      FROM v)"""
    return ctes.strip()


KPI_COLS = ("n_rows, total_revenue, total_profit, profit_margin, top_region, top_region_rev, "
            "top_product, top_product_rev, growth_score, consistency_score, balance_score, "
            "margin_score, health_score, health_status")


# --- template rendering (twin of operators.brief.render) ----------------------

def pick(template, has_profit: bool):
    return (template[0] if has_profit else template[1]) if isinstance(template, tuple) else template


def fields_of(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PLACEHOLDERS = {
    "total_revenue": money("total_revenue"),
    "total_profit": money("total_profit"),
    "profit_margin": fmt("profit_margin", 1),
    "health_score": "CAST(health_score AS VARCHAR)",
    "health_status": "health_status",
    "top_region": "top_region",
    "top_product": "top_product",
    "worst_region": "worst_region",
    "worst_product": "worst_product",
    "top_region_rev": money("top_region_rev"),
    "top_product_rev": money("top_product_rev"),
    "top_region_rev0": money0("top_region_rev"),
    "worst_region_margin": fmt("worst_region_margin", 1),
    "worst_product_margin": fmt("worst_product_margin", 1),
    "top_product_margin": fmt("top_product_margin", 1),
    "growth_statement": "growth_statement",
    "top_region15": truncate_label("top_region", 15),
    "top_product15": truncate_label("top_product", 15),
    "worst_product15": truncate_label("worst_product", 15),
    "industry": "industry",
    "report_date": "report_date",
    "guidance": "guidance",
}


def render(template, has_profit: bool, base: str | None = None, extra: dict | None = None,
           fields: list | None = None) -> str:
    text = pick(template, has_profit)
    values = {**PLACEHOLDERS, **(extra or {})}
    out = base if base is not None else lit(text)
    names = fields_of(text) if base is None else (fields if fields is not None else list(values))
    for n in names:
        if n in values:
            out = f"replace({out}, '{{{n}}}', COALESCE({values[n]}, 'nan'))"
    return out
