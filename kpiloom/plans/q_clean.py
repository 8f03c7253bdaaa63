"""Registered queries: cleaning, CSV source, sinks, previews, role mapping
(C*, S*, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mapping import Mapping, catalog_of, detect_columns, detect_columns_catalog
from ..operators import brief as B
from ..operators import clean as C
from ..operators import views as V
from ..session import scratch_path
from ..sources.csv import load_csv
from ..sources.fixtures import DIRTY_MAPPING, DIRTY_SQL, MIXED_SQL, dirty_sales, mixed_dates
from ..sources.manifest import read_whole, write_whole
from ..sources.sinks import read_briefs, read_table, write_briefs, write_table
from ..sources.tables import FACT_MAPPING, TABLES, load_table, sales_fact, tables
from . import q_brief as QB
from . import sql as Q
from .expected import DATE_HINTS, POSITION_FALLBACK, PRODUCT_HINTS, REGION_HINTS, REVENUE_EXCLUDE, ROLE_KEYWORDS
from .registry import query

MONEY = r"TRY_CAST(regexp_replace({c}, '[^0-9.\-]', '', 'g') AS DOUBLE)"
DIRTY_DATE = "CAST(try_strptime(sold_on, '%Y-%m-%d') AS TIMESTAMP)"


def _dirty(body: str) -> str:
    return f"WITH d AS ({DIRTY_SQL})\n{body}"


@query("drop_null_core", _dirty(
    "SELECT * FROM d WHERE sold_on IS NOT NULL AND region IS NOT NULL AND product IS NOT NULL "
    "AND revenue IS NOT NULL"))
def q_drop_null_core(spark, d):
    return C.drop_null_core(dirty_sales(spark, d), DIRTY_MAPPING)


@query("strip_currency", _dirty(
    r"SELECT row_id, regexp_replace(revenue, '[^0-9.\-]', '', 'g') AS revenue_digits FROM d"))
def q_strip_currency(spark, d):
    return dirty_sales(spark, d).select("row_id", C.strip_currency("revenue").alias("revenue_digits"))


@query("clean_amounts", _dirty(
    f"SELECT row_id, {MONEY.format(c='revenue')} AS revenue, {MONEY.format(c='profit')} AS profit FROM d"))
def q_clean_amounts(spark, d):
    df = dirty_sales(spark, d)
    return df.select("row_id", C.to_amount_col(df, "revenue").alias("revenue"),
                     C.to_amount_col(df, "profit").alias("profit"))


@query("clean_dates", _dirty(f"SELECT row_id, {DIRTY_DATE} AS sold_on FROM d"))
def q_clean_dates(spark, d):
    df = dirty_sales(spark, d)
    return df.select("row_id", C.to_timestamp_col(df, "sold_on", "yyyy-MM-dd").alias("sold_on"))


CLEAN_SQL = _dirty(f"""
SELECT row_id, {DIRTY_DATE} AS sold_on, region, product, {MONEY.format(c='revenue')} AS revenue,
       {MONEY.format(c='profit')} AS profit
FROM d WHERE sold_on IS NOT NULL AND region IS NOT NULL AND product IS NOT NULL AND revenue IS NOT NULL
  AND {DIRTY_DATE} IS NOT NULL AND {MONEY.format(c='revenue')} IS NOT NULL
  AND {MONEY.format(c='profit')} IS NOT NULL""")


@query("clean_dataset", CLEAN_SQL)
def q_clean_dataset(spark, d):
    return C.clean_dataset(dirty_sales(spark, d), DIRTY_MAPPING, "yyyy-MM-dd")


# Dates of other kinds, cleaned with the default format: text with the time, US text, integers of 8 and 4 digits.
_KINDS = {
    "timestamp_text": ("date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')",
                       "CAST(date_trunc('second', l_shipdate) AS TIMESTAMP)"),
    "us_text": ("date_format(l_shipdate, 'MM/dd/yyyy')", "strftime(l_shipdate, '%m/%d/%Y')", "CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)"),
    "int": ("CAST(CASE WHEN l_linenumber = 1 THEN date_format(l_shipdate, 'yyyy') WHEN l_linenumber = 2 THEN '20251340' WHEN l_linenumber = 3 THEN '77' "
            "ELSE date_format(l_shipdate, 'yyyyMMdd') END AS INT)", "",
            "CASE WHEN l_linenumber = 1 THEN make_timestamp(year(l_shipdate), 1, 1, 0, 0, 0.0) WHEN l_linenumber IN (2, 3) THEN NULL "
            "ELSE CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) END"),
}
_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS {}) || CASE WHEN l_linenumber = 4 THEN ' USD' ELSE '' END"


def _register_kind(kind, spark_sql, date_sql):
    amount = _AMOUNT.format("VARCHAR")

    @query(f"clean_dataset_{kind}", f"""
SELECT row_id, d, region, product, revenue FROM (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_id, {date_sql} AS d, l_returnflag AS region, l_linestatus AS product,
         {MONEY.format(c=amount)} AS revenue FROM lineitem) WHERE d IS NOT NULL AND revenue IS NOT NULL""")
    def run(spark, d):
        df = load_table(spark, d, "lineitem").select(
            F.expr("l_orderkey * 8 + l_linenumber").alias("row_id"), F.expr(spark_sql).alias("d"), F.col("l_returnflag").alias("region"),
            F.col("l_linestatus").alias("product"), F.expr(_AMOUNT.format("string")).alias("revenue"))
        return C.clean_dataset(df, _KIND_MAPPING)


_KIND_MAPPING = Mapping(date="d", region="region", product="product", revenue="revenue")
for _kind, (_spark, _, _date) in _KINDS.items():
    _register_kind(_kind, _spark, _date)


# Which core columns a mapping names: none of them in the table, one, all.
_CORES = {"none": Mapping(date="when", region="where", product="what", revenue="how_much"), "region": Mapping(date="when", region="region", product="what", revenue="how_much"), "all": DIRTY_MAPPING}


@query("clean_without_core", f"""
SELECT 'none' AS core, 'complete' AS step, CAST(0 AS BIGINT) AS n_rows UNION ALL SELECT 'none', 'cleaned', CAST(0 AS BIGINT)
UNION ALL SELECT 'region', 'complete', COUNT(*) FROM ({DIRTY_SQL}) WHERE region IS NOT NULL
UNION ALL SELECT 'region', 'cleaned', COUNT(*) FROM ({DIRTY_SQL}) WHERE region IS NOT NULL
UNION ALL SELECT 'all', 'cleaned', COUNT(*) FROM ({CLEAN_SQL})
UNION ALL SELECT 'all', 'complete', COUNT(*) FROM ({DIRTY_SQL}) WHERE sold_on IS NOT NULL AND region IS NOT NULL AND product IS NOT NULL AND revenue IS NOT NULL""")
def q_clean_without_core(spark, d):
    """Without any core column nothing is left; with some of them only those count."""
    df, out = dirty_sales(spark, d), None
    for name, m in _CORES.items():
        for step, kept in (("complete", C.drop_null_core(df, m)), ("cleaned", C.clean_dataset(df, m, "yyyy-MM-dd"))):
            row = kept.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("core"), F.lit(step).alias("step"), "n_rows")
            out = row if out is None else out.unionByName(row)
    return out


@query("cleaning_report", _dirty(f"""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (why = 1) AS null_core, COUNT(*) FILTER (why = 2) AS bad_date,
       COUNT(*) FILTER (why = 3) AS bad_revenue, COUNT(*) FILTER (why = 4) AS bad_profit, COUNT(*) FILTER (why = 0) AS n_kept
FROM (SELECT CASE WHEN sold_on IS NULL OR region IS NULL OR product IS NULL OR revenue IS NULL THEN 1 WHEN {DIRTY_DATE} IS NULL THEN 2
                  WHEN {MONEY.format(c='revenue')} IS NULL THEN 3 WHEN {MONEY.format(c='profit')} IS NULL THEN 4 ELSE 0 END AS why FROM d)"""))
def q_cleaning_report(spark, d):
    """Rows dropped for each reason, with the default date format."""
    return C.cleaning_report(dirty_sales(spark, d), DIRTY_MAPPING)


_AUTO = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
         ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("MM/dd/yyyy", "%m/%d/%Y"),
         ("dd/MM/yyyy", "%d/%m/%Y"), ("MMM yyyy", "%b %Y"), ("yyyy-MM", "%Y-%m"), ("yyyyMMdd", "%Y%m%d")]
assert [a for a, _ in _AUTO] == C.DATE_FORMATS
_counts = ", ".join(f"COUNT(try_strptime(d, '{f}')) AS c{i}" for i, (_, f) in enumerate(_AUTO))
_pick = " ".join(f"WHEN {i} THEN try_strptime(d, '{f}')" for i, (_, f) in enumerate(_AUTO))
_unpivot = " UNION ALL ".join(f"SELECT {i} AS i, c{i} AS n FROM h" for i in range(len(_AUTO)))


@query("clean_dates_auto", f"""
WITH m AS ({MIXED_SQL}), h AS (SELECT {_counts} FROM m),
best AS (SELECT i FROM ({_unpivot}) ORDER BY n DESC, i LIMIT 1),
p AS (SELECT row_id, CAST(CASE (SELECT i FROM best) {_pick} END AS TIMESTAMP) AS d FROM m)
SELECT row_id, d FROM p WHERE d IS NOT NULL""")
def q_clean_dates_auto(spark, d):
    df = mixed_dates(spark, d).withColumn("region", F.lit("x")).withColumn("product", F.lit("x")) \
        .withColumn("rev", F.lit(1.0))
    m = Mapping(date="d", region="region", product="product", revenue="rev")
    return C.clean_dataset(df, m, "auto").select("row_id", "d")


# --- S1 / S4 / S5 / S6 -------------------------------------------------------
_CSV_SQL = Q.with_fact("""
SELECT strftime(order_date, '%Y-%m-%d') AS order_date, region, nation, product, brand, segment,
       CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit FROM f""")


@query("load_csv", _CSV_SQL)
def q_load_csv(spark, d):
    """Fact written as CSV text to the shared folder, then read back with ``load_csv``."""
    f = sales_fact(spark, d)
    text = f.select(F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "region", "nation",
                    "product", "brand", "segment", F.col("revenue").cast("string").alias("revenue"),
                    F.col("profit").cast("string").alias("profit"))
    path = write_table(text, scratch_path(spark, "csv-fact"), "csv")
    return load_csv(spark, path)


_REPORT_SQL = Q.with_fact(f"""
SELECT segment, CAST(rn AS INTEGER) AS rank, k AS region, {Q.truncate_label('k', 20)} AS label,
       CAST(rev AS DOUBLE) AS revenue, share, CAST(prof AS DOUBLE) AS profit, {Q.group_margin('prof', 'rev')} AS margin
FROM (SELECT *, CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER (PARTITION BY segment) AS DOUBLE) * 100.0 AS share,
             ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rev DESC, k) AS rn
      FROM (SELECT segment, nation AS k, SUM(revenue) AS rev, SUM(profit) AS prof FROM f GROUP BY 1, 2))
WHERE rn <= 15""")


@query("sink_roundtrip", _REPORT_SQL)
def q_sink_roundtrip(spark, d):
    """Report table written partitioned by entity to the shared folder and read back."""
    table = V.region_report_table(sales_fact(spark, d), FACT_MAPPING, ["segment"])
    path = write_table(table, scratch_path(spark, "region-report"), "parquet", partition_by=["segment"])
    return read_table(spark, path).select("segment", "rank", "region", "label", "revenue", "share",
                                          "profit", "margin")


@query("sink_manifest", _REPORT_SQL)
def q_sink_manifest(spark, d):
    """The same table through a manifest, which the reader holds the files against."""
    table = V.region_report_table(sales_fact(spark, d), FACT_MAPPING, ["segment"])
    path = scratch_path(spark, "region-report")
    write_whole(table, path, ["segment", "rank"])
    return read_whole(spark, path).select("segment", "rank", "region", "label", "revenue", "share", "profit", "margin")


@query("preview", f"SELECT * FROM ({CLEAN_SQL}) ORDER BY row_id LIMIT 20")
def q_preview(spark, d):
    """First rows of the cleaned table in an explicit order (a top-k by key)."""
    return C.preview(C.clean_dataset(dirty_sales(spark, d), DIRTY_MAPPING), ["row_id"], 20)


@query("raw_preview", _dirty("SELECT * FROM d ORDER BY row_id LIMIT 20"))
def q_raw_preview(spark, d):
    """Raw rows shown when the chosen mapping cleans everything away
    (here revenue is mapped to a text column, so nothing survives)."""
    raw = dirty_sales(spark, d)
    wrong = DIRTY_MAPPING.with_overrides({"revenue": "product", "profit": None})
    return C.raw_preview(raw, C.clean_dataset(raw, wrong), ["row_id"], 20)


@query("briefs_as_text", QB.brief_sql(f"SELECT segment, {QB.markdown_sql(True)} AS brief FROM bt"))
def q_briefs_as_text(spark, d):
    """Briefs written as text files, one folder for each segment, and read back."""
    briefs = B.brief_markdown(QB.facts(spark, d), QB.BY, True)
    return read_briefs(spark, write_briefs(briefs, "brief", QB.BY), QB.BY)


# --- M1-M8 -------------------------------------------------------------------
def _kw(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any_in(words):
    return f"list_bool_or([contains(lower(column_name), w) for w in {_kw(words)}])"


def _rank_sql(role):
    keys = ROLE_KEYWORDS[role]
    e = (f"CASE WHEN list_contains({_kw(keys)}, {Q.py_strip('lower(column_name)')}) THEN 1 "
         f"WHEN {_any_in(keys)} THEN 2 ")
    if role == "revenue":
        e += f"WHEN is_num AND NOT {_any_in(REVENUE_EXCLUDE)} THEN 3 "
    hints = {"date": DATE_HINTS, "region": REGION_HINTS, "product": PRODUCT_HINTS}.get(role)
    if hints:
        e += f"WHEN {_any_in(hints)} THEN 3 "
    pos = POSITION_FALLBACK.get(role)
    if pos:
        e += f"WHEN ordinal_position = CASE WHEN ncols >= {pos} THEN {pos} ELSE 1 END THEN 4 "
    return e + "END"


_NUMERIC = ("data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') "
            "OR data_type LIKE 'DECIMAL%'")
_ROLES = ["revenue", "profit", "date", "region", "product"]


def _detect_sql(overrides=None):
    sel = []
    for r in _ROLES:
        e = f"arg_min(column_name, ({_rank_sql(r)}) * 10000 + ordinal_position)"
        for table, roles in (overrides or {}).items():
            if r in roles:
                e = f"CASE WHEN table_name = '{table}' THEN '{roles[r]}' ELSE {e} END"
        sel.append(f"{e} AS {r}_col")
    names = ", ".join(f"'{t}'" for t in TABLES)
    return f"""
SELECT table_name AS "table", {', '.join(sel)}
FROM (SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, column_name,
             ({_NUMERIC}) AS is_num, COUNT(*) OVER (PARTITION BY table_name) AS ncols
      FROM information_schema.columns WHERE table_name IN ({names}))
GROUP BY table_name"""


# The core columns that the rules give, worked out by hand: date, region, product, revenue.
EXPECTED_CORE = {
    "region": ("r_regionkey", "r_regionkey", "r_name", "r_regionkey"), "nation": ("n_nationkey", "n_regionkey", "n_name", "n_nationkey"),
    "customer": ("c_custkey", "c_name", "c_mktsegment", "c_custkey"), "supplier": ("s_suppkey", "s_name", "s_name", "s_suppkey"),
    "part": ("p_partkey", "p_name", "p_type", "p_retailprice"), "orders": ("o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice"),
    "lineitem": ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"), "events": ("event_id", "ts", "event_type", "value"),
    "documents": ("doc_id", "text", "lang", "n_chars"), "embeddings": ("vec_id", "embedding", "label", "label"),
    "pages": ("page_id", "url", "html", "page_id"), "benchmark": ("item_id", "text", "item_id", "item_id"),
    "labels": ("doc_id", "quality", "toxic", "quality"), "conversations": ("conv_id", "turn", "role", "turn"),
}
OVERRIDES = {"lineitem": {"region": "l_returnflag", "product": "l_linestatus", "profit": "l_tax"}}


def _mapped_sql(overrides=None):
    """Roles by the catalog rules; rows and complete rows of each table by the columns above."""
    counts = []
    for t, core in EXPECTED_CORE.items():
        roles = dict(zip(("date", "region", "product", "revenue"), core)) | (overrides or {}).get(t, {})
        complete = " AND ".join(f"{roles[r]} IS NOT NULL" for r in ("date", "region", "product", "revenue"))
        counts.append(f"SELECT '{t}' AS tn, COUNT(*) AS n_rows, COUNT(*) FILTER ({complete}) AS n_complete FROM {t}")
    return f"""SELECT m.*, n_rows, n_complete FROM ({_detect_sql(overrides)}) m JOIN ({' UNION ALL '.join(counts)}) c ON m."table" = c.tn"""


def _mapped(spark, d, overrides=None):
    """Roles from the catalog job; for each table, with the roles that its schema gives, its rows and complete rows."""
    all_tables = tables(spark, d)
    counts = None
    for name, df in all_tables.items():
        core = C.core_columns(df, detect_columns(df, (overrides or {}).get(name)))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(C.complete(df, core), 1)).alias("n_complete")).withColumn("_t", F.lit(name))
        counts = row if counts is None else counts.unionByName(row)
    return detect_columns_catalog(catalog_of(spark, all_tables), overrides).join(counts, F.col("table") == F.col("_t")).drop("_t")


@query("detect_columns", _mapped_sql())
def q_detect_columns(spark, d):
    """M1-M6, M8: the roles of every driver table, and how many of its rows are complete under them."""
    return _mapped(spark, d)


@query("detect_override", _mapped_sql(OVERRIDES))
def q_detect_override(spark, d):
    """M7: the user's choice replaces detected roles."""
    return _mapped(spark, d, OVERRIDES)
