"""Registered queries: insights, recommendations and report overview."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..sources import views as V
from . import fixtures_sql as X
from .q_kpi import MONTHS_SQL, SALES_NUM, _corr_sql
from .registry import finalize, register


def _rule_ctes(src, cat, reg, date, cust, nums, missing_sum, ncols):
    """CTEs computing every rule over ``src``; each yields (position, rule, kind, value, text)."""
    t = f"""cat_t AS (SELECT {cat} AS k, SUM({src}_rev) AS total FROM {src} WHERE {cat} IS NOT NULL GROUP BY {cat}),
lead AS (SELECT k, CAST(total AS DOUBLE) AS top, (SELECT CAST(SUM(total) AS DOUBLE) FROM cat_t) AS alltot
         FROM cat_t ORDER BY total DESC, k LIMIT 1),
r1 AS (SELECT 1 AS position, 'category_leader' AS rule, 'info' AS kind, top / alltot * 100 AS value,
        'Product category <b>' || k || '</b> contributes <b>' || format('{{:.1f}}', top / alltot * 100)
        || '%</b> of total revenue, making it the primary driver.' AS text FROM lead),
r2 AS (SELECT 2, 'category_concentration', 'warn', top / alltot * 100,
        'Revenue is heavily concentrated in <b>' || k || '</b> (>50%), indicating portfolio concentration risk.'
        FROM lead WHERE top / alltot * 100 > 50),
reg_t AS (SELECT CAST({reg} AS VARCHAR) AS k, SUM({src}_rev) AS total FROM {src} WHERE {reg} IS NOT NULL GROUP BY {reg}),
r3 AS (SELECT 3, 'region_spread', 'info', (SELECT ROUND(CAST(total AS DOUBLE), 2) FROM reg_t ORDER BY total DESC, k LIMIT 1),
        'The <b>' || (SELECT k FROM reg_t ORDER BY total DESC, k LIMIT 1) || '</b> region leads revenue performance, while <b>'
        || (SELECT k FROM reg_t ORDER BY total ASC, k DESC LIMIT 1) || '</b> lags and may need targeted intervention.'
        WHERE (SELECT COUNT(*) FROM reg_t) >= 2),
r6 AS (SELECT 6, 'margin', CASE WHEN m >= 15 THEN 'good' WHEN m >= 5 THEN 'warn' ELSE 'bad' END, m,
        'Overall profit margin is <b>' || format('{{:.1f}}', m) || '%</b>.'
        FROM (SELECT COALESCE(CAST(SUM({src}_prof) AS DOUBLE) / NULLIF(CAST(SUM({src}_rev) AS DOUBLE), 0), 0) * 100 AS m FROM {src})),
mt AS (SELECT CAST(COUNT(*) AS DOUBLE) * {ncols} AS cells, CAST({missing_sum} AS DOUBLE) AS miss FROM {src}),
r8 AS (SELECT 8, 'missing_share', 'warn', miss * 100.0 / cells,
        'Dataset has <b>' || format('{{:.1f}}', miss * 100.0 / cells) || '%</b> missing values — consider cleaning before drawing firm conclusions.'
        FROM mt WHERE miss * 100.0 / cells > 5),
nv AS (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in nums)} FROM {src}),
cm AS ({_corr_sql(nums, "nv", 12)}),
best AS (SELECT a, b, r FROM cm WHERE i < j AND r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 1),
r9 AS (SELECT 9, 'strong_correlation', 'info', r,
        'Strong correlation detected between <b>' || a || '</b> and <b>' || b || '</b> (r = ' || format('{{:.2f}}', r) || ').'
        FROM best WHERE abs(r) > 0.7)"""
    rules = ["r1", "r2", "r3"]
    if date:
        t += ",\n" + MONTHS_SQL.format(src=src, metric=f"{src}_rev") + """,
mv AS (SELECT period, CAST(value AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY period DESC) AS rk FROM monthly),
ms AS (SELECT COUNT(*) AS n, MAX(CASE WHEN rk = 1 THEN v END) AS v1, MAX(CASE WHEN rk = 2 THEN v END) AS v2,
        MAX(CASE WHEN rk = 3 THEN v END) AS v3, arg_min(v, period) AS first FROM mv),
r4 AS (SELECT 4, 'momentum', CASE WHEN v3 <= v2 AND v2 <= v1 THEN 'good' ELSE 'bad' END, v1,
        CASE WHEN v3 <= v2 AND v2 <= v1 THEN 'Revenue has grown for three consecutive periods — positive momentum.'
             ELSE 'Revenue has declined for three consecutive periods — investigate demand drivers.' END
        FROM ms WHERE n >= 3 AND ((v3 <= v2 AND v2 <= v1) OR (v3 >= v2 AND v2 >= v1))),
r5 AS (SELECT 5, 'overall_change', CASE WHEN ch >= 0 THEN 'good' ELSE 'warn' END, ch,
        'Over the observed period, revenue changed by <b>' || format('{:+.1f}', ch) || '%</b> from first to last month.'
        FROM (SELECT COALESCE((v1 - first) / NULLIF(abs(first), 0), 0) * 100 AS ch, n FROM ms) WHERE n >= 3)"""
        rules += ["r4", "r5"]
    rules += ["r6"]
    if cust:
        t += f""",
cu AS (SELECT {cust} AS k, SUM({src}_rev) AS total FROM {src} WHERE {cust} IS NOT NULL GROUP BY {cust}),
r7 AS (SELECT 7, 'customer_concentration', CASE WHEN s > 60 THEN 'warn' ELSE 'info' END, s,
        'The top 10 customers account for <b>' || format('{{:.1f}}', s) || '%</b> of revenue.'
        FROM (SELECT (SELECT CAST(SUM(total) AS DOUBLE) FROM (SELECT total FROM cu ORDER BY total DESC LIMIT 10))
                     / CAST(SUM(total) AS DOUBLE) * 100 AS s, COUNT(*) AS n FROM cu) WHERE n >= 10)"""
        rules += ["r7"]
    rules += ["r8", "r9"]
    union = "\nUNION ALL ".join(f"SELECT * FROM {r}" for r in rules)
    return t + f""",
ins AS ({union}),
allins AS (SELECT * FROM ins UNION ALL SELECT 10, 'fallback', 'info', NULL,
  'Upload richer business data (revenue, dates, categories) to unlock tailored insights.' WHERE (SELECT COUNT(*) FROM ins) = 0)"""


SALES_SRC = """s AS (SELECT *, Revenue AS s_rev, Profit AS s_prof FROM sales_view)"""
SALES_RULES = X.with_views(X.SALES, SALES_SRC) + ", " + _rule_ctes(
    "s", "Category", "Region", "Date", "CustomerID", SALES_NUM, "0", 14)
DIRTY_SRC = """d AS (SELECT *, Revenue AS d_rev, Profit AS d_prof FROM dirty_view)"""
DIRTY_NUM = ["OrderID", "LineNo", "PartID", "SuppID", "Profit", "Revenue", "Empty", "Flat"]
DIRTY_MISSING = " + ".join(f"COUNT(*) - COUNT({c})" for c in
                           ["OrderID", "LineNo", "PartID", "SuppID", "Region", "Category", "Profit", "Revenue", "Empty", "Flat"])
DIRTY_RULES = X.with_views(X.SALES, X.DIRTY, DIRTY_SRC) + ", " + _rule_ctes(
    "d", "Category", "Region", None, None, DIRTY_NUM, DIRTY_MISSING, 10)
OUT = """SELECT CAST(position AS BIGINT) AS position, rule, kind, ROUND(CAST(value AS DOUBLE), 6) AS value, text FROM allins"""


def _ins(df):
    return finalize(I.insights(df), 6)


@register("j11_insights_sales", SALES_RULES + OUT)
def j11s(spark, sf):
    return _ins(V.sales_view(spark, sf))


@register("j11_insights_dirty", DIRTY_RULES + OUT)
def j11d(spark, sf):
    return _ins(V.dirty_view(spark, sf))


# Each rule as its own query, over the columns it reads. A rule function gives the one or two lines of its kind.
RULES = (
    (1, "j1_category_leader", I.category_leader, ["Category", "Revenue"]),
    (2, "j2_concentration_warning", I.category_leader, ["Category", "Revenue"]),
    (3, "j3_region_spread", I.region_spread, ["Region", "Revenue"]),
    (4, "j4_momentum", I.growth, ["Date", "Revenue"]),
    (5, "j5_overall_change", I.growth, ["Date", "Revenue"]),
    (6, "j6_margin_tone", I.margin, ["Profit", "Revenue"]),
    (7, "j7_customer_concentration", I.customer_concentration, ["CustomerID", "Revenue"]),
)
for _pos, _name, _rule, _cols in RULES:
    def _make(pos, rule, cols):
        def fn(spark, sf):
            return finalize(rule(V.sales_lines(spark, sf, cols), *cols), 6).where(F.col("position") == pos)
        return fn
    register(_name, SALES_RULES + OUT + f" WHERE position = {_pos}")(_make(_pos, _rule, _cols))


@register("j9_strong_correlation", SALES_RULES + OUT + " WHERE position = 9")
def j9(spark, sf):
    return finalize(I.strong_correlation(V.sales_lines(spark, sf, SALES_NUM), SALES_NUM), 6)


@register("j8_missing_share", DIRTY_RULES + OUT + " WHERE position = 8")
def j8(spark, sf):
    return finalize(I.missing_share(V.dirty_view(spark, sf)), 6)


@register("j10_fallback", """WITH t AS (SELECT * FROM region)
SELECT CAST(10 AS BIGINT) AS position, 'fallback' AS rule, 'info' AS kind, CAST(NULL AS DOUBLE) AS value,
  'Upload richer business data (revenue, dates, categories) to unlock tailored insights.' AS text""")
def j10(spark, sf):
    from ..sources.tables import table
    # region (r_regionkey, r_name) binds no rule: only the fallback line fires
    return finalize(I.insights(table(spark, sf, "region")), 6)


REC_SQL = """, recs AS (SELECT position, CASE WHEN kind = 'bad' THEN 'Prioritise corrective action: ' ELSE 'Monitor closely: ' END
   || regexp_replace(text, '<[^>]+>', '', 'g') AS recommendation FROM allins WHERE kind IN ('bad', 'warn'))
SELECT CAST(position AS BIGINT) AS position, recommendation FROM recs
UNION ALL SELECT 90, 'Maintain current strategy; metrics are within healthy ranges.' WHERE (SELECT COUNT(*) FROM recs) = 0
UNION ALL SELECT 99, 'Schedule a recurring review to track these KPIs over time.'"""


@register("j12_recommendations", DIRTY_RULES + REC_SQL)
def j12(spark, sf):
    return finalize(I.recommendations(I.insights(V.dirty_view(spark, sf))))


@register("j12_recommendations_sales", SALES_RULES + REC_SQL)
def j12s(spark, sf):
    return finalize(I.recommendations(I.insights(V.sales_view(spark, sf))))


@register("j13_report_overview", X.with_views(X.SALES, X.DIRTY) + """, o AS (SELECT COUNT(*) AS r,
  """ + DIRTY_MISSING + """ AS m, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_view)) AS d FROM dirty_view)
SELECT CAST(1 AS BIGINT) AS position, 'Rows' AS label, r AS value, format('{:,d}', r) AS display FROM o
UNION ALL SELECT 2, 'Columns', 10, '10' FROM o
UNION ALL SELECT 3, 'Numeric columns', 8, '8' FROM o
UNION ALL SELECT 4, 'Categorical columns', 2, '2' FROM o
UNION ALL SELECT 5, 'Missing values', m, format('{:,d}', m) FROM o
UNION ALL SELECT 6, 'Duplicate rows', d, format('{:,d}', d) FROM o""")
def j13(spark, sf):
    return finalize(I.report_overview(V.dirty_view(spark, sf)))
