"""Rule-based insights, recommendations and the report overview table.

Every rule is a small aggregate over the table; the insight table is the
union of the rules that fire, in rule order, as rows (position, rule, kind,
value, text). Texts carry inline <b> tags like the analysed application.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._cols import q
from ..functions.aggs import one_row, rows_of
from ..functions.scalars import fixed, round_scaled, safe_div, strip_html
from ..functions.schema import categorical_columns, detect_semantic_column, numeric_columns
from .kpi import group_totals, metric_col, monthly_trend
from .quality import duplicate_count, missing_total
from .stats import correlation_pairs, strongest_pair

# Insight and recommendation texts of the analysed application.
T_LEADER = ("Product category <b>", "</b> contributes <b>", "%</b> of total revenue, making it the primary driver.")
T_CONCENTRATION = ("Revenue is heavily concentrated in <b>", "</b> (>50%), indicating portfolio concentration risk.")
T_REGIONS = ("The <b>", "</b> region leads revenue performance, while <b>", "</b> lags and may need targeted intervention.")
T_GROWING = "Revenue has grown for three consecutive periods — positive momentum."
T_DECLINING = "Revenue has declined for three consecutive periods — investigate demand drivers."
T_OVERALL = ("Over the observed period, revenue changed by <b>", "%</b> from first to last month.")
T_MARGIN = ("Overall profit margin is <b>", "%</b>.")
T_TOP10 = ("The top 10 customers account for <b>", "%</b> of revenue.")
T_MISSING = ("Dataset has <b>", "%</b> missing values — consider cleaning before drawing firm conclusions.")
T_CORR = ("Strong correlation detected between <b>", "</b> and <b>", "</b> (r = ", ").")
T_FALLBACK = "Upload richer business data (revenue, dates, categories) to unlock tailored insights."
REC_BAD = "Prioritise corrective action: "
REC_WARN = "Monitor closely: "
REC_NONE = "Maintain current strategy; metrics are within healthy ranges."
REC_REVIEW = "Schedule a recurring review to track these KPIs over time."

SCHEMA = "position int, rule string, kind string, value double, text string"
NAMES = ["position", "rule", "kind", "value", "text"]


def _empty(df):
    return df.sparkSession.createDataFrame([], SCHEMA)


def _rows(one, rows):
    return rows_of(one, [[F.lit(p), F.lit(r), k, v.cast("double"), t] for p, r, k, v, t in rows], NAMES)


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def category_leader(df, category, revenue):
    """J1 + J2: leading category's share of total revenue (ties: smallest key); warning above 50 %."""
    t = group_totals(df, category, revenue, "total")
    lead = F.min(F.struct((-F.col("total")).alias("neg"), F.col(q(category)).alias("k")))
    one = t.agg(F.max("total").cast("double").alias("top"), F.sum("total").cast("double").alias("all"),
                lead["k"].cast("string").alias("top_key"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    share = safe_div(F.col("top"), F.col("all")) * 100
    none = F.lit(None).cast("string")
    text = _cat(T_LEADER[0], F.col("top_key"), T_LEADER[1], fixed(share, 1, False), T_LEADER[2])
    warning = _cat(T_CONCENTRATION[0], F.col("top_key"), T_CONCENTRATION[1])
    rows = _rows(one, [(1, "category_leader", F.lit("info"), share, text),
                       (2, "category_concentration", F.when(share > 50, F.lit("warn")).otherwise(none), share, warning)])
    return rows.where("kind is not null")


def region_spread(df, region, revenue):
    """Best and worst region (ties: smallest key is best, largest key is worst)."""
    t = group_totals(df, region, revenue, "total").select(F.col(q(region)).cast("string").alias("k"), "total")
    ranked = F.struct((-F.col("total")).alias("neg"), F.col("k").alias("k"))
    one = t.agg(F.count(F.lit(1)).alias("n"), F.min(ranked)["k"].alias("best"), F.max(ranked)["k"].alias("worst"),
                round_scaled(F.max("total").cast("double"), 2).alias("best_total")).where(F.col("n") >= 2)
    return _rows(one, [(3, "region_spread", F.lit("info"), F.col("best_total"),
                        _cat(T_REGIONS[0], F.col("best"), T_REGIONS[1], F.col("worst"), T_REGIONS[2]))])


def growth(df, date, revenue):
    """J4 + J5: momentum of the last three months and change from first to last month."""
    m = monthly_trend(df, date, revenue).select("period", F.col("value").cast("double").alias("v"))
    # one row per month, so the months meet in one array
    one = m.agg(F.sort_array(F.collect_list(F.struct("period", "v"))).alias("m")).where(F.size("m") >= 3).select(
        F.element_at("m", 1)["v"].alias("first"), *[F.element_at("m", -i)["v"].alias(f"v{i}") for i in (1, 2, 3)])
    inc = (F.col("v3") <= F.col("v2")) & (F.col("v2") <= F.col("v1"))
    dec = (F.col("v3") >= F.col("v2")) & (F.col("v2") >= F.col("v1"))
    overall = safe_div(F.col("v1") - F.col("first"), F.abs(F.col("first"))) * 100
    return _rows(one, [(4, "momentum", F.when(inc, "good").when(dec, "bad"), F.col("v1"),
                        F.when(inc, T_GROWING).otherwise(T_DECLINING)),
                       (5, "overall_change", F.when(overall >= 0, "good").otherwise("warn"), overall,
                        _cat(T_OVERALL[0], fixed(overall, 1, False, sign=True), T_OVERALL[1]))]).where("kind is not null")


def margin(df, profit, revenue):
    """Overall margin with tone good >= 15, warn >= 5, else bad."""
    one = df.agg(F.coalesce(F.sum(metric_col(df, profit)), F.lit(0)).cast("double").alias("p"),
                 F.coalesce(F.sum(metric_col(df, revenue)), F.lit(0)).cast("double").alias("r"))
    m = safe_div(F.col("p"), F.col("r")) * 100
    kind = F.when(m >= 15, "good").when(m >= 5, "warn").otherwise("bad")
    return _rows(one, [(6, "margin", kind, m, _cat(T_MARGIN[0], fixed(m, 1, False), T_MARGIN[1]))])


def customer_concentration(df, customer, revenue):
    """Share of the top 10 customers when there are at least 10."""
    t = group_totals(df, customer, revenue, "total")
    top10 = t.orderBy(F.col("total").desc()).limit(10).agg(F.sum("total").cast("double").alias("s"))
    one = t.agg(F.sum("total").cast("double").alias("all"), F.count(F.lit(1)).alias("n"))
    one = one.select("*", one_row(top10)["s"].alias("s")).where(F.col("n") >= 10)
    share = safe_div(F.col("s"), F.col("all")) * 100
    return _rows(one, [(7, "customer_concentration", F.when(share > 60, "warn").otherwise("info"), share,
                        _cat(T_TOP10[0], fixed(share, 1, False), T_TOP10[1]))])


def missing_share(df):
    """Warn when more than 5 % of cells are missing."""
    one = missing_total(df).where(F.col("missing_pct") > 5)
    return _rows(one, [(8, "missing_share", F.lit("warn"), F.col("missing_pct"),
                        _cat(T_MISSING[0], fixed(F.col("missing_pct"), 1, False), T_MISSING[1]))])


def strong_correlation(df, columns=None):
    """The pair with the largest |r| (unrounded) when it exceeds 0.7."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return _empty(df)
    top = strongest_pair(correlation_pairs(df, cols, decimals=None)).where(F.abs("r") > 0.7)
    return _rows(top, [(9, "strong_correlation", F.lit("info"), F.col("r"),
                        _cat(T_CORR[0], F.col("a"), T_CORR[1], F.col("b"), T_CORR[2], fixed(F.col("r"), 2, False), T_CORR[3]))])


def insights(df, revenue=None, profit=None, category=None, region=None, date=None, customer=None) -> DataFrame:
    """J11 (with J10): every rule that fires, in rule order.

    Each rule is an aggregate over the two columns it needs; the table itself is
    never written. At most ten short rows remain, gathered once to see whether any rule fired.
    """
    bound = {c: given or detect_semantic_column(df, c) for c, given in
             (("revenue", revenue), ("profit", profit), ("category", category), ("region", region), ("date", date), ("customer", customer))}
    parts = []
    if bound["revenue"]:
        for concept, rule in (("category", category_leader), ("region", region_spread), ("date", growth),
                              ("profit", margin), ("customer", customer_concentration)):
            if bound[concept]:
                parts.append(rule(df, bound[concept], bound["revenue"]))
    parts += [missing_share(df), strong_correlation(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fired = out.agg(F.collect_list(F.struct(*NAMES)).alias("fired"))
    fallback = F.array(F.struct(F.lit(10).alias("position"), F.lit("fallback").alias("rule"), F.lit("info").alias("kind"),
                                F.lit(None).cast("double").alias("value"), F.lit(T_FALLBACK).alias("text")))
    return fired.select(F.explode(F.when(F.size("fired") == 0, fallback).otherwise(F.col("fired"))).alias("i")).select("i.*")


def recommendations(ins: DataFrame) -> DataFrame:
    """One line per bad/warn insight (text without tags), else a keep-strategy line; always a review line."""
    recs = ins.where(F.col("kind").isin("bad", "warn")).select(
        F.col("position"),
        F.concat(F.when(F.col("kind") == "bad", REC_BAD).otherwise(REC_WARN), strip_html(F.col("text"))).alias("recommendation"))
    n = one_row(recs.agg(F.count(F.lit(1)).alias("n")))["n"]
    spark = ins.sparkSession
    keep = spark.range(1).select(F.lit(90).alias("position"), F.lit(REC_NONE).alias("recommendation")).where(n == 0)
    review = spark.range(1).select(F.lit(99).alias("position"), F.lit(REC_REVIEW).alias("recommendation"))
    return recs.unionByName(keep).unionByName(review)


def report_overview(df: DataFrame) -> DataFrame:
    """The six label/value rows of the report's overview."""
    cats = len(categorical_columns(df))
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    rows = [(1, "Rows", F.col("rows")), (2, "Columns", F.lit(len(df.columns))),
            (3, "Numeric columns", F.lit(len(numeric_columns(df)))), (4, "Categorical columns", F.lit(cats)),
            (5, "Missing values", one_row(missing_total(df))["missing_total"]),
            (6, "Duplicate rows", one_row(duplicate_count(df))["duplicates"])]
    return rows_of(one, [[F.lit(p), F.lit(label), v.cast("bigint"),
                          F.format_string("%,d", v.cast("bigint"))] for p, label, v in rows],
                   ["position", "label", "value", "display"])
