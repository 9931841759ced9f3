"""Dashboard aggregates: KPI table, monthly trend, top categories, regional shares."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import q
from ..functions.aggs import one_row, rows_of
from ..functions.scalars import coerce_numeric, fixed, format_number, safe_div
from ..functions.schema import default_metric, detect_semantic_column, is_numeric_type, numeric_columns
from .periods import resample_sum


def metric_col(df: DataFrame, c: str):
    """The coerced numeric form of a metric column (C1 unless already numeric)."""
    return coerce_numeric(F.col(q(c)), is_numeric_type(df.schema[c].dataType))


def monthly_trend(df: DataFrame, date: str | None = None, metric: str | None = None, keys=(), whole_range: bool = False) -> DataFrame:
    """F8: month-end sums with gap months filled with 0: (keys..., period, value).

    ``whole_range``: months whose metric never parses still count (the KPI's last month).
    """
    date = date or detect_semantic_column(df, "date")
    metric = metric or default_metric(df)
    return resample_sum(df, date, metric, "M", keys=keys, whole_range=whole_range)


def mom_growth(monthly: DataFrame, keys=()) -> DataFrame:
    """growth % of the last month over the previous one (when >= 2 months, previous != 0).

    Runs on the aggregated month table; the window is per series.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    last2 = monthly.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= 2)
    agg = last2.groupBy(*keys).agg(F.max(F.when(F.col("_rk") == 1, F.col("value"))).alias("last"),
                                   F.max(F.when(F.col("_rk") == 2, F.col("value"))).alias("previous"))
    g = (F.col("last") - F.col("previous")).cast("double") / F.abs(F.col("previous").cast("double")) * 100
    out = agg.where(F.col("previous").isNotNull() & (F.col("previous") != 0))
    return out.select(*keys, F.col("last").cast("double").alias("last"),
                      F.col("previous").cast("double").alias("previous"), g.alias("growth_pct"),
                      F.when(g >= 0, "up").otherwise("down").alias("direction"))


def kpi_table(df: DataFrame, revenue=None, profit=None, sales=None, customer=None, date=None) -> DataFrame:
    """Labelled KPI rows (label, value, display, delta, direction) from one aggregate.

    Columns are bound by the semantic rule unless given. When nothing binds,
    the sums of the first four numeric columns are reported (F7).
    """
    revenue = revenue or detect_semantic_column(df, "revenue")
    profit = profit or detect_semantic_column(df, "profit")
    sales = sales or detect_semantic_column(df, "sales")
    customer = customer or detect_semantic_column(df, "customer")
    date = date or detect_semantic_column(df, "date")
    aggs, rows = [], []
    if revenue:
        aggs.append(F.coalesce(F.sum(metric_col(df, revenue)).cast("double"), F.lit(0.0)).alias("rev"))
    if profit:
        aggs.append(F.coalesce(F.sum(metric_col(df, profit)).cast("double"), F.lit(0.0)).alias("prof"))
    if sales and sales != revenue:
        aggs.append(F.coalesce(F.sum(metric_col(df, sales)).cast("double"), F.lit(0.0)).alias("units"))
    if customer:
        aggs.append(F.count_distinct(F.col(q(customer))).cast("double").alias("cust"))
    fallback = not aggs
    if fallback:
        for i, c in enumerate(numeric_columns(df)[:4]):
            aggs.append(F.coalesce(F.sum(F.col(q(c))).cast("double"), F.lit(0.0)).alias(f"f{i}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "position int, label string, value double, display string, delta string, direction string")
    one = df.agg(*aggs)
    none = F.lit(None).cast("string")

    def row(pos, label, value, display, delta=none, direction=none):
        return [F.lit(pos), F.lit(label), value.cast("double"), display, delta, direction]
    if revenue:
        rows.append(row(1, "Total Revenue", F.col("rev"), F.concat(F.lit("$"), format_number(F.col("rev")))))
    if profit:
        rows.append(row(2, "Total Profit", F.col("prof"), F.concat(F.lit("$"), format_number(F.col("prof")))))
        if revenue:
            m = safe_div(F.col("prof"), F.col("rev")) * 100
            rows.append(row(3, "Profit Margin", m, fixed(m, 1, thousands=False, suffix="%")))
    if sales and sales != revenue:
        rows.append(row(4, "Total Units", F.col("units"), format_number(F.col("units"))))
    if customer:
        rows.append(row(5, "Customers", F.col("cust"), F.format_string("%,d", F.col("cust").cast("bigint"))))
    if fallback:
        for i, c in enumerate(numeric_columns(df)[:4]):
            rows.append(row(10 + i, f"Σ {c}", F.col(f"f{i}"), format_number(F.col(f"f{i}"))))
    out = rows_of(one, rows, ["position", "label", "value", "display", "delta", "direction"])
    if revenue and date:
        g = mom_growth(monthly_trend(df, date, revenue, whole_range=True))
        txt = fixed(F.col("growth_pct"), 1, thousands=False, suffix="%")
        out = out.unionByName(g.select(F.lit(6).alias("position"), F.lit("MoM Growth").alias("label"),
                                       F.col("growth_pct").alias("value"), txt.alias("display"),
                                       txt.alias("delta"), F.col("direction")))
    return out


def fallback_sums(df: DataFrame, k: int = 4) -> DataFrame:
    """(column, total) for the first k numeric columns, one aggregate."""
    cols = numeric_columns(df)[:k]
    one = df.agg(*[F.coalesce(F.sum(F.col(q(c))), F.lit(0)).cast("double").alias(f"s{i}") for i, c in enumerate(cols)])
    return rows_of(one, [[F.lit(i), F.lit(c), F.col(f"s{i}")] for i, c in enumerate(cols)],
                   ["position", "column", "total"])


def group_totals(df: DataFrame, group: str, metric: str, out_col: str = "total") -> DataFrame:
    """(group, total): sum of the coerced metric per non-NULL group."""
    m = metric_col(df, metric)
    return (df.where(F.col(q(group)).isNotNull())
            .groupBy(F.col(q(group)).alias(group))
            .agg(F.coalesce(F.sum(m), F.lit(0)).alias(out_col)))


def top_categories(df: DataFrame, category: str, metric: str, n: int = 10, ascending: bool = False,
                   out_col: str = "total") -> DataFrame:
    """the n largest groups by metric sum (ties by group value), with rank.

    Partial aggregation runs before the shuffle; the sort is a top-k
    (TakeOrderedAndProject), never a full sort.
    """
    if n <= 0:
        return group_totals(df, category, metric, out_col).limit(0).withColumn("rank", F.lit(0))
    t = group_totals(df, category, metric, out_col)
    order = F.col(out_col).asc() if ascending else F.col(out_col).desc()
    top = t.orderBy(order, F.col(q(category)).asc()).limit(n)
    w = Window.orderBy(order, F.col(q(category)).asc())  # over at most n rows
    return top.withColumn("rank", F.row_number().over(w))


def leader_share(top: DataFrame, category: str, out_col: str = "total") -> DataFrame:
    """the leader and its share (%) of the top-n total (not of the grand total)."""
    return top.agg(F.max_by(F.col(q(category)), -F.col("rank")).alias(category),
                   F.max_by(F.col(out_col), -F.col("rank")).cast("double").alias(out_col),
                   (safe_div(F.max_by(F.col(out_col), -F.col("rank")).cast("double"),
                             F.sum(out_col).cast("double")) * 100).alias("share_pct"))


def regional_totals(df: DataFrame, region: str | None = None, metric: str | None = None,
                    out_col: str = "total") -> DataFrame:
    """F11 + F12: every region's total, descending, with its share of the grand total (%)."""
    region = region or detect_semantic_column(df, "region")
    metric = metric or default_metric(df)
    t = group_totals(df, region, metric, out_col)
    grand = one_row(t.agg(F.sum(F.col(out_col).cast("double")).alias("g")))["g"]
    return t.select(F.col(q(region)), F.col(out_col), (safe_div(F.col(out_col).cast("double"), grand) * 100).alias("share_pct"))
