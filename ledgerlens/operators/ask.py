"""Question-driven analyses: the seven intents as operators, and bulk intent tagging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._cols import q
from ..functions.aggs import is_missing, one_row
from ..functions.ranking import quantiles
from ..functions.scalars import contains_any, first_int
from ..functions.schema import (categorical_columns, default_metric, detect_semantic_column,
                                is_datetime_type, numeric_columns)
from .kpi import metric_col, monthly_trend, top_categories
from .stats import correlation_long

# Intent keyword lists, tried in this order.
INTENTS = (
    ("top", ("top", "highest", "best", "most", "largest")),
    ("bottom", ("lowest", "worst", "least", "bottom")),
    ("trend", ("trend", "over time", "growth", "forecast", "monthly")),
    ("anomaly", ("anomal", "outlier", "unusual", "abnormal")),
    ("correlation", ("correlat", "relationship")),
    ("count", ("how many", "count", "number of", "total rows")),
    ("aggregate", ("average", "mean", "sum", "total")),
)
AVERAGE_WORDS = ("average", "mean")


def top_n(df: DataFrame, group: str, metric: str, n: int = 10) -> DataFrame:
    """G1: n groups with the largest metric sum (n = 0 gives no rows)."""
    return top_categories(df, group, metric, n, out_col=metric)


def bottom_n(df: DataFrame, group: str, metric: str, n: int = 10) -> DataFrame:
    """N groups with the smallest metric sum."""
    return top_categories(df, group, metric, n, ascending=True, out_col=metric)


def trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Month table plus direction (increasing when last >= first)."""
    m = monthly_trend(df, date, metric)
    ends = m.agg(F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"))
    e = one_row(ends)
    return m.select("period", F.col("value").alias(metric),
                    F.when(e["last"] >= e["first"], "increasing").otherwise("decreasing").alias("direction"))


def anomalies(df: DataFrame, metric: str, limit: int = 20, order_by=None) -> DataFrame:
    """Rows whose metric lies outside the 1.5 IQR fence, the first ``limit`` by key.

    Adds lower, upper and n_anomalies (the total count, before the limit).
    """
    m = metric_col(df, metric)
    src = df.withColumn("_m", m.cast("double"))
    qs = quantiles(src, ["_m"], [0.25, 0.75]).select("q0", "q1")
    b = one_row(qs.select(F.col("q0").alias("q1"), F.col("q1").alias("q3"),
                          (F.col("q0") - 1.5 * (F.col("q1") - F.col("q0"))).alias("lower"),
                          (F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("upper")))
    out = src.where((F.col("_m") < b["lower"]) | (F.col("_m") > b["upper"]))
    n = one_row(out.agg(F.count(F.lit(1)).alias("n")))["n"]
    order = list(order_by) if order_by else df.columns
    return (out.orderBy(*[F.col(q(c)).asc_nulls_first() for c in order]).limit(limit).drop("_m")
            .select("*", b["lower"].alias("lower"), b["upper"].alias("upper"), n.alias("n_anomalies")))


def correlations(df: DataFrame) -> DataFrame:
    """The rounded correlation matrix (long form)."""
    return correlation_long(df, decimals=2)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, missing values (NULL, NaN) excluded, with distinct count."""
    vc = (df.where(~is_missing(df, column)).groupBy(F.col(q(column)).alias(column))
          .agg(F.count(F.lit(1)).alias("count")))
    nu = one_row(vc.agg(F.count(F.lit(1)).alias("n_unique")))["n_unique"]
    return vc.select(F.col(q(column)), "count", nu.alias("n_unique"))


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("rows").cast("bigint"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def aggregate(df: DataFrame, metric: str, how: str = "total") -> DataFrame:
    """Average or total of a metric."""
    m = metric_col(df, metric)
    v = F.avg(m) if how == "average" else F.coalesce(F.sum(m), F.lit(0))
    return df.agg(v.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit(how).alias("agg"), "value")


def match_column_expr(text: Column, columns) -> Column:
    """First column (in the given order) whose name, raw or with '_' -> ' ', occurs in the text."""
    out = F.lit(None).cast("string")
    for c in reversed(list(columns)):
        low = c.lower()
        hit = F.contains(text, F.lit(low)) | F.contains(text, F.lit(low.replace("_", " ")))
        out = F.when(hit, F.lit(c)).otherwise(out)
    return out


def tag_questions(questions: DataFrame, question_col: str, table: DataFrame,
                  cat_cols=None, keep=()) -> DataFrame:
    """Tag a table of questions with the intent and bindings each would get on ``table``.

    Ordered rules top -> bottom -> trend -> anomaly -> correlation -> count ->
    average/total -> none; a rule whose columns cannot be bound falls through.
    Output (keep..., question, intent, n, group_col, metric_col, agg).
    """
    cat_cols = list(cat_cols) if cat_cols is not None else categorical_columns(table)
    nums = numeric_columns(table)
    revenue = default_metric(table)
    date = detect_semantic_column(table, "date")
    if date and not is_datetime_type(table.schema[date].dataType) and date in nums:
        date = None
    lit = lambda v: F.lit(v).cast("string")
    t = F.lower(F.trim(F.col(q(question_col))))
    cat_m = match_column_expr(t, cat_cols)
    num_m = match_column_expr(t, nums)
    metric = F.coalesce(num_m, lit(revenue))
    top_group = F.coalesce(cat_m, lit(detect_semantic_column(table, "customer")),
                           lit(detect_semantic_column(table, "category")), lit(cat_cols[0] if cat_cols else None))
    bottom_group = F.coalesce(cat_m, lit(cat_cols[0] if cat_cols else None))
    kw = {name: contains_any(t, words) for name, words in INTENTS}
    rules = [
        ("top", kw["top"] & top_group.isNotNull() & metric.isNotNull(), top_group, metric, lit(None)),
        ("bottom", kw["bottom"] & bottom_group.isNotNull() & metric.isNotNull(), bottom_group, metric, lit(None)),
        ("trend", kw["trend"] & F.lit(date is not None) & metric.isNotNull(), lit(date), metric, lit(None)),
        ("anomaly", kw["anomaly"] & metric.isNotNull(), lit(None), metric, lit(None)),
        ("correlation", kw["correlation"] & F.lit(len(nums) >= 2), lit(None), lit(None), lit(None)),
        ("count", kw["count"], cat_m, lit(None), lit(None)),
        ("aggregate", kw["aggregate"] & metric.isNotNull(), lit(None), metric,
         F.when(contains_any(t, AVERAGE_WORDS), "average").otherwise("total")),
    ]
    intent, group, met, agg = lit("none"), lit(None), lit(None), lit(None)
    for name, cond, g, m, a in reversed(rules):
        intent = F.when(cond, F.lit(name)).otherwise(intent)
        group = F.when(cond, g).otherwise(group)
        met = F.when(cond, m).otherwise(met)
        agg = F.when(cond, a).otherwise(agg)
    n = F.when(intent.isin("top", "bottom"), first_int(t))
    return questions.select(*[F.col(q(k)) for k in keep], F.col(q(question_col)).alias("question"),
                            intent.alias("intent"), n.alias("n"), group.alias("group_col"),
                            met.alias("metric_col"), agg.alias("agg"))
