"""Registered queries: problem type, split, folds and model metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import modelprep as MP
from ..sources import views as V
from ..sources.tables import table
from . import fixtures_sql as X
from .registry import finalize, register

PRED = X.with_views(X.PREDICTIONS)
PER_CLASS = """, c AS (SELECT actual AS a, predicted AS p, COUNT(*) AS n FROM preds GROUP BY 1, 2),
sa AS (SELECT a AS label, SUM(n) AS support, SUM(CASE WHEN a = p THEN n END) AS tp FROM c GROUP BY a),
sp AS (SELECT p AS label, SUM(n) AS pn FROM c GROUP BY p),
pc AS (SELECT COALESCE(sa.label, sp.label) AS label, CAST(COALESCE(tp, 0) AS DOUBLE) AS tp,
        CAST(COALESCE(pn, 0) AS DOUBLE) AS pn, CAST(COALESCE(support, 0) AS DOUBLE) AS support
       FROM sa FULL JOIN sp ON sa.label = sp.label),
m AS (SELECT *, COALESCE(tp / NULLIF(pn, 0), 0) AS prec, COALESCE(tp / NULLIF(support, 0), 0) AS rec FROM pc),
m2 AS (SELECT *, COALESCE(2 * prec * rec / NULLIF(prec + rec, 0), 0) AS f1 FROM m)"""


@register("h1_problem_type", """
SELECT 'l_returnflag' AS "column", COUNT(DISTINCT l_returnflag) AS n_unique, CAST(NULL AS BOOLEAN) AS all_integer,
       'classification' AS problem FROM lineitem
UNION ALL """ + "\nUNION ALL ".join(
    f"""SELECT '{c}', COUNT(DISTINCT {c}), bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE))),
        CASE WHEN COUNT(DISTINCT {c}) <= 10 AND bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE)))
             THEN 'classification' ELSE 'regression' END FROM lineitem"""
    for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")))
def h1(spark, sf):
    return MP.problem_type(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_tax"])


@register("h2_complete_cases", X.with_views(X.SALES, X.DIRTY) + """
SELECT Region, Profit, Revenue, Category FROM dirty_view
WHERE Region IS NOT NULL AND Profit IS NOT NULL AND Revenue IS NOT NULL AND Category IS NOT NULL""")
def h2(spark, sf):
    return MP.complete_cases(V.dirty_view(spark, sf), ["Region", "Profit", "Revenue"], "Category")


SPLIT_SRC = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem"


def _split_src(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "l_quantity", "l_returnflag")


@register("h3_split_sizes", f"""WITH n AS (SELECT l_returnflag, COUNT(*) AS n FROM ({SPLIT_SRC}) GROUP BY 1)
SELECT l_returnflag, 'test' AS split, CAST(ceil(n * 0.2) AS BIGINT) AS n FROM n
UNION ALL SELECT l_returnflag, 'train', CAST(n - ceil(n * 0.2) AS BIGINT) FROM n""")
def h3(spark, sf):
    s = MP.stratified_split(_split_src(spark, sf), "l_returnflag", 0.2)
    return s.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


@register("h3_train_test_split")
def h3_rows(spark, sf):
    return MP.stratified_split(_split_src(spark, sf), "l_returnflag", 0.2)


@register("h13_fold_sizes", f"""WITH n AS (SELECT l_returnflag, COUNT(*) AS n FROM ({SPLIT_SRC}) GROUP BY 1),
f AS (SELECT unnest(range(0, 5)) AS fold)
SELECT l_returnflag, CAST(fold AS BIGINT) AS fold, CAST(floor((n - 1 - fold) / 5) + 1 AS BIGINT) AS n FROM n, f WHERE fold < n""")
def h13(spark, sf):
    s = MP.fold_assignment(_split_src(spark, sf), "l_returnflag", 5)
    return finalize(s.groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n")))


@register("h11_classification_metrics", PRED + PER_CLASS + """
SELECT ROUND(SUM(tp) / SUM(support), 6) AS accuracy, ROUND(SUM(prec * support) / SUM(support), 6) AS precision,
       ROUND(SUM(rec * support) / SUM(support), 6) AS recall, ROUND(SUM(f1 * support) / SUM(support), 6) AS f1 FROM m2""")
def h11(spark, sf):
    return finalize(M.classification_metrics(V.predictions_view(spark, sf), "actual", "predicted"), 6)


@register("h15_confusion_matrix", PRED + """, l AS (SELECT DISTINCT actual AS label FROM preds),
c AS (SELECT actual, predicted, COUNT(*) AS n FROM preds GROUP BY 1, 2)
SELECT a.label AS actual, b.label AS predicted, COALESCE(c.n, 0) AS count
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.label AND c.predicted = b.label""")
def h15(spark, sf):
    return M.confusion_matrix(V.predictions_view(spark, sf), "actual", "predicted")


@register("h16_classification_report", PRED + PER_CLASS + """
SELECT label AS "row", ROUND(prec, 3) AS precision, ROUND(rec, 3) AS recall, ROUND(f1, 3) AS f1,
       CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 3), ROUND(SUM(tp) / SUM(support), 3),
       ROUND(SUM(tp) / SUM(support), 3), CAST(SUM(support) AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', ROUND(AVG(prec), 3), ROUND(AVG(rec), 3), ROUND(AVG(f1), 3), CAST(SUM(support) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', ROUND(SUM(prec * support) / SUM(support), 3), ROUND(SUM(rec * support) / SUM(support), 3),
       ROUND(SUM(f1 * support) / SUM(support), 3), CAST(SUM(support) AS BIGINT) FROM m2""")
def h16(spark, sf):
    return M.classification_report(V.predictions_view(spark, sf), "actual", "predicted")


REG = X.with_views(X.REGRESSION)


@register("h12_regression_metrics", REG + """
SELECT ROUND(1 - SUM((actual - predicted) * (actual - predicted)) / (var_pop(actual) * COUNT(*)), 6) AS r2,
       ROUND(AVG(abs(actual - predicted)), 6) AS mae,
       ROUND(sqrt(AVG((actual - predicted) * (actual - predicted))), 6) AS rmse FROM pairs""")
def h12(spark, sf):
    return finalize(M.regression_metrics(V.regression_view(spark, sf), "actual", "predicted"), 6)


@register("h19_predicted_vs_actual", REG + """
SELECT actual, predicted, (SELECT MIN(actual) FROM pairs) AS diag_lo, (SELECT MAX(actual) FROM pairs) AS diag_hi FROM pairs""")
def h19(spark, sf):
    return M.predicted_vs_actual(V.regression_view(spark, sf), "actual", "predicted")


SCORE_TABLE = X.with_views(X.SCORES) + """, st AS (SELECT score AS s, COUNT(*) FILTER (WHERE label = (SELECT MAX(label) FROM scores)) AS pos,
    COUNT(*) FILTER (WHERE label <> (SELECT MAX(label) FROM scores)) AS neg FROM scores GROUP BY score),
cum AS (SELECT s, pos, neg, SUM(pos) OVER (ORDER BY s DESC) AS cp, SUM(neg) OVER (ORDER BY s DESC) AS cn,
        SUM(pos) OVER () AS tp, SUM(neg) OVER () AS tn FROM st)"""


@register("h17_roc_points", SCORE_TABLE + """
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT ROUND(s, 6), ROUND(cn / tn, 6), ROUND(cp / tp, 6) FROM cum""")
def h17(spark, sf):
    return finalize(M.roc_points(V.scores_view(spark, sf), "label", "score"), 6)


@register("h17_roc_corners", SCORE_TABLE + """, steps AS (SELECT *, LEAD(pos) OVER o AS next_pos, LEAD(neg) OVER o AS next_neg,
  ROW_NUMBER() OVER o AS i FROM cum WINDOW o AS (ORDER BY s DESC))
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT ROUND(s, 6), ROUND(cn / tn, 6), ROUND(cp / tp, 6) FROM steps
WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""")
def h17c(spark, sf):
    """Points inside a run of equal steps are dropped."""
    return finalize(M.roc_points(V.scores_view(spark, sf), "label", "score", drop_intermediate=True), 6)


@register("h18_roc_auc", SCORE_TABLE + """
SELECT ROUND(SUM(neg * ((cp - pos) + pos / 2.0)) / (MAX(tp) * MAX(tn)), 6) AS auc FROM cum""")
def h18(spark, sf):
    return finalize(M.roc_auc(V.scores_view(spark, sf), "label", "score"), 6)
