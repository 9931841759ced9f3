"""Model metrics as DataFrame aggregates over (actual, predicted[, score]) tables.

Classification metrics come from the confusion counts, one shuffle of
(actual, predicted) pairs with map-side partial counts. ROC/AUC use the
range-partitioned running sums of ranking.py over distinct scores, so no task ever
holds all scores.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import one_row, rows_of
from ..functions.ranking import cumulative, with_next
from ..functions.scalars import round_scaled
from ..session import stored


MAX_MATRIX_CLASSES = 1000


def _pairs(df, actual, predicted):
    return df.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")) \
        .where(F.col("a").isNotNull() & F.col("p").isNotNull())


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(a, p, n) for every observed pair."""
    return _pairs(df, actual, predicted).groupBy("a", "p").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts over the sorted labels of ``actual`` x the same labels, zeros included.

    A matrix is for reading, so more than MAX_MATRIX_CLASSES classes are an error
    (:func:`confusion_counts` has the observed pairs of any number).
    """
    counts = confusion_counts(df, actual, predicted)
    labels = counts.agg(F.sort_array(F.collect_set("a")).alias("l"))  # one entry per class
    many = F.assert_true(F.size("l") <= MAX_MATRIX_CLASSES, F.lit("too many classes for a matrix"))
    labels = labels.select(F.when(many.isNull(), F.col("l")).alias("l"))
    grid = labels.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("p"))
    return (grid.join(counts, ["a", "p"], "left")
            .select(F.col("a").alias("actual"), F.col("p").alias("predicted"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, tp, predicted_n, support, precision, recall, f1) over labels seen on either side."""
    c = confusion_counts(df, actual, predicted)
    by_a = c.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"),
                                                    F.sum(F.when(F.col("a") == F.col("p"), F.col("n"))).alias("tp"))
    by_p = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted_n"))
    t = by_a.join(by_p, "label", "full").select(
        "label", *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(x) for x in ("tp", "predicted_n", "support")])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (zero division -> 0), one row."""
    pc = per_class(df, actual, predicted)
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def classification_report(df: DataFrame, actual: str, predicted: str, decimals: int = 3) -> DataFrame:
    """Per-label precision/recall/F1/support plus accuracy, macro and weighted rows."""
    pc = per_class(df, actual, predicted)
    labels = pc.select(F.col("label").alias("row"), "precision", "recall", "f1", "support", F.lit(0).alias("_o"))
    tot = pc.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"),
                 F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = F.col("tp") / F.col("s")
    summary = rows_of(tot, [[F.lit("accuracy"), acc, acc, acc, F.col("s"), F.lit(1)],
                            [F.lit("macro avg"), F.col("mp"), F.col("mr"), F.col("mf"), F.col("s"), F.lit(2)],
                            [F.lit("weighted avg"), F.col("wp"), F.col("wr"), F.col("wf"), F.col("s"), F.lit(3)]],
                      ["row", "precision", "recall", "f1", "support", "_o"])
    out = labels.unionByName(summary)
    return out.select("row", *[round_scaled(c, decimals).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R², MAE, RMSE in one aggregate."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    d = df.select(y.alias("y"), p.alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.col("y") - F.col("p")
    one = d.agg(F.sum(e * e).alias("ss_res"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss_tot"),
                F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    r2 = F.when(F.col("ss_tot") == 0, F.lit(None).cast("double")).otherwise(1 - F.col("ss_res") / F.col("ss_tot"))
    return one.select(r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"))


def _score_table(df, label, score):
    """Distinct scores with positive/negative counts; positive = the larger label.

    The source is scanned once: its (score, label) counts are written, and both the
    label and the table come from them.
    """
    d = df.select(F.col(label).alias("y"), F.col(score).cast("double").alias("s")).where(
        F.col("y").isNotNull() & F.col("s").isNotNull())
    counts = stored(d.groupBy("s", "y").agg(F.count(F.lit(1)).alias("n")), "scores")
    pos_label = one_row(counts.agg(F.max("y").alias("m")))["m"]
    positive = F.col("y") == pos_label
    return (counts.groupBy("s").agg(F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
                                    F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"))
            .withColumn("neg_s", -F.col("s")))


def roc_points(df: DataFrame, label: str, score: str, drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, descending, starting at (0, 0).

    With ``drop_intermediate`` a point goes when the step that leads to it and the step after it add the same
    counts, as plotting libraries drop points inside a straight run; the highest and the lowest score stay.
    """
    st = _score_table(df, label, score)
    if drop_intermediate:
        st = with_next(st, ["neg_s"], ["pos", "neg"])
    st = cumulative(st, [], ["neg_s"], ["pos", "neg"])
    if drop_intermediate:
        same = (F.col("next.pos") == F.col("pos")) & (F.col("next.neg") == F.col("neg"))
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        st = st.where(first | F.coalesce(~same, F.lit(True)))
    pts = st.select(F.col("s").alias("threshold"),
                    (F.col("cum_neg") / F.col("total_neg")).alias("fpr"),
                    (F.col("cum_pos") / F.col("total_pos")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half (equals the trapezoid rule)."""
    st = cumulative(_score_table(df, label, score), [], ["neg_s"], ["pos", "neg"])
    above = F.col("cum_pos") - F.col("pos")  # positives with a strictly higher score
    return st.agg((F.sum(F.col("neg") * (above + F.col("pos") / 2.0)) /
                   (F.max("total_pos") * F.max("total_neg"))).alias("auc"))


def predicted_vs_actual(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The pairs with the diagonal's range (min and max of actual) attached."""
    d = df.select(F.col(actual).cast("double").alias("actual"), F.col(predicted).cast("double").alias("predicted"))
    b = one_row(d.agg(F.min("actual").alias("lo"), F.max("actual").alias("hi")))
    return d.select("actual", "predicted", b["lo"].alias("diag_lo"), b["hi"].alias("diag_hi"))
