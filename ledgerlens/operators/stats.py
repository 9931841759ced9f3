"""Exploratory statistics: correlation, histogram, skewness, box and OLS summaries."""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._cols import q
from ..functions.aggs import one_row, per_column_rows, rows_of
from ..functions.ranking import quantiles, unpivot_numeric
from ..functions.schema import numeric_columns
from ..functions.scalars import round_scaled

def _num(c):
    return F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))


def correlation_long(df: DataFrame, columns=None, decimals: int | None = 2) -> DataFrame:
    """(a, b, i, j, r) for every ordered pair including the diagonal (see :func:`correlation_pairs`)."""
    half = correlation_pairs(df, columns, decimals)
    mirror = half.where(F.col("i") != F.col("j")).select(F.col("b").alias("a"), F.col("a").alias("b"),
                                                         F.col("j").alias("i"), F.col("i").alias("j"), "r")
    return half.unionByName(mirror)


# Up to this many buffer fields one aggregate holds all pairs and stays code-generated (spark.sql.codegen.maxFields).
FIELDS_PER_AGG = 96


def correlation_pairs(df: DataFrame, columns=None, decimals: int | None = 2) -> DataFrame:
    """(a, b, i, j, r) for the pairs i <= j: pairwise-complete Pearson r, NULL for a constant side.

    Values are centred on their column's mean (a scalar subquery) so the moment
    sums stay well conditioned. One further scan gathers the sums of all pairs: in one
    aggregate's fields while these are few, else by matrix products of Arrow batches
    (:func:`_dense_sums`). The number of scans does not depend on the columns, and no row is
    copied for its pairs.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "a string, b string, i int, j int, r double")
    means = one_row(df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)]))
    # the subquery is named once, so that it is planned once
    named = df.select(*[_num(c).alias(f"x{i}") for i, c in enumerate(cols)], means.alias("m"))
    u = named.select(*[(F.col(f"x{i}") - F.col(f"m.m{i}")).alias(f"u{i}") for i in range(len(cols))])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def sums(x, y):
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        return {"n": F.count(a + b).cast("double"), "sa": F.sum(a), "sb": F.sum(b), "saa": F.sum(a * a), "sbb": F.sum(b * b), "sab": F.sum(a * b)}

    names = ["i", "j", "n", "sa", "sb", "saa", "sbb", "sab"]
    if 6 * len(pairs) <= FIELDS_PER_AGG:
        one = u.agg(*[e.alias(f"{k}{i}_{j}") for i, j in pairs for k, e in sums(F.col(f"u{i}"), F.col(f"u{j}")).items()])
        out = rows_of(one, [[F.lit(i), F.lit(j)] + [F.col(f"{k}{i}_{j}") for k in names[2:]] for i, j in pairs], names)
    else:
        out = _dense_sums(u)
    labels = F.array(*[F.lit(c) for c in cols])
    out = out.select(labels[F.col("i")].alias("a"), labels[F.col("j")].alias("b"), *names)
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    vx = n * F.col("saa") - sa * sa
    vy = n * F.col("sbb") - sb * sb
    r = F.when((vx > 0) & (vy > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (n * F.col("sab") - sa * sb) / F.sqrt(vx * vy))))
    r = F.when(F.col("i") == F.col("j"), F.when(vx > 0, F.lit(1.0))).otherwise(r)
    out = out.select("a", "b", "i", "j", r.alias("r"))
    return out if decimals is None else out.withColumn("r", round_scaled("r", decimals))


def _dense_sums(u: DataFrame) -> DataFrame:
    """(i, j, n, sa, sb, saa, sbb, sab) over the complete pairs of every two columns of doubles, i <= j.

    A task keeps one matrix per sum and adds its batches to them by matrix products; it ends
    with one row a pair, and the tasks' rows are added up by pair with partial sums before the shuffle.
    """
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    c = len(u.columns)
    first, second = np.triu_indices(c)

    def run(batches):
        total = np.zeros((len(names), c, c))
        for b in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns]).astype(np.float64)
            known = np.column_stack([~np.asarray(col.is_null(nan_is_null=True)) for col in b.columns]).astype(np.float64)
            x = np.where(known > 0, x, 0.0)
            square = x * x
            total += [known.T @ known, x.T @ known, known.T @ x, square.T @ known, known.T @ square, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *[pa.array(t[first, second]) for t in total]],
                                         names=["i", "j", *names])

    partial = u.mapInArrow(run, "i int, j int, " + ", ".join(f"{k} double" for k in names))
    return partial.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])


def strongest_pair(corr_long: DataFrame) -> DataFrame:
    """The off-diagonal pair with the largest |r| (first in column order on ties)."""
    off = corr_long.where((F.col("i") < F.col("j")) & F.col("r").isNotNull())
    return off.orderBy(F.abs("r").desc(), "i", "j").limit(1).select("a", "b", "r")


def histogram(df: DataFrame, column: str, bins: int = 40, group: str | None = None) -> DataFrame:
    """E5: equal-width bins over [min, max] (max in the last bin), empty bins included.

    A constant column gives one bin. Output (group?, bin, lo, hi, count).
    """
    bins = max(1, min(40, int(bins)))
    x = _num(column)
    stats = one_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = stats["lo"], stats["hi"]
    width = (hi - lo) / bins
    nb = F.when(hi == lo, F.lit(1)).otherwise(F.lit(bins))
    keys = [group] if group else []
    sel = df.select(*[F.col(q(k)) for k in keys], x.alias("_x"))
    cond = F.col("_x").isNotNull()
    for k in keys:
        cond = cond & F.col(q(k)).isNotNull()
    counted = (sel.where(cond).select(*[F.col(q(k)) for k in keys],
                                      F.when(hi == lo, F.lit(0)).otherwise(
                                          F.least(F.floor((F.col("_x") - lo) / (hi - lo) * bins), F.lit(bins - 1)))
                                      .cast("int").alias("bin"))
               .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    if keys:
        groups = sel.where(cond).select(*[F.col(q(k)) for k in keys]).distinct()
    else:
        groups = df.sparkSession.range(1).select()
    spine = groups.select(*[F.col(q(k)) for k in keys], F.explode(F.sequence(F.lit(0), nb - 1)).alias("bin"))
    spine = spine.where(lo.isNotNull())
    out = spine.join(counted, [*keys, "bin"], "left")
    return out.select(*[F.col(q(k)) for k in keys], "bin",
                      (lo + F.col("bin") * F.when(hi == lo, F.lit(0.0)).otherwise(width)).alias("lo"),
                      F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("hi"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def skewness(df: DataFrame, columns=None) -> DataFrame:
    """Bias-adjusted sample skewness (G1) and a label; n < 3 -> NULL, constant -> 0."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    def aggs(i, c):
        x = _num(c)
        return [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), F.stddev_pop(x).alias(f"s{i}")]

    def row(i, c):
        n, g, s = F.col(f"n{i}").cast("double"), F.col(f"g{i}"), F.col(f"s{i}")
        adj = (F.when(n < 3, F.lit(None).cast("double")).when(s == 0, F.lit(0.0))
               .otherwise(g * F.sqrt(n * (n - 1)) / (n - 2)))
        return [F.lit(c), adj]
    out = per_column_rows(df, cols, aggs, row, ["column", "skew"])
    label = F.when(F.abs("skew") < 0.5, "approximately symmetric").when(F.col("skew").isNotNull(), "skewed")
    return out.withColumn("label", label)


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the 1.5 IQR fence) and outlier count per group."""
    keys = [group] if group else []
    qs = quantiles(df, [column], [0.25, 0.5, 0.75], group_cols=keys).select(
        *keys, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    qs = qs.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
    qs = qs.withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    vals = unpivot_numeric(df, [column], keys).drop("column")
    if keys:
        vals = vals.where(F.col(q(group)).isNotNull())
        j = vals.join(qs.select(*keys, "lower_fence", "upper_fence"), keys)
    else:
        b = one_row(qs.select("lower_fence", "upper_fence"))
        j = vals.select("value", b["lower_fence"].alias("lower_fence"), b["upper_fence"].alias("upper_fence"))
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    w = j.groupBy(*keys).agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                             F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                             F.count_if(~inside).alias("outliers"))
    out = qs.join(w, keys, "left") if keys else qs.select("*", one_row(w)["whisker_low"].alias("whisker_low"),
                                                           one_row(w)["whisker_high"].alias("whisker_high"),
                                                           one_row(w)["outliers"].alias("outliers"))
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), "q1", "median", "q3", "lower_fence",
                      "upper_fence", "whisker_low", "whisker_high", F.col("outliers").cast("bigint").alias("outliers"))


def ols_by_group(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Least-squares line of y on x per colour group: slope, intercept, r2, n."""
    keys = [group] if group else []
    xs, ys = _num(x), _num(y)
    src = df
    if keys:
        src = df.where(F.col(q(group)).isNotNull())
    return src.groupBy(*[F.col(q(k)) for k in keys]).agg(
        F.regr_count(ys, xs).cast("bigint").alias("n"), F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"), F.regr_r2(ys, xs).alias("r2"))


def scatter_matrix(df: DataFrame, columns=None, max_columns: int = 5, default_columns: int = 4, group: str | None = None) -> DataFrame:
    """OLS summary and r for every pair i<j among up to 5 numeric columns (default first 4), by colour group if given."""
    cols = list(columns)[:max_columns] if columns else numeric_columns(df)[:default_columns]
    if group:
        pairs = list(combinations(range(len(cols)), 2))
        cells = F.array(*[F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), _num(cols[i]).alias("a"), _num(cols[j]).alias("b"))
                          for i, j in pairs])
        long = df.where(F.col(q(group)).isNotNull()).select(F.col(q(group)).alias(group), F.explode(cells).alias("p")).select(group, "p.*")
        return long.groupBy(group, "x", "y").agg(
            F.regr_count("b", "a").cast("bigint").alias("n"), F.regr_slope("b", "a").alias("slope"),
            F.regr_intercept("b", "a").alias("intercept"), F.regr_r2("b", "a").alias("r2"))
    aggs, names = [], []
    for k, (i, j) in enumerate(combinations(range(len(cols)), 2)):
        xs, ys = _num(cols[i]), _num(cols[j])
        aggs += [F.regr_count(ys, xs).alias(f"n{k}"), F.regr_slope(ys, xs).alias(f"s{k}"),
                 F.regr_intercept(ys, xs).alias(f"c{k}"), F.regr_r2(ys, xs).alias(f"r{k}")]
        names.append((cols[i], cols[j]))
    if not names:
        return df.sparkSession.createDataFrame([], "x string, y string, n bigint, slope double, intercept double, r2 double")
    one = df.agg(*aggs)
    rows = [[F.lit(a), F.lit(b), F.col(f"n{k}").cast("bigint"), F.col(f"s{k}"), F.col(f"c{k}"), F.col(f"r{k}")]
            for k, (a, b) in enumerate(names)]
    return rows_of(one, rows, ["x", "y", "n", "slope", "intercept", "r2"])


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """E9 density: counts on a bins x bins grid over the [min, max] box of (x, y)."""
    xs, ys = _num(x), _num(y)
    b = one_row(df.agg(F.min(xs).alias("x0"), F.max(xs).alias("x1"), F.min(ys).alias("y0"), F.max(ys).alias("y1")))

    def cell(v, lo, hi):
        return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    pts = df.select(xs.alias("_x"), ys.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return (pts.select(cell(F.col("_x"), b["x0"], b["x1"]).cast("int").alias("bx"),
                       cell(F.col("_y"), b["y0"], b["y1"]).cast("int").alias("by"))
            .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count")))
