"""Regular period series: period labels, gap-filled sums, interpolation.

Many series are handled at once through ``keys``. The per-series spine is
generated from each series' own first and last period with ``sequence`` and
looked up in the series' map of sums, so the source is read once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import as_col
from ..functions.scalars import coerce_numeric, to_datetime
from ..functions.schema import is_datetime_type, is_numeric_type

FREQS = {"M": "month", "W": "week", "D": "day",
         "Monthly": "month", "Weekly": "week", "Daily": "day"}


def period_label(d, freq: str = "M") -> Column:
    """Month -> month end; week -> the Sunday ending the week; day -> the day."""
    d = F.to_date(as_col(d))
    unit = FREQS[freq]
    if unit == "month":
        return F.last_day(d)
    if unit == "week":
        return F.next_day(F.date_sub(d, 1), "SUN")
    return d


def _spine(lo: Column, hi: Column, unit: str) -> Column:
    if unit == "month":
        months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH"))
        return F.transform(months, lambda m: F.last_day(m))
    step = F.expr("INTERVAL 7 DAYS") if unit == "week" else F.expr("INTERVAL 1 DAY")
    return F.sequence(lo, hi, step)


def _clean_pairs(df: DataFrame, date_col: str, value_col: str, keys, keep_unparsed: bool = False) -> DataFrame:
    dt = df.schema[date_col].dataType
    d = F.to_date(F.col(date_col)) if is_datetime_type(dt) else F.to_date(to_datetime(date_col))
    v = coerce_numeric(value_col, is_numeric_type(df.schema[value_col].dataType))
    t = df.select(*[F.col(k) for k in keys], d.alias("_d"), v.alias("_v"))
    cond = F.col("_d").isNotNull() & (F.lit(keep_unparsed) | F.col("_v").isNotNull())
    for k in keys:  # R1: NULL keys are dropped like a default group-by
        cond = cond & F.col(k).isNotNull()
    return t.where(cond)


def _fill(agg: DataFrame, keys, unit: str, out_col: str, period_col: str, empty) -> DataFrame:
    """Every period from a series' first to its last: one map per series (bounded by its periods), no second scan."""
    whole = agg.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(period_col, out_col))).alias("_at"),
                                   F.min(period_col).alias("_lo"), F.max(period_col).alias("_hi"))
    spine = whole.where(F.col("_lo").isNotNull()).select(*keys, "_at", F.explode(_spine(F.col("_lo"), F.col("_hi"), unit)).alias(period_col))
    return spine.select(*keys, period_col, F.coalesce(F.try_element_at("_at", F.col(period_col)), empty).alias(out_col))


def resample_sum(df: DataFrame, date_col: str, value_col: str, freq: str = "M",
                 keys=(), fill_gaps: bool = True, out_col: str = "value",
                 period_col: str = "period", empty_as_null: bool = False, whole_range: bool = False) -> DataFrame:
    """Drop missing, coerce, sum per period, fill empty periods with 0.

    ``empty_as_null`` keeps empty periods as NULL gaps (input for :func:`interpolate`).
    ``whole_range`` lets rows whose value does not parse still extend the range of periods.
    """
    keys = list(keys)
    t = _clean_pairs(df, date_col, value_col, keys, whole_range)
    agg = (t.groupBy(*keys, period_label("_d", freq).alias(period_col))
           .agg(F.sum("_v").alias(out_col)))
    if not fill_gaps:
        return agg
    zero = F.lit(None if empty_as_null else 0).cast(agg.schema[out_col].dataType)
    return _fill(agg, keys, FREQS[freq], out_col, period_col, zero)


def resample_mean(df: DataFrame, date_col: str, value_col: str, freq: str = "M", keys=(),
                  out_col: str = "value", period_col: str = "period") -> DataFrame:
    """Mean per period with empty periods left NULL (input for :func:`interpolate`)."""
    keys = list(keys)
    t = _clean_pairs(df, date_col, value_col, keys)
    agg = t.groupBy(*keys, period_label("_d", freq).alias(period_col)).agg(F.avg("_v").alias(out_col))
    return _fill(agg, keys, FREQS[freq], out_col, period_col, F.lit(None).cast(agg.schema[out_col].dataType))


def interpolate(series: DataFrame, value_col: str = "value", period_col: str = "period",
                keys=()) -> DataFrame:
    """Linear interpolation of NULL gaps between known points of each series.

    Works on already aggregated period tables (one window partition per series).
    Leading and trailing gaps stay NULL except that, like the reference library,
    trailing gaps take the last known value.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(period_col)
    idx = F.row_number().over(w)
    s = series.withColumn("_i", idx)
    known_i = F.when(F.col(value_col).isNotNull(), F.col("_i"))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("_pv", F.last(value_col, ignorenulls=True).over(back))
         .withColumn("_pi", F.last(known_i, ignorenulls=True).over(back))
         .withColumn("_nv", F.first(value_col, ignorenulls=True).over(fwd))
         .withColumn("_ni", F.first(known_i, ignorenulls=True).over(fwd)))
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    filled = (F.when(F.col(value_col).isNotNull(), F.col(value_col))
              .when(F.col("_nv").isNotNull() & F.col("_pv").isNotNull(), between)
              .otherwise(F.col("_pv")))
    return s.select(*[F.col(c) for c in series.columns if c != value_col],
                    filled.cast("double").alias(value_col))
