"""Registered queries: reading and typing (A1, A5)."""
from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import tables as TB
from .registry import finalize, register


def _tag(sf):
    return hashlib.sha1(sf.encode()).hexdigest()[:10]


@register("a1_read_csv", "SELECT * FROM customer")
def a1(spark, sf):
    """Customer table written as CSV (derived data), read back with header and inferred types."""
    path = scratch_path(spark, f"a1_customer_{_tag(sf)}.csv")
    TB.table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    df = TB.read_csv(spark, path)
    return finalize(df)


@register("a5_date_coercion", """WITH d AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_orderdate AS VARCHAR) END AS order_date,
  CAST(o_orderdate AS VARCHAR) AS ship_date, o_orderstatus AS status FROM orders)
SELECT 'order_date' AS "column", COUNT(order_date) AS non_null, COUNT(TRY_CAST(order_date AS TIMESTAMP)) AS parsed,
  COUNT(order_date) = COUNT(TRY_CAST(order_date AS TIMESTAMP)) AS convert FROM d
UNION ALL SELECT 'ship_date', COUNT(ship_date), COUNT(TRY_CAST(ship_date AS TIMESTAMP)),
  COUNT(ship_date) = COUNT(TRY_CAST(ship_date AS TIMESTAMP)) FROM d""")
def a5(spark, sf):
    o = TB.table(spark, sf, "orders")
    d = o.select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad")).otherwise(F.col("o_orderdate").cast("string")).alias("order_date"),
                 F.col("o_orderdate").cast("string").alias("ship_date"), F.col("o_orderstatus").alias("status"))
    return TB.date_coercion_table(d)


@register("a5_coerced_table", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_orderdate AS VARCHAR) END AS order_date,
  o_orderdate AS ship_date, o_orderstatus AS status FROM orders""")
def a5t(spark, sf):
    o = TB.table(spark, sf, "orders")
    d = o.select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad")).otherwise(F.col("o_orderdate").cast("string")).alias("order_date"),
                 F.col("o_orderdate").cast("string").alias("ship_date"), F.col("o_orderstatus").alias("status"))
    return TB.coerce_date_columns(d)


# Text dates of several formats made from the order date: (column, Spark pattern, DuckDB pattern); the last one mixes two.
TEXT_DATES = [("iso_date", "yyyy-MM-dd", "%Y-%m-%d"), ("us_date", "MM/dd/yyyy", "%m/%d/%Y"), ("eu_date", "dd/MM/yyyy", "%d/%m/%Y"),
              ("eu_time", "d/M/yyyy H:mm", "%-d/%-m/%Y %-H:%M"), ("dot_date", "dd.MM.yyyy", "%d.%m.%Y"), ("name_date", "d MMM yyyy", "%-d %b %Y"),
              ("compact_date", "yyyyMMdd", "%Y%m%d")]
_TRIED = [("M/d/yyyy", "%m/%d/%Y"), ("d/M/yyyy", "%d/%m/%Y"), ("d/M/yyyy H:mm", "%d/%m/%Y %H:%M"), ("d.M.yyyy", "%d.%m.%Y"), ("d MMM yyyy", "%d %b %Y"),
          ("yyyyMMdd", "%Y%m%d")]
_TEXTS_SQL = ("SELECT " + ", ".join(f"strftime(CAST(o_orderdate AS TIMESTAMP), '{d}') AS {c}" for c, _, d in TEXT_DATES)
              + ", CASE WHEN o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%d.%m.%Y') ELSE strftime(CAST(o_orderdate AS TIMESTAMP), '%d %b %Y') END AS mixed_date FROM orders")


def _text_dates(spark, sf):
    o = TB.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd MMM yyyy"))
    return o.select(*[F.date_format(day, p).alias(c) for c, p, _ in TEXT_DATES], mixed.alias("mixed_date"))


def _format_sql(column):
    """Of one column: the first of the formats that parses every value (ISO: what a cast takes)."""
    tried = " ".join(f"WHEN COUNT(try_strptime({column}, '{d}')) = COUNT({column}) THEN '{s}'" for s, d in _TRIED)
    return (f"SELECT '{column}' AS \"column\", COUNT({column}) AS non_null, CASE WHEN COUNT(TRY_CAST({column} AS TIMESTAMP)) = COUNT({column}) "
            f"AND '{column}' <> 'compact_date' THEN 'ISO' {tried} END AS format FROM t")


@register("a5_date_formats", f"WITH t AS ({_TEXTS_SQL}) " + " UNION ALL ".join(_format_sql(c) for c in [*[c for c, _, _ in TEXT_DATES], "mixed_date"]))
def a5f(spark, sf):
    return TB.date_format_table(_text_dates(spark, sf))


@register("a5_coerced_formats", f"WITH t AS ({_TEXTS_SQL}) SELECT " + ", ".join(
    f"try_strptime({c}, '{d.replace('%-', '%')}') AS {c}" for c, _, d in TEXT_DATES) + ", mixed_date FROM t")
def a5cf(spark, sf):
    """All columns of one format become timestamps, the mixed one stays text."""
    return TB.coerce_date_columns(_text_dates(spark, sf))
