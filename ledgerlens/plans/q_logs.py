"""Registered queries: CSV files, audit logs, report tables and the stored model."""
from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.scalars import round_scaled
from ..operators import kpi as K
from ..operators import ml as ML
from ..operators import quality as Q
from ..session import scratch_path
from ..sources import report as RP
from ..sources import tables as TB
from ..sources import views as V
from ..sources.audit import AuditLog
from . import fixtures_sql as X
from .registry import finalize, register

NAMED = """SELECT c_custkey AS id, 'José ' || c_name AS name, 'says "hi", ' || c_mktsegment || chr(10) || 'and leaves' AS note,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'ok' END AS state
FROM customer"""


def _csv_cells(spark, sf):
    """Customers with cells that need care: accents, doubled quotes, line breaks, missing-value tokens."""
    c = TB.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("José "), "c_name").alias("name"),
                    F.concat(F.lit('says "hi", '), "c_mktsegment", F.lit("\nand leaves")).alias("note"),
                    F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
                    F.when(F.col("c_custkey") % 7 == 0, "null").otherwise(F.lit("ok")).alias("state"))


def _csv_round(spark, sf, encoding):
    path = scratch_path(spark, f"customer-{encoding}.csv")
    _csv_cells(spark, sf).write.option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    return finalize(TB.read_csv(spark, path))


@register("a1_read_csv_cells", NAMED)
def a1c(spark, sf):
    return _csv_round(spark, sf, "UTF-8")


@register("a2_latin1_csv", NAMED)
def a2(spark, sf):
    return _csv_round(spark, sf, "ISO-8859-1")


def _log(spark) -> AuditLog:
    return AuditLog(spark, scratch_path(spark, "audit"))


DATASETS = ("region", "nation", "customer", "orders", "part")


def _dataset_log(spark, sf) -> AuditLog:
    log = _log(spark)
    for i, name in enumerate(DATASETS):
        log.log_dataset(name, TB.table(spark, sf, name), at=f"2024-01-0{i + 1}T00:00:00")
    return log


DATASET_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS name, (SELECT COUNT(*) FROM {name}) AS \"rows\", "
    f"CAST({cols} AS BIGINT) AS \"columns\", '2024-01-0{i + 1}T00:00:00' AS uploaded_at"
    for i, (name, cols) in enumerate(zip(DATASETS, (2, 3, 5, 6, 6))))


@register("a8_dataset_log", DATASET_SQL)
def a8(spark, sf):
    return finalize(_dataset_log(spark, sf).read("datasets"))


@register("k1_recent_datasets", f"SELECT * FROM ({DATASET_SQL}) ORDER BY uploaded_at DESC LIMIT 3")
def k1(spark, sf):
    return finalize(_dataset_log(spark, sf).recent_datasets(3))


QUESTION_LOG = X.with_views(X.QUESTION) + """, l AS (SELECT 'sales' AS dataset, question, 'turn ' || turn AS answer,
  '2024-01-01T' || lpad(CAST(conv_id % 24 AS VARCHAR), 2, '0') || ':00:00' AS created_at FROM question_view)
"""


def _question_log(spark, sf) -> AuditLog:
    """Every question of the conversations, appended in bulk."""
    log = _log(spark)
    qv = V.question_view(spark, sf)
    log.log_queries(qv.select(F.lit("sales").alias("dataset"), "question", F.concat(F.lit("turn "), F.col("turn")).alias("answer"),
                              F.concat(F.lit("2024-01-01T"), F.lpad((F.col("conv_id") % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("created_at")))
    return log


@register("a9_question_log", QUESTION_LOG + "SELECT * FROM l")
def a9(spark, sf):
    return _question_log(spark, sf).read("queries")


@register("a9_compacted_log", QUESTION_LOG + "SELECT *, CAST(1 AS BIGINT) AS files FROM l UNION ALL SELECT * REPLACE (dataset || ' again' AS dataset), CAST(1 AS BIGINT) FROM l")
def a9c(spark, sf):
    """Every question appended twice, the log compacted into one file, and read back."""
    log = _question_log(spark, sf)
    log.log_queries(log.read("queries").withColumn("dataset", F.concat("dataset", F.lit(" again"))))
    log.compact("queries")
    rows = log.read("queries")
    return finalize(rows.withColumn("files", F.lit(len(rows.inputFiles()))))


@register("k2_recent_questions", QUESTION_LOG + "SELECT question, created_at FROM (SELECT * FROM l ORDER BY created_at DESC, question LIMIT 20)")
def k2(spark, sf):
    return _question_log(spark, sf).recent_queries().select("question", "created_at")


@register("a10_report_log", """SELECT r_name AS dataset, 'csv' AS report_type, '2024-01-01T00:00:00' AS created_at FROM region""")
def a10(spark, sf):
    log = _log(spark)
    for r in TB.table(spark, sf, "region").select("r_name").collect():  # a fixed, tiny table
        log.log_report(r["r_name"], "csv", at="2024-01-01T00:00:00")
    return log.read("reports")


@register("k3_log_stats", X.with_views(X.QUESTION) + """SELECT CAST(5 AS BIGINT) AS datasets, COUNT(*) AS queries, CAST(0 AS BIGINT) AS reports
FROM question_view""")
def k3(spark, sf):
    log = _question_log(spark, sf)
    for name in DATASETS:
        log.log_dataset(name, TB.table(spark, sf, name))
    return log.stats()


@register("a11_report_tables", """SELECT 'data_sample' AS "table", LEAST(1000, COUNT(*)) AS "rows" FROM part
UNION ALL SELECT 'statistics', CAST(3 AS BIGINT) UNION ALL SELECT 'insights', CAST(1 AS BIGINT)""")
def a11(spark, sf):
    """The report of the part table, written and read back; the schema table has a row per column of the input."""
    part = TB.table(spark, sf, "part")
    paths = RP.write_report(RP.report_tables(part, 1000, order_by=["p_partkey"]), scratch_path(spark, "report"))
    counts = [spark.read.parquet(paths[n]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
              for n in ("data_sample", "statistics", "insights")]
    return reduce(lambda a, b: a.unionByName(b), counts)


@register("a12_stored_model", """SELECT l_orderkey, l_linenumber, ROUND((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
  + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 2) AS prediction FROM lineitem""")
def a12(spark, sf):
    """A fitted pipeline is saved, loaded again and applied to every line."""
    li = TB.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label"))
    path = scratch_path(spark, "model")
    ML.save_model(Pipeline(stages=[VectorAssembler(inputCols=["l_quantity"], outputCol="features"),
                                   LinearRegression(regParam=0.0, solver="normal")]).fit(li), path)
    return ML.load_model(path).transform(li).select("l_orderkey", "l_linenumber", round_scaled("prediction", 2).alias("prediction"))


@register("d4_missing_share", X.with_views(X.SALES, X.DIRTY) + """SELECT ROUND((COUNT(*) - COUNT(Region) + COUNT(*) - COUNT(Profit) + COUNT(*)) * 100.0
  / (COUNT(*) * 10), 6) AS missing_pct FROM dirty_view""")
def d4(spark, sf):
    return finalize(Q.missing_total(V.dirty_view(spark, sf)).select("missing_pct"), 6)


@register("f12_regional_shares", X.with_views(X.SALES) + """SELECT Region, ROUND(CAST(SUM(Profit) AS DOUBLE)
  / (SELECT CAST(SUM(Profit) AS DOUBLE) FROM sales_view) * 100, 6) AS share_pct FROM sales_view GROUP BY Region""")
def f12(spark, sf):
    t = K.regional_totals(V.sales_lines(spark, sf, ["Region", "Profit"]), "Region", "Profit")
    return finalize(t.select("Region", "share_pct"), 6)
