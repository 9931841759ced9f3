"""Registered queries: operators on a table with NaN values and NULL keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ask as A
from ..operators import modelprep as MP
from ..operators import profile as P
from ..operators import stats as ST
from ..sources.tables import table
from .q_stats import BOX_SQL
from .registry import finalize, register

GAPS = """WITH gaps AS (SELECT l_orderkey AS id, l_linenumber AS line,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS Category,
  CASE WHEN (l_orderkey * 3 + l_linenumber) % 13 = 0 THEN NULL WHEN (l_orderkey * 3 + l_linenumber) % 17 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE l_extendedprice END AS price,
  CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_linenumber % 3 AS DOUBLE) END AS grade
FROM lineitem),
ok AS (SELECT id, line, Category, CASE WHEN isnan(price) THEN NULL ELSE price END AS price,
  CASE WHEN isnan(grade) THEN NULL ELSE grade END AS grade FROM gaps)"""


def gaps_view(spark, sf):
    li = table(spark, sf, "lineitem")
    k, m = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_orderkey") * 3 + F.col("l_linenumber")
    nan = F.lit(float("nan"))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                     F.when(k % 11 != 0, F.concat("l_returnflag", "l_linestatus")).alias("Category"),
                     F.when(m % 13 == 0, None).when(m % 17 == 0, nan).otherwise(F.col("l_extendedprice")).alias("price"),
                     F.when(k % 19 == 0, nan).otherwise((F.col("l_linenumber") % 3).cast("double")).alias("grade"))


@register("e7_box_stats_gaps", GAPS + ", src AS (SELECT Category, price AS v FROM ok)" + BOX_SQL)
def e7(spark, sf):
    return finalize(ST.box_stats(gaps_view(spark, sf), "price", group="Category"), 6)


@register("g6_value_counts_gaps", GAPS + """, vc AS (SELECT grade, COUNT(*) AS count FROM ok WHERE grade IS NOT NULL GROUP BY grade)
SELECT grade, count, (SELECT COUNT(*) FROM vc) AS n_unique FROM vc""")
def g6(spark, sf):
    return A.value_counts(gaps_view(spark, sf), "grade")


@register("h1_problem_type_gaps", GAPS + """ SELECT 'grade' AS "column", COUNT(DISTINCT grade) AS n_unique, TRUE AS all_integer,
  'classification' AS problem FROM ok
UNION ALL SELECT 'price', COUNT(DISTINCT price), bool_and(price = floor(price)), 'regression' FROM ok
UNION ALL SELECT 'Category', COUNT(DISTINCT Category), NULL, 'classification' FROM ok""")
def h1(spark, sf):
    return finalize(MP.problem_type(gaps_view(spark, sf), ["grade", "price", "Category"]))


@register("b9_context_summary_gaps", GAPS + """ SELECT CAST(0 AS BIGINT) AS position, 'Category' AS "column", COUNT(Category) AS count, COUNT(DISTINCT Category) AS "unique",
  (SELECT Category FROM ok WHERE Category IS NOT NULL GROUP BY Category ORDER BY COUNT(*) DESC, Category LIMIT 1) AS top FROM ok
UNION ALL SELECT 1, 'price', COUNT(price), NULL, NULL FROM ok
UNION ALL SELECT 2, 'grade', COUNT(grade), NULL, NULL FROM ok""")
def b9(spark, sf):
    return finalize(P.context_summary(gaps_view(spark, sf).select("Category", "price", "grade")))


@register("h3_split_sizes_gaps", GAPS + """ SELECT Category, CAST(ceil(COUNT(*) * 0.2) AS BIGINT) AS test, COUNT(*) AS "rows" FROM gaps GROUP BY Category""")
def h3(spark, sf):
    s = MP.stratified_split(gaps_view(spark, sf), "Category", 0.2)
    return finalize(s.groupBy("Category").agg(F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("rows")))
