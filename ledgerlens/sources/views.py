"""Business-shaped views derived from the star-schema test tables.

``sales_view`` flattens lineitem with its order, customer region and part into
the column names a sales analyst uses (Revenue, Profit, Region, Category ...).
Money is decimal from the start so totals are exact in every engine.

Join plan at scale: lineitem is the fact table. Only the dimensions a caller
needs are joined (``columns=``), relying on the schema's foreign keys (every
line has its order, every order its customer, every customer its nation).
region and nation have fixed, tiny sizes and are broadcast; customer, orders
and part grow with the data and are left to the planner (AQE broadcasts them
only when their runtime size is under the threshold, else sort-merge joins).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SALES_COLUMNS = ("OrderID", "LineNo", "PartID", "SuppID", "Date", "Region", "Category",
                 "UnitPrice", "Quantity", "Discount", "Revenue", "Profit", "CustomerID", "Brand")

_NEEDS_ORDERS = {"Region", "CustomerID"}
_NEEDS_REGION = {"Region"}
_NEEDS_PART = {"Category", "UnitPrice", "Brand"}


def _money(price, factor):
    return (price.cast("decimal(12,2)") * factor).cast("decimal(18,4)")


def sales_view(spark: SparkSession, sf_dir: str, columns=None, trust_foreign_keys: bool = False) -> DataFrame:
    """The flat sales table; ``columns`` limits it to what an operator reads.

    By default every inner join runs, so orphan lines drop whatever columns are
    asked for. A caller that knows its foreign keys hold may set
    ``trust_foreign_keys``: joins whose columns are not requested are then
    skipped (each is a many-to-one lookup).
    """
    want = list(columns) if columns else list(SALES_COLUMNS)
    need = set(want) if trust_foreign_keys else set(SALES_COLUMNS)
    li = table(spark, sf_dir, "lineitem")
    disc = F.col("l_discount").cast("decimal(4,2)")
    out = li.select(
        F.col("l_orderkey").alias("OrderID"), F.col("l_linenumber").alias("LineNo"),
        F.col("l_partkey").alias("PartID"), F.col("l_suppkey").alias("SuppID"),
        F.to_date("l_shipdate").alias("Date"),
        F.col("l_quantity").alias("Quantity"), F.col("l_discount").alias("Discount"),
        _money(F.col("l_extendedprice"), F.lit(1).cast("decimal(4,2)") - disc).alias("Revenue"),
        _money(F.col("l_extendedprice"), F.lit(0.20).cast("decimal(4,2)") - disc).alias("Profit"))
    if need & _NEEDS_ORDERS:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("OrderID"), F.col("o_custkey").alias("CustomerID"))
        if need & _NEEDS_REGION:
            geo = (table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")),
                                                      F.col("n_regionkey") == F.col("r_regionkey"))
                   .select("n_nationkey", F.col("r_name").alias("Region")))
            cust = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
                    .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
                    .select(F.col("c_custkey").alias("CustomerID"), "Region"))
            # resolve the order's region on the (narrow) orders side before
            # touching the fact table, so lineitem is shuffled once on OrderID
            orders = orders.join(cust, "CustomerID")
        out = out.join(orders, "OrderID")
    if need & _NEEDS_PART:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("PartID"), F.col("p_type").alias("Category"),
            F.col("p_retailprice").alias("UnitPrice"), F.col("p_brand").alias("Brand"))
        out = out.join(part, "PartID")
    return out.select(*want)


def sales_lines(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """:func:`sales_view` of tables without orphans (as the test tables are): only the lookups that are read."""
    return sales_view(spark, sf_dir, columns, trust_foreign_keys=True)


def dirty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values, planted outliers, an all-NULL column and a constant column."""
    s = sales_view(spark, sf_dir, ["OrderID", "LineNo", "PartID", "SuppID", "Region", "Category",
                                   "Profit", "Revenue"])
    k = F.col("OrderID") * 7 + F.col("LineNo")
    return s.select(
        "OrderID", "LineNo", "PartID", "SuppID",
        F.when(k % 133 == 0, F.lit(None).cast("string")).otherwise(F.col("Region")).alias("Region"),
        "Category",
        F.when(k % 50 == 0, F.lit(None).cast("double")).otherwise(F.col("Profit").cast("double")).alias("Profit"),
        F.when(k % 97 == 0, F.col("Revenue").cast("double") * 20).otherwise(F.col("Revenue").cast("double")).alias("Revenue"),
        F.lit(None).cast("double").alias("Empty"), F.lit(1).cast("double").alias("Flat"))


def money_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as text money in six shapes."""
    o = table(spark, sf_dir, "orders")
    amt = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    m = F.col("o_orderkey") % 6
    money = (F.when(m == 0, F.concat(F.lit("$"), amt))
             .when(m == 1, F.concat(amt, F.lit(" EUR")))
             .when(m == 2, F.concat(F.lit("("), amt, F.lit(")")))
             .when(m == 3, F.lit("n/a"))
             .when(m == 4, F.concat(amt, F.lit("e3")))
             .otherwise(F.concat(F.lit("1-"), F.col("o_orderkey").cast("string"))))
    return o.select("o_orderkey", money.alias("money"))


# Fixed question texts planted into the user turns (one per intent family).
QUESTIONS = (
    "Show top 5 category by revenue", "lowest 3 region by profit", "what is the sales trend",
    "find unusual revenue", "any relationship between metrics", "how many rows by region",
    "average profit", "total revenue",
)


def question_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with planted analyst questions (every 9th keeps its own text)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    k = F.col("conv_id") % 9
    expr = F.col("text")
    for i in reversed(range(len(QUESTIONS))):
        expr = F.when(k == i, F.lit(QUESTIONS[i])).otherwise(expr)
    return c.select("conv_id", "turn", expr.alias("question"))


def date_text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text with every 7th replaced by 'bad'."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad"))
                    .otherwise(F.col("o_orderdate").cast("string")).alias("order_date"))


def predictions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed class predictions: actual return flag vs a rule on discount and tax."""
    li = table(spark, sf_dir, "lineitem")
    pred = (F.when(F.col("l_discount") > 0.06, "R").when(F.col("l_tax") > 0.04, "A").otherwise("N"))
    return li.select(F.col("l_returnflag").alias("actual"), pred.alias("predicted"))


def scores_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed binary scores with many ties: label = open line, score = discount + tax/100."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_linestatus") == "O").cast("int").alias("label"),
                     (F.col("l_discount") + F.col("l_tax") / 100).alias("score"))


def regression_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed regression pairs: actual extended price vs quantity x retail price."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_extendedprice").alias("actual"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted")))


WHITESPACE = r"[ \t\n\r\f\x0B]+"


def tokens_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace tokens of every document (whole texts), with their position."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", WHITESPACE)).alias("pos", "token"))
