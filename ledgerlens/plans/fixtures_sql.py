"""SQL definitions of the derived views, used only by the oracle queries.

They run unchanged in DuckDB on the pre-registered test tables; the Spark side
builds the same views with the DataFrame API (sources/views.py).
"""

SALES = """sales_view AS (
SELECT l.l_orderkey AS OrderID, l.l_linenumber AS LineNo, l.l_partkey AS PartID, l.l_suppkey AS SuppID,
       CAST(l.l_shipdate AS DATE) AS Date, r.r_name AS Region, p.p_type AS Category,
       p.p_retailprice AS UnitPrice, l.l_quantity AS Quantity, l.l_discount AS Discount,
       CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS Revenue,
       CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (CAST(0.20 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS Profit,
       o.o_custkey AS CustomerID, p.p_brand AS Brand
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey)"""

DIRTY = """dirty_view AS (
SELECT OrderID, LineNo, PartID, SuppID,
       CASE WHEN (OrderID*7+LineNo) % 133 = 0 THEN NULL ELSE Region END AS Region, Category,
       CASE WHEN (OrderID*7+LineNo) % 50 = 0 THEN NULL ELSE CAST(Profit AS DOUBLE) END AS Profit,
       CASE WHEN (OrderID*7+LineNo) % 97 = 0 THEN CAST(Revenue AS DOUBLE)*20 ELSE CAST(Revenue AS DOUBLE) END AS Revenue,
       CAST(NULL AS DOUBLE) AS Empty, CAST(1 AS DOUBLE) AS Flat
FROM sales_view)"""

MONEY = """money_view AS (
SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN CONCAT('$', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(30)))
  WHEN 1 THEN CONCAT(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(30)), ' EUR')
  WHEN 2 THEN CONCAT('(', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(30)), ')')
  WHEN 3 THEN 'n/a'
  WHEN 4 THEN CONCAT(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(30)), 'e3')
  ELSE CONCAT('1-', CAST(o_orderkey AS VARCHAR(20))) END AS money
FROM orders)"""

QUESTION = """question_view AS (
SELECT conv_id, turn, CASE conv_id % 9
  WHEN 0 THEN 'Show top 5 category by revenue'  WHEN 1 THEN 'lowest 3 region by profit'
  WHEN 2 THEN 'what is the sales trend'         WHEN 3 THEN 'find unusual revenue'
  WHEN 4 THEN 'any relationship between metrics' WHEN 5 THEN 'how many rows by region'
  WHEN 6 THEN 'average profit'                  WHEN 7 THEN 'total revenue'
  ELSE text END AS question
FROM conversations WHERE role = 'user')"""

DATE_TEXT = """date_text AS (
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_orderdate AS VARCHAR) END AS order_date
FROM orders)"""

PREDICTIONS = """preds AS (
SELECT l_returnflag AS actual,
       CASE WHEN l_discount > 0.06 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END AS predicted
FROM lineitem)"""

SCORES = """scores AS (
SELECT CAST(l_linestatus = 'O' AS INTEGER) AS label, l_discount + l_tax / 100 AS score FROM lineitem)"""

REGRESSION = """pairs AS (
SELECT l_extendedprice AS actual, l_quantity * p_retailprice AS predicted
FROM lineitem JOIN part ON l_partkey = p_partkey)"""

TOKENS = """tokens AS (
SELECT doc_id, t.token
FROM documents, UNNEST(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+')) AS t(token))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
