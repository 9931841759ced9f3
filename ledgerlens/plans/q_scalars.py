"""Registered queries: scalar and predicate functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ask import INTENTS
from ..sources import views as V
from ..sources.tables import table
from . import fixtures_sql as X
from .registry import finalize, register


@register("c1_coerce_numeric", X.with_views(X.MONEY) + """
SELECT o_orderkey, money,
       TRY_CAST(NULLIF(regexp_replace(money, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS amount
FROM money_view""")
def c1(spark, sf):
    m = V.money_view(spark, sf)
    return m.select("o_orderkey", "money", S.coerce_numeric("money").alias("amount"))


@register("c2_to_datetime", X.with_views(X.DATE_TEXT) + """
SELECT o_orderkey, order_date, TRY_CAST(order_date AS TIMESTAMP) AS parsed FROM date_text""")
def c2(spark, sf):
    d = V.date_text_view(spark, sf)
    return d.select("o_orderkey", "order_date", S.to_datetime("order_date").alias("parsed"))


@register("c3_safe_div", """
SELECT l_orderkey, l_linenumber, COALESCE(l_tax / NULLIF(l_discount, 0), 0.0) AS tax_per_discount
FROM lineitem""")
def c3(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.safe_div("l_tax", "l_discount").alias("tax_per_discount"))


def _fmt_sql(v):
    return f"""CASE WHEN {v} IS NULL THEN '—'
     WHEN abs({v}) >= 1e9 THEN format('{{:,.2f}}', {v} / 1e9) || 'B'
     WHEN abs({v}) >= 1e6 THEN format('{{:,.2f}}', {v} / 1e6) || 'M'
     WHEN abs({v}) >= 1e3 THEN format('{{:,.1f}}', {v} / 1e3) || 'K'
     ELSE format('{{:,.2f}}', {v}) END"""


@register("c4_format_number", X.with_views(X.SALES) + f"""
, t AS (SELECT Brand, CAST(SUM(Revenue) AS DOUBLE) AS revenue, CAST(SUM(Profit) AS DOUBLE) AS profit,
        CAST(SUM(Quantity) AS DOUBLE) / 1000.0 AS kilo_units, CAST(COUNT(*) AS DOUBLE) AS lines
        FROM sales_view GROUP BY Brand)
SELECT Brand, revenue, {_fmt_sql('revenue')} AS revenue_text, {_fmt_sql('profit')} AS profit_text,
       {_fmt_sql('kilo_units')} AS kilo_units_text, {_fmt_sql('lines')} AS lines_text
FROM t""")
def c4(spark, sf):
    s = V.sales_lines(spark, sf, ["Brand", "Revenue", "Profit", "Quantity"])
    t = s.groupBy("Brand").agg(F.sum("Revenue").cast("double").alias("revenue"),
                               F.sum("Profit").cast("double").alias("profit"),
                               (F.sum("Quantity").cast("double") / 1000.0).alias("kilo_units"),
                               F.count(F.lit(1)).cast("double").alias("lines"))
    return t.select("Brand", "revenue", S.format_number("revenue").alias("revenue_text"),
                    S.format_number("profit").alias("profit_text"),
                    S.format_number("kilo_units").alias("kilo_units_text"),
                    S.format_number("lines").alias("lines_text"))


@register("c5_human_readable_size", """
SELECT doc_id, strlen(text) AS bytes,
  CASE WHEN strlen(text) < 1024 THEN format('{:,.1f} B', CAST(strlen(text) AS DOUBLE))
       WHEN strlen(text) < 1048576 THEN format('{:,.1f} KB', strlen(text) / 1024.0)
       WHEN strlen(text) < 1073741824 THEN format('{:,.1f} MB', strlen(text) / 1048576.0)
       ELSE format('{:,.1f} GB', strlen(text) / 1073741824.0) END AS size
FROM documents""")
def c5(spark, sf):
    d = table(spark, sf, "documents")
    b = F.octet_length("text")
    return d.select("doc_id", b.cast("bigint").alias("bytes"), S.human_readable_size(b).alias("size"))


@register("c6_strip_html", """
SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages""")
def c6(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", S.strip_html("html").alias("text"))


@register("c7_latin1_safe", """
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN CONCAT(text, ' €') ELSE text END,
                              '[^\\x{00}-\\x{FF}]', '?', 'g') AS text
FROM documents""")
def c7(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" €"))).otherwise(F.col("text"))
    return d.select("doc_id", S.latin1_safe(t).alias("text"))


@register("c8_name_key", """
SELECT p_partkey, p_name, replace(lower(trim(p_name)), ' ', '_') AS name_key,
       replace(lower(trim(p_type)), '_', ' ') AS type_words
FROM part""")
def c8(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_name", S.name_key("p_name").alias("name_key"),
                    S.name_key("p_type", "_", " ").alias("type_words"))


@register("c9_first_integer", X.with_views(X.QUESTION) + """
SELECT conv_id, turn,
       COALESCE(TRY_CAST(NULLIF(regexp_extract(lower(question), '\\b(\\d+)\\b', 1), '') AS BIGINT), 10) AS n
FROM question_view""")
def c9(spark, sf):
    qv = V.question_view(spark, sf)
    return qv.select("conv_id", "turn", S.first_int(F.lower("question")).alias("n"))


def _any_sql(words):
    return " OR ".join(f"contains(lower(question), '{w}')" for w in words)


@register("c10_contains_any", X.with_views(X.QUESTION) + "SELECT conv_id, turn, "
          + ", ".join(f"({_any_sql(ws)}) AS has_{name}" for name, ws in INTENTS) + " FROM question_view")
def c10(spark, sf):
    qv = V.question_view(spark, sf)
    return qv.select("conv_id", "turn", *[S.contains_any(F.lower("question"), ws).alias(f"has_{name}")
                                         for name, ws in INTENTS])


@register("c11_clip", """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_quantity < 5 THEN 5.0 WHEN l_quantity > 45 THEN 45.0 ELSE l_quantity END AS clipped
FROM lineitem""")
def c11(spark, sf):
    li = table(spark, sf, "lineitem")
    return finalize(li.select("l_orderkey", "l_linenumber", "l_quantity",
                              S.clip("l_quantity", 5.0, 45.0).alias("clipped")))


@register("c13_email_shape", X.with_views(X.TOKENS) + """
SELECT doc_id, token, regexp_matches(token, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS is_email
FROM tokens WHERE contains(token, '@')""")
def c13(spark, sf):
    t = V.tokens_view(spark, sf).where(F.contains("token", F.lit("@")))
    return t.select("doc_id", "token", S.is_email("token").alias("is_email"))


PHONE_CANDIDATE = r"[+(]?\d[\d ().\-]{5,}\d"


@register("c13_email_totals", X.with_views(X.TOKENS) + """
SELECT COUNT(*) FILTER (WHERE regexp_matches(token, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS valid,
       COUNT(*) FILTER (WHERE NOT regexp_matches(token, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS invalid FROM tokens""")
def c13t(spark, sf):
    """Valid and invalid values over all tokens of all documents."""
    return V.tokens_view(spark, sf).agg(F.count_if(S.is_email("token")).alias("valid"), F.count_if(~S.is_email("token")).alias("invalid"))


@register("c14_phone_shape", f"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE_CANDIDATE.replace(chr(92), chr(92))}')) AS candidate
           FROM documents)
SELECT doc_id, candidate, CAST(length(regexp_replace(candidate, '\\D', '', 'g')) AS BIGINT) AS digits,
       length(regexp_replace(candidate, '\\D', '', 'g')) BETWEEN 7 AND 15 AS is_phone
FROM c""")
def c14(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE_CANDIDATE), 0)).alias("candidate"))
    return c.select("doc_id", "candidate",
                    F.length(F.regexp_replace("candidate", r"\D", "")).cast("bigint").alias("digits"),
                    S.is_phone("candidate").alias("is_phone"))
