"""Registered cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import cleaning
from basketry.plans.oracle import non_product, using
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace

def _profile(df):
    """Lines, units and value per country and year: a digest of a whole line table."""
    return df.groupBy("country", F.year("invoice_date").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").cast("bigint").alias("units"),
        F.sum(F.col("quantity") * F.col("price")).cast("double").alias("value"),
    )


def _profile_sql(source: str, where: str = "") -> str:
    return f"""SELECT country, year(invoice_date) AS year, count(*) AS lines,
       CAST(sum(quantity) AS BIGINT) AS units, sum(quantity * price)::DOUBLE AS value
FROM {source} {where} GROUP BY 1, 2"""


@register("c1_drop_null_customer", using("raw_lines", _profile_sql("raw_lines", "WHERE customer_id IS NOT NULL")))
def c1(ws: Workspace):
    return _profile(cleaning.with_customer(ws.raw()))


@register("c2_separate_cancellations", using("raw_lines", """
SELECT starts_with(invoice, 'C') AS cancelled, country, count(*) AS lines, count(DISTINCT invoice) AS invoices
FROM raw_lines WHERE customer_id IS NOT NULL GROUP BY 1, 2"""))
def c2(ws: Workspace):
    sales, cancelled = cleaning.split_cancellations(cleaning.with_customer(ws.raw()))
    both = sales.withColumn("cancelled", F.lit(False)).unionByName(cancelled.withColumn("cancelled", F.lit(True)))
    return both.groupBy("cancelled", "country").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("invoice").alias("invoices")
    )


@register("c3_drop_nonpositive", using("raw_lines", _profile_sql(
    "raw_lines", "WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0")))
def c3(ws: Workspace):
    return _profile(cleaning.positive_lines(cleaning.split_cancellations(cleaning.with_customer(ws.raw()))[0]))


@register("c4_drop_exact_duplicates", using("raw_lines", _profile_sql("""(
  SELECT DISTINCT * FROM raw_lines
  WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0) d""")))
def c4(ws: Workspace):
    candidates = cleaning.split_cancellations(cleaning.with_customer(ws.raw()))[0]
    return _profile(cleaning.without_duplicates(cleaning.positive_lines(candidates)))


@register("c5_drop_non_product_codes", using("raw_lines", _profile_sql(
    "raw_lines", f"WHERE NOT {non_product('stock_code')}")))
def c5(ws: Workspace):
    return _profile(cleaning.products_only(ws.raw()))


@register("c6_clean_lines", using("sales cancellations", """
SELECT 'sale' AS kind, invoice, stock_code, description, quantity, strftime(invoice_date, '%Y-%m-%d %H:%M:%S') AS invoiced,
       price::DOUBLE AS price, customer_id, country, revenue::DOUBLE AS revenue FROM sales
UNION ALL
SELECT 'cancellation', invoice, stock_code, description, quantity, strftime(invoice_date, '%Y-%m-%d %H:%M:%S'),
       price::DOUBLE, customer_id, country, revenue::DOUBLE FROM cancellations"""))
def c6(ws: Workspace):
    sales, cancellations = cleaning.clean(ws.raw())
    both = sales.withColumn("kind", F.lit("sale")).unionByName(cancellations.withColumn("kind", F.lit("cancellation")))
    return both.select(
        "kind", "invoice", "stock_code", "description", "quantity",
        F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss").alias("invoiced"),
        F.col("price").cast("double").alias("price"), "customer_id", "country",
        F.col("revenue").cast("double").alias("revenue"),
    )


@register("c7_cleaning_log", using("raw_lines", f"""
WITH s1 AS (SELECT * FROM raw_lines WHERE customer_id IS NOT NULL),
     s2 AS (SELECT * FROM s1 WHERE NOT starts_with(invoice, 'C')),
     s3 AS (SELECT * FROM s2 WHERE quantity > 0 AND price > 0),
     s4 AS (SELECT DISTINCT * FROM s3),
     s5 AS (SELECT * FROM s4 WHERE NOT {non_product('stock_code')}),
     n AS (SELECT 1 AS k, (SELECT count(*) FROM raw_lines) AS b, (SELECT count(*) FROM s1) AS a,
                  'drop_null_customer_id' AS step, 'no customer to attribute revenue to' AS reason
           UNION ALL SELECT 2, (SELECT count(*) FROM s1), (SELECT count(*) FROM s2), 'separate_cancellations',
                  'cancelled invoice, kept apart'
           UNION ALL SELECT 3, (SELECT count(*) FROM s2), (SELECT count(*) FROM s3), 'drop_nonpositive_qty_price',
                  'quantity or price is not positive'
           UNION ALL SELECT 4, (SELECT count(*) FROM s3), (SELECT count(*) FROM s4), 'drop_exact_duplicates',
                  'line logged more than once'
           UNION ALL SELECT 5, (SELECT count(*) FROM s4), (SELECT count(*) FROM s5), 'drop_non_product_codes',
                  'fee, postage, adjustment or test code')
SELECT step, b AS rows_before, a AS rows_after, b - a AS removed, half_even(100.0::DOUBLE * (b - a) / b, 2) AS pct_removed,
       reason
FROM n"""))
def c7(ws: Workspace):
    return cleaning.cleaning_log(ws.raw())


@register("c8_cancellation_rates", using("raw_lines", """
SELECT cancelled_invoices, total_invoices,
       half_even(100.0::DOUBLE * cancelled_invoices / total_invoices, 2) AS cancel_rate_by_invoices_pct,
       half_even(cancelled::DOUBLE, 2) AS cancelled_revenue, half_even(gross::DOUBLE, 2) AS gross_revenue,
       half_even(100.0::DOUBLE * cancelled::DOUBLE / gross::DOUBLE, 2) AS cancel_rate_by_revenue_pct
FROM (SELECT count(DISTINCT invoice) FILTER (WHERE starts_with(invoice, 'C')) AS cancelled_invoices,
             count(DISTINCT invoice) AS total_invoices,
             -sum(quantity * price) FILTER (WHERE starts_with(invoice, 'C')) AS cancelled,
             sum(quantity * price) FILTER (WHERE NOT starts_with(invoice, 'C') AND quantity * price > 0) AS gross
      FROM raw_lines WHERE customer_id IS NOT NULL)"""))
def c8(ws: Workspace):
    return cleaning.cancellation_rates(ws.raw())


@register("c9_dropped_codes", using("raw_lines", f"""
SELECT stock_code, count(*) AS rows_dropped
FROM (SELECT DISTINCT * FROM raw_lines
      WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0)
WHERE {non_product('stock_code')} GROUP BY stock_code"""))
def c9(ws: Workspace):
    return cleaning.dropped_codes(ws.raw())


_FAULT = """
SELECT '{name}' AS fault, country, count(*) AS lines, count(*) FILTER (WHERE {price} <= 0) AS bad_prices,
       sum(quantity * {price})::DOUBLE AS value
FROM fact_sales {where} GROUP BY country"""


@register("c10_fault_injection", using("fact_sales", (
    _FAULT.format(name="drop_country", price="price", where="WHERE country <> 'NATION_3'")
    + " UNION ALL "
    + _FAULT.format(
        name="negative_price", price="(CASE WHEN sales_line_id <= 10 THEN -price ELSE price END)", where=""))))
def c10(ws: Workspace):
    facts = ws.star("fact_sales")
    faulty = cleaning.inject_fault(facts, "drop_country", "NATION_3").withColumn("fault", F.lit("drop_country"))
    flipped = cleaning.inject_fault(facts, "negative_price", "10").withColumn("fault", F.lit("negative_price"))
    return faulty.unionByName(flipped).groupBy("fault", "country").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("price") <= 0).alias("bad_prices"),
        F.sum(F.col("quantity") * F.col("price")).cast("double").alias("value"),
    )


@register("c11_cleaning_summary", using("raw_lines sales", """
SELECT raw_rows, clean_rows, half_even(100.0::DOUBLE * (raw_rows - clean_rows) / raw_rows, 2) AS pct_removed,
       customers, invoices, products, countries, revenue,
       100.0 * (raw_rows - clean_rows) / raw_rows BETWEEN 15 AND 35 AS removed_in_range,
       null_keys = 0 AS no_null_keys,
       first::DATE = raw_first::DATE AND last::DATE = raw_last::DATE AS date_span_kept
FROM (SELECT count(*) AS raw_rows, min(invoice_date) AS raw_first, max(invoice_date) AS raw_last FROM raw_lines),
     (SELECT count(*) AS clean_rows, count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS invoices,
             count(DISTINCT stock_code) AS products, count(DISTINCT country) AS countries,
             sum(revenue)::DOUBLE AS revenue, min(invoice_date) AS first, max(invoice_date) AS last,
             count(*) FILTER (WHERE invoice IS NULL OR stock_code IS NULL OR quantity IS NULL OR invoice_date IS NULL
                              OR price IS NULL OR customer_id IS NULL OR country IS NULL OR revenue IS NULL) AS null_keys
      FROM sales)"""))
def c11(ws: Workspace):
    return cleaning.cleaning_summary(ws.raw(), ws.sales())
