"""Registered analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import cube
from basketry.plans import analysis
from basketry.plans.oracle import using
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace

_MONTHLY = """
SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month,
       CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue,
       count(DISTINCT invoice) AS orders,
       count(DISTINCT customer_id) AS active_customers,
       date_trunc('month', any_value(invoice_date)) = (SELECT date_trunc('month', max(invoice_date)) FROM sales) AS is_partial
FROM sales GROUP BY 1"""


@register("a1_monthly_revenue", using("sales", _MONTHLY))
def a1(ws: Workspace):
    return analysis.monthly_revenue(ws.star("fact_sales"))


@register("a2_top_countries", using("sales", """
SELECT country, CAST(round(total, 2) AS DOUBLE) AS revenue, customers,
       round(100.0::DOUBLE * total::DOUBLE / (SELECT sum(revenue) FROM sales)::DOUBLE, 2) AS pct_of_total
FROM (SELECT country, sum(revenue) AS total, count(DISTINCT customer_id) AS customers FROM sales GROUP BY country)
ORDER BY total DESC, country LIMIT 10"""))
def a2(ws: Workspace):
    return analysis.top_countries(ws.star("fact_sales"))


@register("a3_top_products_per_country", using("sales dim_product", """
SELECT country, place AS rank, stock_code, description, CAST(round(total, 2) AS DOUBLE) AS revenue
FROM (SELECT country, stock_code, sum(revenue) AS total,
             row_number() OVER (PARTITION BY country ORDER BY sum(revenue) DESC, stock_code) AS place
      FROM sales
      WHERE country IN (SELECT country FROM sales GROUP BY country ORDER BY sum(revenue) DESC, country LIMIT 5)
      GROUP BY country, stock_code)
JOIN dim_product USING (stock_code)
WHERE place <= 3"""))
def a3(ws: Workspace):
    return analysis.top_products_per_country(ws.star("fact_sales"), ws.star("dim_product"))


_RANKED = """
ranked AS (SELECT customer_id, revenue, n, total, so_far, place FROM (
  SELECT customer_id, revenue, count(*) OVER () AS n, sum(revenue) OVER () AS total,
         sum(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) AS so_far,
         row_number() OVER (ORDER BY revenue DESC, customer_id) AS place
  FROM (SELECT customer_id, sum(revenue) AS revenue FROM sales GROUP BY customer_id)))"""


@register("a4_revenue_concentration", using("sales", f"""
WITH {_RANKED}
SELECT max(n) AS customers,
       round(100 * (sum(revenue) FILTER (WHERE place <= ceil(0.01::DOUBLE * n)))::DOUBLE / sum(revenue)::DOUBLE, 2)
         AS top_1pct_share,
       round(100 * (sum(revenue) FILTER (WHERE place <= ceil(0.10::DOUBLE * n)))::DOUBLE / sum(revenue)::DOUBLE, 2)
         AS top_10pct_share,
       round(100 * (sum(revenue) FILTER (WHERE place <= ceil(0.20::DOUBLE * n)))::DOUBLE / sum(revenue)::DOUBLE, 2)
         AS top_20pct_share
FROM ranked"""))
def a4(ws: Workspace):
    shares = {"top_1pct_share": 0.01, "top_10pct_share": 0.10, "top_20pct_share": 0.20}
    return analysis.revenue_concentration(ws.star("fact_sales"), shares)


@register("a5_lorenz_curve", using("sales", f"""
WITH {_RANKED}
SELECT place, 100.0::DOUBLE * place::DOUBLE / n::DOUBLE AS customer_pct,
       100.0::DOUBLE * so_far::DOUBLE / total::DOUBLE AS cum_revenue_pct
FROM ranked"""))
def a5(ws: Workspace):
    return analysis.lorenz_curve(ws.star("fact_sales"))


_ORDER_VALUE = """
SELECT month, count(*) AS orders, round(sum(order_value)::DOUBLE / count(*), 2) AS avg_order_value,
       round(quantile_cont(order_value::DOUBLE, 0.5), 2) AS median_order_value
FROM (SELECT invoice, CAST(date_trunc('month', min(invoice_date)) AS DATE) AS month, sum(revenue) AS order_value
      FROM sales GROUP BY invoice)
GROUP BY month"""


@register("a6_monthly_order_value", using("sales", _ORDER_VALUE))
def a6(ws: Workspace):
    return analysis.monthly_order_value(ws.star("fact_sales"))


_RETENTION = """
SELECT month, count(*) AS active_customers, count(again) AS retained_next_month,
       round(100.0::DOUBLE * count(again) / count(*), 2) AS retention_pct
FROM (SELECT a.month, b.customer_id AS again
      FROM (SELECT DISTINCT customer_id, date_trunc('month', invoice_date) AS month FROM sales) a
      LEFT JOIN (SELECT DISTINCT customer_id, date_trunc('month', invoice_date) AS month FROM sales) b
        ON b.customer_id = a.customer_id AND b.month = a.month + INTERVAL 1 MONTH
      WHERE a.month < (SELECT date_trunc('month', max(invoice_date)) FROM sales) - INTERVAL 1 MONTH)
GROUP BY month"""


@register("a7_monthly_retention", using("sales", f"SELECT month::DATE AS month, * EXCLUDE (month) FROM ({_RETENTION})"))
def a7(ws: Workspace):
    return analysis.monthly_retention(ws.star("fact_sales"))


@register("a8_peak_month_ratio", using("sales", f"""
WITH monthly AS ({_MONTHLY})
SELECT (SELECT month FROM monthly WHERE NOT is_partial ORDER BY revenue DESC, month LIMIT 1) AS peak_month,
       max(revenue) AS peak_revenue, median(revenue) AS median_revenue,
       round(max(revenue) / median(revenue), 2) AS peak_vs_median
FROM monthly WHERE NOT is_partial"""))
def a8(ws: Workspace):
    full = analysis.monthly_revenue(ws.star("fact_sales")).filter(~F.col("is_partial"))
    # One row per calendar month, so the exact aggregate stays small.
    summary = full.agg(
        F.max_by("month", F.struct("revenue", F.datediff(F.lit("1970-01-01"), "month"))).alias("peak_month"),
        F.max("revenue").alias("peak_revenue"),
        F.median("revenue").alias("median_revenue"),
    )
    return summary.withColumn("peak_vs_median", F.round(F.col("peak_revenue") / F.col("median_revenue"), 2))


@register("a9_pooled_retention", using("sales", f"""
SELECT round(100.0::DOUBLE * sum(retained_next_month) / sum(active_customers), 2) AS pooled_retention_pct,
       min(retention_pct) AS lowest_pct, max(retention_pct) AS highest_pct
FROM ({_RETENTION})"""))
def a9(ws: Workspace):
    return analysis.monthly_retention(ws.star("fact_sales")).agg(
        F.round(100.0 * F.sum("retained_next_month") / F.sum("active_customers"), 2).alias("pooled_retention_pct"),
        F.min("retention_pct").alias("lowest_pct"),
        F.max("retention_pct").alias("highest_pct"),
    )


@register("a10_order_value_range", using("sales", f"""
SELECT min(median_order_value) AS median_lowest, max(median_order_value) AS median_highest,
       min(avg_order_value) AS mean_lowest, max(avg_order_value) AS mean_highest
FROM ({_ORDER_VALUE})"""))
def a10(ws: Workspace):
    return analysis.monthly_order_value(ws.star("fact_sales")).agg(
        F.min("median_order_value").alias("median_lowest"),
        F.max("median_order_value").alias("median_highest"),
        F.min("avg_order_value").alias("mean_lowest"),
        F.max("avg_order_value").alias("mean_highest"),
    )


@register("a1_revenue_cube", using("sales", """
SELECT year, country, stock_code, CAST(4 * grouping(year) + 2 * grouping(country) + grouping(stock_code) AS INTEGER) AS level,
       sum(revenue)::DOUBLE AS revenue, count(*) AS lines
FROM (SELECT CAST(year(invoice_date) AS INTEGER) AS year, country, stock_code, revenue FROM sales)
GROUP BY GROUPING SETS ((year, country, stock_code), (year, country), (country, stock_code), (year), (country), (stock_code), ())"""))
def a1_cube(ws: Workspace):
    """Exact sums at seven levels from states by year, country and product."""
    states = ws.written("cube_sums", lambda: cube.sum_states(ws.star("fact_sales")))
    return cube.revenue_cube(states).withColumn("revenue", F.col("revenue").cast("double"))


@register("a1_customers_by_sketch", using("sales", """
SELECT year, country, CAST(2 * grouping(year) + grouping(country) AS INTEGER) AS level, count(DISTINCT customer_id) AS customers,
       true AS customers_close, true AS median_close
FROM (SELECT CAST(year(invoice_date) AS INTEGER) AS year, country, customer_id FROM sales)
GROUP BY GROUPING SETS ((year, country), (year), (country), ())"""))
def a1_sketches(ws: Workspace):
    """Estimates from sketches of two loads merged, against the facts."""
    facts = ws.star("fact_sales")
    early = F.col("invoice_date") < F.lit("1998-07-01").cast("timestamp_ntz")
    states = ws.written("cube_sketches", lambda: cube.merged(cube.sketch_states(facts.filter(early)), cube.sketch_states(facts.filter(~early))))
    return cube.checked(facts, states)
