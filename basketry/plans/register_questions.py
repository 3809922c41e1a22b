"""Registered business questions; years 1999 and 2000 are the last two complete years of the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from basketry.plans import questions as q
from basketry.plans.oracle import using
from basketry.plans.registry import register

BASE, LATER = 1999, 2000
_FROM = "invoice_date >= '{0}' AND invoice_date < '{1}'"


def _year(year: int) -> str:
    return _FROM.format(f"{year}-01-01", f"{year + 1}-01-01")


def _ask(name: str, product: Callable[..., DataFrame], tables: str, sql: str, blocks: str = "sales cancellations") -> None:
    """Register a question that reads the named star tables in the order of its arguments."""
    names = tables.split()
    register(name, using(blocks, sql))(lambda ws: product(*[ws.star(n) for n in names]))


S, C, SC = "fact_sales", "fact_cancellations", "fact_sales fact_cancellations"
_TOP_CUSTOMERS = "SELECT customer_id, sum(revenue) AS total FROM sales GROUP BY 1 ORDER BY total DESC, customer_id LIMIT 3"
_TWO_YEARS = (
    f"SELECT {{0}} AS k, sum(revenue) FILTER (WHERE {_year(BASE)}) AS b, sum(revenue) FILTER (WHERE {_year(LATER)}) AS l"
    " FROM sales GROUP BY 1"
)

_ask("e01_total_revenue", q.total_revenue, S, "SELECT sum(revenue)::DOUBLE AS revenue FROM sales")
_ask("e02_buying_customers", q.buyer_count, S, "SELECT count(DISTINCT customer_id) AS customers FROM sales")
_ask("e03_orders", q.invoice_count, S, "SELECT count(DISTINCT invoice) AS orders FROM sales")
_ask("e06_first_and_last_sale", q.sale_span, S,
     "SELECT min(invoice_date) AS first_sale, max(invoice_date) AS last_sale FROM sales")
_ask("e07_cancelled_invoices", lambda c: q.invoice_count(c, "cancelled_invoices"), C,
     "SELECT count(DISTINCT invoice) AS cancelled_invoices FROM cancellations")
_ask("e08_revenue_in_year", lambda s: q.total_revenue(s.filter(q.in_year(BASE))), S,
     f"SELECT sum(revenue)::DOUBLE AS revenue FROM sales WHERE {_year(BASE)}")
_ask("m01_top_countries", lambda s: q.revenue_by_country(s, 5), S,
     "SELECT country, sum(revenue)::DOUBLE AS revenue FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 5")
_ask("m02_revenue_per_year", q.revenue_by_year, S,
     "SELECT year(invoice_date) AS year, sum(revenue)::DOUBLE AS revenue FROM sales GROUP BY 1")
_ask("m03_top_products", lambda s, p: q.best_products(s, p, 10), "fact_sales dim_product", """
SELECT stock_code, description, total::DOUBLE AS revenue
FROM (SELECT stock_code, sum(revenue) AS total FROM sales GROUP BY 1) JOIN dim_product USING (stock_code)
ORDER BY total DESC, stock_code LIMIT 10""", "sales dim_product")
_ask("m04_mean_order_value", q.mean_order_value, S, """
SELECT sum(v)::DOUBLE / count(*) AS avg_order_value FROM (SELECT sum(revenue) AS v FROM sales GROUP BY invoice)""")
_ask("m05_biggest_customer", q.biggest_customer, S,
     f"SELECT customer_id, total::DOUBLE AS revenue FROM ({_TOP_CUSTOMERS}) ORDER BY total DESC LIMIT 1")
_ask("m06_revenue_by_weekday", q.revenue_by_weekday, "fact_sales dim_date",
     "SELECT dayname(invoice_date) AS day_name, sum(revenue)::DOUBLE AS revenue FROM sales GROUP BY 1")
_ask("m09_monthly_revenue_of_year", lambda s: q.revenue_by_month_of(s, LATER), S, f"""
SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue)::DOUBLE AS revenue
FROM sales WHERE {_year(LATER)} GROUP BY 1""")
_ask("m10_most_cancelled_country", q.most_cancelled_country, C, """
SELECT country, (-sum(revenue))::DOUBLE AS cancelled_value FROM cancellations
GROUP BY 1 ORDER BY sum(revenue), country LIMIT 1""")
_ask("m11_products_per_order", q.products_per_order, S, """
SELECT avg(n) AS avg_products FROM (SELECT count(DISTINCT stock_code) AS n FROM sales GROUP BY invoice)""")
_ask("m12_one_order_customers", q.one_order_customers, S, """
SELECT count(*) AS customers FROM (SELECT customer_id FROM sales GROUP BY 1 HAVING count(DISTINCT invoice) = 1)""")
_ask("h01_best_month", q.best_month, S, """
SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue)::DOUBLE AS revenue
FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1""")
_ask("h02_month_over_month", lambda s: q.month_over_month(s, "2000-02-01", "2000-11-01"), S, """
SELECT month, 100.0::DOUBLE * (r - p)::DOUBLE / p::DOUBLE AS pct_change
FROM (SELECT month, r, lag(r) OVER (ORDER BY month) AS p
      FROM (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS r FROM sales GROUP BY 1))
WHERE month BETWEEN DATE '2000-02-01' AND DATE '2000-11-01'""")
_ask("h03_best_product_in_top_countries", lambda s: q.best_product_of_top_countries(s, 3), S, """
SELECT country, stock_code, total::DOUBLE AS revenue
FROM (SELECT country, stock_code, sum(revenue) AS total,
             row_number() OVER (PARTITION BY country ORDER BY sum(revenue) DESC, stock_code) AS place
      FROM sales GROUP BY 1, 2)
WHERE place = 1 AND country IN (SELECT country FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 3)""")
_ask("h04_top_decile_share", lambda s: q.top_share(s, 0.1), S, """
SELECT round(100.0::DOUBLE * (sum(r) FILTER (WHERE place <= ceil(0.1::DOUBLE * n)))::DOUBLE / sum(r)::DOUBLE, 2)
         AS pct_of_revenue
FROM (SELECT r, row_number() OVER (ORDER BY r DESC, customer_id) AS place, count(*) OVER () AS n
      FROM (SELECT customer_id, sum(revenue) AS r FROM sales GROUP BY 1))""")
_ask("h05_customers_spending_less", lambda s: q.customers_spending_less(s, BASE, LATER), S,
     f"SELECT count(*) AS customers FROM ({_TWO_YEARS.format('customer_id')}) WHERE l < b")
_QUARTERS = (("1999-01-01", "1999-04-01"), ("2000-01-01", "2000-04-01"))
_SEASONS = (("1999-09-01", "1999-12-01"), ("2000-09-01", "2000-12-01"))


def _change_sql(periods) -> str:
    return f"""
SELECT 100.0::DOUBLE * (l - b)::DOUBLE / b::DOUBLE AS pct_change
FROM (SELECT sum(revenue) FILTER (WHERE {_FROM.format(*periods[0])}) AS b,
             sum(revenue) FILTER (WHERE {_FROM.format(*periods[1])}) AS l FROM sales)"""


_ask("h06_quarter_year_on_year", lambda s: q.period_change(s, *_QUARTERS), S, _change_sql(_QUARTERS))
_ask("h07_retained_next_year", lambda s: q.retained_next_year(s, BASE), S, f"""
SELECT 100.0::DOUBLE * count(b.customer_id) / count(*) AS pct_retained
FROM (SELECT DISTINCT customer_id FROM sales WHERE {_year(BASE)}) a
LEFT JOIN (SELECT DISTINCT customer_id FROM sales WHERE {_year(LATER)}) b USING (customer_id)""")
_ask("h08_spans_of_top_customers", lambda s: q.spans_of_best_customers(s, 3), S, f"""
SELECT customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase
FROM sales SEMI JOIN ({_TOP_CUSTOMERS}) best USING (customer_id) GROUP BY 1""")
_ask("h09_running_revenue", lambda s: q.running_revenue(s, LATER), S, f"""
SELECT month, (sum(r) OVER (ORDER BY month))::DOUBLE AS cumulative_revenue
FROM (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS r FROM sales
      WHERE {_year(LATER)} GROUP BY 1)""")
_ask("h10_biggest_product_increase", lambda s: q.biggest_product_increase(s, BASE, LATER, 5), S, f"""
SELECT k AS stock_code, (l - b)::DOUBLE AS increase FROM ({_TWO_YEARS.format('stock_code')})
WHERE l - b IS NOT NULL ORDER BY l - b DESC, k LIMIT 5""")
_ask("h11_median_order_value", q.median_order_value, S, """
SELECT quantile_cont(v::DOUBLE, 0.5) AS median_order_value FROM (SELECT sum(revenue) AS v FROM sales GROUP BY invoice)""")
_ask("h12_net_revenue_of_year", lambda s, c: q.net_revenue(s, c, LATER), SC, f"""
SELECT sum(revenue)::DOUBLE AS net_revenue
FROM (SELECT * FROM sales UNION ALL SELECT * FROM cancellations) WHERE {_year(LATER)}""")
_ask("h13_most_returned_product", q.most_returned_product, C, """
SELECT stock_code, CAST(-sum(quantity) AS BIGINT) AS units_returned FROM cancellations
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
_ask("h14_new_customers_of_year", lambda s: q.new_customers(s, "1999-01-01", "2000-01-01"), S, f"""
SELECT count(*) AS new_customers
FROM (SELECT min(invoice_date) AS invoice_date FROM sales GROUP BY customer_id) WHERE {_year(BASE)}""")
_ask("h15_share_from_earlier_buyers", lambda s: q.share_from_earlier_buyers(s, LATER), S, f"""
SELECT 100.0::DOUBLE * (sum(revenue) FILTER (WHERE customer_id IN (SELECT customer_id FROM sales WHERE {_year(BASE)})))::DOUBLE
       / sum(revenue)::DOUBLE AS pct_of_revenue
FROM sales WHERE {_year(LATER)}""")
_ask("h16_revenue_per_active_customer", lambda s: q.revenue_per_active_customer(s, LATER), S, f"""
SELECT sum(revenue)::DOUBLE / count(DISTINCT customer_id) AS revenue_per_customer FROM sales WHERE {_year(LATER)}""")
_ask("x01_net_revenue_per_year", q.net_by_year, SC, """
SELECT year(invoice_date) AS year, sum(revenue)::DOUBLE AS net_revenue
FROM (SELECT * FROM sales UNION ALL SELECT * FROM cancellations) GROUP BY 1""")
_ask("x02_cancelled_share", lambda s, c: q.cancelled_share(s, c, LATER), SC, f"""
SELECT 100.0::DOUBLE * (SELECT -sum(revenue) FROM cancellations WHERE {_year(LATER)})::DOUBLE
       / (SELECT sum(revenue) FROM sales WHERE {_year(LATER)})::DOUBLE AS pct_cancelled""")
_ask("x03_top_net_customers", lambda s, c: q.best_net_customers(s, c, 5), SC, """
SELECT customer_id, sum(revenue)::DOUBLE AS net_revenue
FROM (SELECT * FROM sales UNION ALL SELECT * FROM cancellations)
WHERE customer_id IN (SELECT customer_id FROM sales) GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 5""")
_ask("x04_top_customers_cancellations", lambda s, c: q.best_customers_cancellations(s, c, 3), SC, f"""
SELECT customer_id, total::DOUBLE AS revenue,
       (SELECT count(DISTINCT invoice) FROM cancellations c WHERE c.customer_id = best.customer_id) AS cancelled_invoices
FROM ({_TOP_CUSTOMERS}) best""")
_ask("x05_country_orders_and_cancellations", lambda s, c: q.country_orders_and_cancellations(s, c, "NATION_7"), SC, """
SELECT count(DISTINCT invoice) FILTER (WHERE NOT starts_with(invoice, 'C')) AS orders,
       count(DISTINCT invoice) FILTER (WHERE starts_with(invoice, 'C')) AS cancelled_invoices
FROM (SELECT * FROM sales UNION ALL SELECT * FROM cancellations) WHERE country = 'NATION_7'""")
_ask("x06_growing_countries", lambda s: q.growing_countries(s, BASE, LATER, 10000, 1.05), S,
     f"SELECT k AS country FROM ({_TWO_YEARS.format('country')}) WHERE b >= 10000 AND l > 1.05 * b")
_ask("x07_season_year_on_year", lambda s: q.period_change(s, *_SEASONS), S, _change_sql(_SEASONS))
_HALVES = (("2000-01-01", "2000-07-01"), ("2000-07-01", "2001-01-01"))
_ask("x08_lapsed_in_second_half", lambda s: q.lapsed_between_periods(s, *_HALVES), S, f"""
SELECT count(DISTINCT customer_id) AS customers FROM sales
WHERE {_FROM.format(*_HALVES[0])}
  AND customer_id NOT IN (SELECT customer_id FROM sales WHERE {_FROM.format(*_HALVES[1])})""")
_ask("x09_best_month_for_new_customers", lambda s: q.best_month_for_new_customers(s, BASE), S, f"""
SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, count(*) AS new_customers
FROM (SELECT min(invoice_date) AS invoice_date FROM sales GROUP BY customer_id)
WHERE {_year(BASE)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
_ask("x10_active_in_month", lambda s: q.active_in(s, "2000-11-01", "2000-12-01"), S, f"""
SELECT count(DISTINCT customer_id) AS customers FROM sales WHERE {_FROM.format('2000-11-01', '2000-12-01')}""")
_ask("x11_order_value_of_busiest_countries", lambda s: q.order_value_of_busiest_countries(s, 3), S, """
SELECT country, sum(v)::DOUBLE / count(*) AS avg_order_value
FROM (SELECT country, invoice, sum(revenue) AS v FROM sales GROUP BY 1, 2)
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3""")
