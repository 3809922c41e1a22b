"""Registered metrics: the current definitions (d01-d10) and both readings of each contested one (k1-k10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import sweeps
from basketry.plans import metric_layer as m
from basketry.plans.register_questions import _ask, _year
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace

S, SC = "fact_sales", "fact_sales fact_cancellations"
HOME, UNSPECIFIED = "NATION_0", "NATION_24"
LARGE, LARGE_BEFORE = 100_000, 50_000


def _active_sql(as_of: str, days: int) -> str:
    return f"""SELECT count(DISTINCT customer_id) AS active_customers FROM sales
WHERE invoice_date >= DATE '{as_of}' + 1 - {days} AND invoice_date < DATE '{as_of}' + 1"""


def _churn_sql(as_of: str, days: int) -> str:
    return f"""SELECT count(*) FILTER (WHERE gone) AS churned, count(*) FILTER (WHERE NOT gone) AS active,
       100.0::DOUBLE * count(*) FILTER (WHERE gone) / count(*) AS churn_rate_pct
FROM (SELECT max(invoice_date) < DATE '{as_of}' + 1 - {days} AS gone FROM sales
      WHERE invoice_date < DATE '{as_of}' + 1 GROUP BY customer_id)"""


def _aov_sql(year: int, net: bool) -> str:
    back = f"coalesce((SELECT sum(revenue) FROM cancellations WHERE {_year(year)}), 0)" if net else "0"
    return f"""SELECT (sum(revenue) + {back})::DOUBLE / count(DISTINCT invoice) AS average_order_value
FROM sales WHERE {_year(year)}"""


def _rate_sql(year: int, by_value: bool) -> str:
    if by_value:
        return f"""SELECT 100.0::DOUBLE * (SELECT -sum(revenue) FROM cancellations WHERE {_year(year)})::DOUBLE
       / (SELECT sum(revenue) FROM sales WHERE {_year(year)})::DOUBLE AS cancellation_rate_pct"""
    return f"""SELECT 100.0::DOUBLE * count(DISTINCT invoice) FILTER (WHERE starts_with(invoice, 'C'))
       / count(DISTINCT invoice) AS cancellation_rate_pct
FROM (SELECT * FROM sales UNION ALL SELECT * FROM cancellations) WHERE {_year(year)}"""


def _large_sql(year: int, threshold: int) -> str:
    return f"""SELECT count(*) AS large_orders FROM (
  SELECT invoice FROM sales WHERE {_year(year)} GROUP BY 1 HAVING sum(revenue) >= {threshold})"""


def _readings(current: str, former: str) -> str:
    return f"SELECT 'current' AS reading, * FROM ({current}) UNION ALL SELECT 'former' AS reading, * FROM ({former})"


def _both(current, former):
    return current.select(F.lit("current").alias("reading"), "*").unionByName(
        former.select(F.lit("former").alias("reading"), "*")
    )


_MONTH = ("1996-09-01", "1996-10-01")
_NEW_SQL = f"""SELECT count(*) AS new_customers
FROM (SELECT min(invoice_date) AS f FROM sales GROUP BY customer_id) WHERE f >= '{_MONTH[0]}' AND f < '{_MONTH[1]}'"""
_REPEAT_SQL = f"""SELECT count(*) FILTER (WHERE n >= 2) AS repeat_customers,
       100.0::DOUBLE * count(*) FILTER (WHERE n >= 2) / count(*) AS repeat_rate_pct
FROM (SELECT count(DISTINCT invoice) AS n FROM sales WHERE {_year(2000)} GROUP BY customer_id)"""
_MARKET_SQL = f"""SELECT (sum(revenue) FILTER (WHERE country = '{HOME}'))::DOUBLE AS domestic_revenue,
       (sum(revenue) FILTER (WHERE country NOT IN ('{HOME}', '{UNSPECIFIED}')))::DOUBLE AS international_revenue
FROM sales WHERE {_year(2000)}"""
_PEAK_SQL = f"""SELECT 100.0::DOUBLE * (sum(revenue) FILTER (WHERE month(invoice_date) IN (9, 10, 11)))::DOUBLE
       / sum(revenue)::DOUBLE AS peak_season_pct
FROM sales WHERE {_year(1999)}"""

_ask("d01_active_customers", lambda s: m.active_customers(s, "2000-09-30"), S, _active_sql("2000-09-30", 90))
_ask("d02_churned_customers", lambda s: m.churn(s, "2000-06-30").select("churned"), S,
     f"SELECT churned FROM ({_churn_sql('2000-06-30', 90)})")
_ask("d03_churn_rate", lambda s: m.churn(s, "1999-12-31").select("churn_rate_pct"), S,
     f"SELECT churn_rate_pct FROM ({_churn_sql('1999-12-31', 90)})")
_ask("d04_average_order_value", lambda s, c: m.average_order_value(s, c, 2000), SC, _aov_sql(2000, True))
_ask("d05_cancellation_rate", lambda s, c: m.cancellation_rate(s, c, 1999), SC, _rate_sql(1999, True))
_ask("d06_repeat_rate", lambda s: m.repeat_rate(s, "2000-01-01", "2001-01-01"), S, _REPEAT_SQL)
_ask("d07_new_customers_in_month", lambda s: m.new_in_period(s, *_MONTH), S, _NEW_SQL)
_ask("d08_international_revenue", lambda s: m.market_revenue(s, 2000, HOME, UNSPECIFIED).select("international_revenue"),
     S, f"SELECT international_revenue FROM ({_MARKET_SQL})")
_ask("d09_large_orders", lambda s: m.large_orders(s, 2000, LARGE), S, _large_sql(2000, LARGE))
_ask("d10_peak_season_share", lambda s: m.peak_season_share(s, 1999), S, _PEAK_SQL)

_ask("k1_active_customers", lambda s: _both(m.active_customers(s, "2000-09-30", 90), m.active_customers(s, "2000-09-30", 180)),
     S, _readings(_active_sql("2000-09-30", 90), _active_sql("2000-09-30", 180)))
def _series_sql(days: int) -> str:
    return f"""
WITH d AS (SELECT DISTINCT customer_id, CAST(invoice_date AS DATE) AS day FROM sales),
c AS (SELECT CAST(unnest(generate_series(low, high + INTERVAL {days} DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(day) AS low, max(day) AS high FROM d)),
a AS (SELECT c.day, count(DISTINCT customer_id) AS active FROM c JOIN d ON d.day <= c.day AND d.day > c.day - {days} GROUP BY c.day),
f AS (SELECT customer_id, min(day) AS day FROM d GROUP BY 1),
e AS (SELECT c.day, count(customer_id) AS ever FROM c LEFT JOIN f ON f.day <= c.day GROUP BY c.day)
SELECT day, coalesce(active, 0) AS active, ever, ever - coalesce(active, 0) AS churned FROM c LEFT JOIN a USING (day) JOIN e USING (day)"""


_ask("k1_active_customers_every_day", lambda s: sweeps.active_series(s, 90), S, _series_sql(90))
_ask("k2_churn_every_day_half_year", lambda s: sweeps.active_series(s, 180), S, _series_sql(180))
_ask("k2_churn", lambda s: _both(m.churn(s, "2000-06-30", 90), m.churn(s, "2000-06-30", 365)), S,
     _readings(_churn_sql("2000-06-30", 90), _churn_sql("2000-06-30", 365)))
_ask("k3_average_order_value",
     lambda s, c: _both(m.average_order_value(s, c, 2000), m.average_order_value(s, c, 2000, net=False)), SC,
     _readings(_aov_sql(2000, True), _aov_sql(2000, False)))
_ask("k4_cancellation_rate",
     lambda s, c: _both(m.cancellation_rate(s, c, 1999), m.cancellation_rate(s, c, 1999, by_value=False)), SC,
     _readings(_rate_sql(1999, True), _rate_sql(1999, False)))
_ask("k5_large_orders", lambda s: _both(m.large_orders(s, 2000, LARGE), m.large_orders(s, 2000, LARGE_BEFORE)), S,
     _readings(_large_sql(2000, LARGE), _large_sql(2000, LARGE_BEFORE)))
_ask("k6_new_and_repeat_customers",
     lambda s: m.beside(m.new_in_period(s, *_MONTH), m.repeat_rate(s, "2000-01-01", "2001-01-01")), S,
     f"SELECT * FROM ({_NEW_SQL}), ({_REPEAT_SQL})")
_ask("k7_market_revenue", lambda s: m.market_revenue(s, 2000, HOME, UNSPECIFIED), S, _MARKET_SQL)
_ask("k8_unit_returns", lambda s, c: m.unit_returns(s, c, 2000), SC, f"""
SELECT units_sold, units_returned, 100.0::DOUBLE * units_returned::DOUBLE / units_sold::DOUBLE AS return_rate_pct
FROM (SELECT CAST(sum(quantity) AS BIGINT) AS units_sold FROM sales WHERE {_year(2000)}),
     (SELECT CAST(-sum(quantity) AS BIGINT) AS units_returned FROM cancellations WHERE {_year(2000)})""")
_ask("k9_peak_season_share", lambda s: m.peak_season_share(s, 1999), S, _PEAK_SQL)

_DEFINITIONS_SQL = """
SELECT source AS term, doc_id, coalesce(toxic, 0) = 1 AS deprecated,
       CASE WHEN lang = 'en' THEN 'metric_definition' ELSE 'faq' END AS doc_type,
       CAST(DATE '2009-01-01' + CAST(n_chars % 1000 AS INTEGER) AS DATE) AS last_updated
FROM documents LEFT JOIN labels USING (doc_id)"""


def definition_documents(ws: Workspace):
    """Documents as competing definitions of the term named by their source."""
    docs = ws.source("documents").select("doc_id", "source", "lang", "n_chars")
    flags = ws.source("labels").select("doc_id", "toxic")
    return docs.join(flags, "doc_id", "left").select(
        F.col("source").alias("term"),
        "doc_id",
        (F.coalesce("toxic", F.lit(0)) == 1).alias("deprecated"),
        F.when(F.col("lang") == "en", "metric_definition").otherwise("faq").alias("doc_type"),
        F.date_add(F.lit("2009-01-01").cast("date"), (F.col("n_chars") % 1000).cast("int")).alias("last_updated"),
    )


@register("k10_definition_precedence", f"""
WITH definitions AS ({_DEFINITIONS_SQL})
SELECT term, doc_id, deprecated, doc_type, last_updated
FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY deprecated, CASE doc_type WHEN 'metric_definition' THEN 0 ELSE 1 END,
                                   last_updated DESC, doc_id) AS place FROM definitions)
WHERE place = 1""")
def k10(ws: Workspace):
    return m.winning_definitions(definition_documents(ws))


