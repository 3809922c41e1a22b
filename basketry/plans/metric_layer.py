"""Metrics whose definition has changed over time; window, threshold and basis are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.single import beside
from basketry.plans.analysis import order_values, share
from basketry.plans.questions import between, first_orders, in_year, orders_per_customer, sum_when


def day_after(as_of: str) -> Column:
    return F.date_add(F.lit(as_of).cast("date"), 1)


def window_start(as_of: str, days: int) -> Column:
    return F.date_sub(day_after(as_of), days).cast("timestamp_ntz")


def until(as_of: str) -> Column:
    return F.col("invoice_date") < day_after(as_of).cast("timestamp_ntz")


def active_customers(sales: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    recent = sales.filter(until(as_of) & (F.col("invoice_date") >= window_start(as_of, days)))
    return recent.agg(F.count_distinct("customer_id").alias("active_customers"))


def churn(sales: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Active and churned customers as of a date: together, everyone who ever ordered."""
    last = sales.filter(until(as_of)).groupBy("customer_id").agg(F.max("invoice_date").alias("last_order"))
    gone = F.col("last_order") < window_start(as_of, days)
    return last.agg(
        F.count_if(gone).alias("churned"),
        F.count_if(~gone).alias("active"),
        F.try_divide(100.0 * F.count_if(gone), F.count(F.lit(1))).alias("churn_rate_pct"),
    )


def average_order_value(sales: DataFrame, cancellations: DataFrame, year: int, net: bool = True) -> DataFrame:
    sold = sales.filter(in_year(year)).agg(
        F.sum("revenue").alias("gross"), F.count_distinct("invoice").alias("orders")
    )
    if not net:
        return sold.select((F.col("gross").cast("double") / F.col("orders")).alias("average_order_value"))
    back = cancellations.filter(in_year(year)).agg(F.sum("revenue").alias("back"))
    total = (F.col("gross") + F.coalesce("back", F.lit(0))).cast("double")
    return beside(sold, back).select((total / F.col("orders")).alias("average_order_value"))


def cancellation_rate(sales: DataFrame, cancellations: DataFrame, year: int, by_value: bool = True) -> DataFrame:
    measure = F.sum("revenue") if by_value else F.count_distinct("invoice")
    sold = sales.filter(in_year(year)).agg(measure.alias("sold"))
    back = cancellations.filter(in_year(year)).agg(measure.alias("back"))
    if by_value:
        rate = share(-F.col("back"), F.col("sold"))
    else:
        rate = share(F.col("back"), F.col("sold") + F.col("back"))
    return beside(sold, back).select(rate.alias("cancellation_rate_pct"))


def large_orders(sales: DataFrame, year: int, threshold: int) -> DataFrame:
    values = order_values(sales.filter(in_year(year)))
    return values.agg(F.count_if(F.col("order_value") >= threshold).alias("large_orders"))


def new_in_period(sales: DataFrame, start: str, end: str) -> DataFrame:
    return first_orders(sales).filter(between(start, end)).agg(F.count(F.lit(1)).alias("new_customers"))


def repeat_rate(sales: DataFrame, start: str, end: str) -> DataFrame:
    per_customer = orders_per_customer(sales.filter(between(start, end)))
    return per_customer.agg(
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        F.try_divide(100.0 * F.count_if(F.col("orders") >= 2), F.count(F.lit(1))).alias("repeat_rate_pct"),
    )


def market_revenue(sales: DataFrame, year: int, home: str, unspecified: str) -> DataFrame:
    """Home market and the rest; lines of an unspecified market belong to neither."""
    country = F.col("country")
    return sales.filter(in_year(year)).agg(
        sum_when(country == home).cast("double").alias("domestic_revenue"),
        sum_when(~country.isin(home, unspecified)).cast("double").alias("international_revenue"),
    )


def unit_returns(sales: DataFrame, cancellations: DataFrame, year: int) -> DataFrame:
    sold = sales.filter(in_year(year)).agg(F.sum("quantity").alias("units_sold"))
    back = cancellations.filter(in_year(year)).agg((-F.sum("quantity")).alias("units_returned"))
    return beside(sold, back).select(
        "units_sold", "units_returned", share(F.col("units_returned"), F.col("units_sold")).alias("return_rate_pct")
    )


def peak_season_share(sales: DataFrame, year: int, months: tuple[int, ...] = (9, 10, 11)) -> DataFrame:
    peak = F.month("invoice_date").isin(*months)
    return sales.filter(in_year(year)).agg(share(sum_when(peak), F.sum("revenue")).alias("peak_season_pct"))


def winning_definitions(documents: DataFrame) -> DataFrame:
    """Per term: documents in force before deprecated ones, metric definitions before FAQs, later before earlier."""
    rank = F.struct(
        "deprecated",
        F.when(F.col("doc_type") == "metric_definition", 0).otherwise(1).alias("type_rank"),
        F.datediff(F.lit("2200-01-01").cast("date"), "last_updated").alias("age"),
        "doc_id",
    )
    best = documents.groupBy("term").agg(F.min_by(F.struct(*documents.columns), rank).alias("best"))
    return best.select("best.*")
