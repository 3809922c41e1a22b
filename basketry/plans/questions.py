"""The business questions an analyst asks of the facts, each with its dates and thresholds as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.single import beside
from basketry.operators.ranking import quantiles
from basketry.plans.analysis import (
    customer_revenue,
    leading_countries,
    month_of,
    order_values,
    revenue_concentration,
    share,
)


def between(start: str, end: str) -> Column:
    """The half-open period [start, end) on the invoice date."""
    day = F.col("invoice_date")
    return (day >= F.lit(start).cast("timestamp_ntz")) & (day < F.lit(end).cast("timestamp_ntz"))


def in_year(year: int) -> Column:
    return between(f"{year}-01-01", f"{year + 1}-01-01")


def amount(column: str = "revenue") -> Column:
    return F.sum(column).cast("double")


def sum_when(condition: Column, column: str = "revenue") -> Column:
    return F.sum(F.when(condition, F.col(column)))


def total_revenue(sales: DataFrame) -> DataFrame:
    return sales.agg(amount().alias("revenue"))


def buyer_count(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count_distinct("customer_id").alias("customers"))


def invoice_count(lines: DataFrame, name: str = "orders") -> DataFrame:
    return lines.agg(F.count_distinct("invoice").alias(name))


def sale_span(sales: DataFrame) -> DataFrame:
    return sales.agg(F.min("invoice_date").alias("first_sale"), F.max("invoice_date").alias("last_sale"))


def revenue_by_country(sales: DataFrame, n: int) -> DataFrame:
    return leading_countries(sales, n).select("country", F.col("country_revenue").cast("double").alias("revenue"))


def revenue_by_year(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.year("invoice_date").cast("bigint").alias("year")).agg(amount().alias("revenue"))


def best_products(sales: DataFrame, products: DataFrame, n: int) -> DataFrame:
    best = (
        sales.groupBy("stock_code").agg(F.sum("revenue").alias("total"))
        .orderBy(F.desc("total"), "stock_code").limit(n)
    )
    described = products.select("stock_code", "description").join(F.broadcast(best), "stock_code")  # n rows
    return described.select("stock_code", "description", F.col("total").cast("double").alias("revenue"))


def mean_order_value(sales: DataFrame) -> DataFrame:
    return order_values(sales).agg((amount("order_value") / F.count(F.lit(1))).alias("avg_order_value"))


def best_customers(sales: DataFrame, n: int) -> DataFrame:
    return customer_revenue(sales).orderBy(F.desc("revenue"), "customer_id").limit(n)


def biggest_customer(sales: DataFrame) -> DataFrame:
    return best_customers(sales, 1).withColumn("revenue", F.col("revenue").cast("double"))


def revenue_by_weekday(sales: DataFrame, dates: DataFrame) -> DataFrame:
    per_day = sales.groupBy("date_key").agg(F.sum("revenue").alias("revenue"))
    return per_day.join(dates.select("date_key", "day_name"), "date_key").groupBy("day_name").agg(
        amount().alias("revenue")
    )


def revenue_by_month(sales: DataFrame) -> DataFrame:
    return sales.groupBy(month_of().alias("month")).agg(F.sum("revenue").alias("revenue"))


def revenue_by_month_of(sales: DataFrame, year: int) -> DataFrame:
    return revenue_by_month(sales.filter(in_year(year))).withColumn("revenue", F.col("revenue").cast("double"))


def most_cancelled_country(cancellations: DataFrame) -> DataFrame:
    per = cancellations.groupBy("country").agg((-F.sum("revenue")).alias("value"))
    return per.orderBy(F.desc("value"), "country").limit(1).select(
        "country", F.col("value").cast("double").alias("cancelled_value")
    )


def products_per_order(sales: DataFrame) -> DataFrame:
    pairs = sales.select("invoice", "stock_code").distinct()
    per_order = pairs.groupBy("invoice").agg(F.count(F.lit(1)).alias("n"))
    return per_order.agg((F.sum("n") / F.count(F.lit(1))).alias("avg_products"))


def orders_per_customer(sales: DataFrame) -> DataFrame:
    pairs = sales.select("customer_id", "invoice").distinct()
    return pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))


def one_order_customers(sales: DataFrame) -> DataFrame:
    return orders_per_customer(sales).agg(F.count_if(F.col("orders") == 1).alias("customers"))


def best_month(sales: DataFrame) -> DataFrame:
    return revenue_by_month(sales).orderBy(F.desc("revenue"), "month").limit(1).withColumn(
        "revenue", F.col("revenue").cast("double")
    )


def month_over_month(sales: DataFrame, first: str, last: str) -> DataFrame:
    """% change to the month before; every month is compared before the wanted ones are kept."""
    months = Window.orderBy("month")  # one row per calendar month
    before = F.lag("revenue").over(months)
    change = revenue_by_month(sales).withColumn("pct_change", share(F.col("revenue") - before, before))
    return change.filter(F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(
        "month", "pct_change"
    )


def best_product_of_top_countries(sales: DataFrame, n: int) -> DataFrame:
    leaders = leading_countries(sales, n).select("country")
    totals = sales.join(F.broadcast(leaders), "country").groupBy("country", "stock_code").agg(
        F.sum("revenue").alias("revenue")
    )
    best = F.min(F.struct((-F.col("revenue")).alias("minus"), "stock_code")).alias("best")
    return totals.groupBy("country").agg(best).select(
        "country", "best.stock_code", (-F.col("best.minus")).cast("double").alias("revenue")
    )


def top_share(sales: DataFrame, k: float) -> DataFrame:
    return revenue_concentration(sales, {"pct_of_revenue": k}).select("pct_of_revenue")


def by_two_years(sales: DataFrame, key: str, base: int, later: int) -> DataFrame:
    return sales.filter(in_year(base) | in_year(later)).groupBy(key).agg(
        sum_when(in_year(base)).alias("base"), sum_when(in_year(later)).alias("later")
    )


def customers_spending_less(sales: DataFrame, base: int, later: int) -> DataFrame:
    return by_two_years(sales, "customer_id", base, later).agg(
        F.count_if(F.col("later") < F.col("base")).alias("customers")
    )


def period_change(sales: DataFrame, base: tuple[str, str], later: tuple[str, str]) -> DataFrame:
    both = sales.filter(between(*base) | between(*later)).agg(
        sum_when(between(*base)).alias("base"), sum_when(between(*later)).alias("later")
    )
    return both.select(share(F.col("later") - F.col("base"), F.col("base")).alias("pct_change"))


def buyers(sales: DataFrame, start: str, end: str) -> DataFrame:
    return sales.filter(between(start, end)).select("customer_id").distinct()


def retained_next_year(sales: DataFrame, year: int) -> DataFrame:
    active = sales.filter(in_year(year) | in_year(year + 1)).groupBy("customer_id").agg(
        F.max(in_year(year)).alias("first"), F.max(in_year(year + 1)).alias("second")
    )
    return active.filter("first").agg(
        (100.0 * F.count_if("second") / F.count(F.lit(1))).alias("pct_retained")
    )


def spans_of_best_customers(sales: DataFrame, n: int) -> DataFrame:
    best = best_customers(sales, n).select("customer_id")
    return sales.join(F.broadcast(best), "customer_id", "left_semi").groupBy("customer_id").agg(  # n rows
        F.min("invoice_date").alias("first_purchase"), F.max("invoice_date").alias("last_purchase")
    )


def running_revenue(sales: DataFrame, year: int) -> DataFrame:
    months = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return revenue_by_month(sales.filter(in_year(year))).select(
        "month", F.sum("revenue").over(months).cast("double").alias("cumulative_revenue")
    )


def biggest_product_increase(sales: DataFrame, base: int, later: int, n: int) -> DataFrame:
    grown = by_two_years(sales, "stock_code", base, later).withColumn("increase", F.col("later") - F.col("base"))
    return (
        grown.filter(F.col("increase").isNotNull()).orderBy(F.desc("increase"), "stock_code").limit(n)
        .select("stock_code", F.col("increase").cast("double").alias("increase"))
    )


def median_order_value(sales: DataFrame) -> DataFrame:
    return quantiles(order_values(sales), "order_value", {"median_order_value": 0.5})


def net_revenue(sales: DataFrame, cancellations: DataFrame, year: int) -> DataFrame:
    gross = sales.filter(in_year(year)).agg(F.sum("revenue").alias("gross"))
    back = cancellations.filter(in_year(year)).agg(F.sum("revenue").alias("back"))
    return beside(gross, back).select(
        (F.col("gross") + F.coalesce("back", F.lit(0))).cast("double").alias("net_revenue")
    )


def most_returned_product(cancellations: DataFrame) -> DataFrame:
    per = cancellations.groupBy("stock_code").agg((-F.sum("quantity")).alias("units_returned"))
    return per.orderBy(F.desc("units_returned"), "stock_code").limit(1)


def first_orders(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.min("invoice_date").alias("invoice_date"))


def new_customers(sales: DataFrame, start: str, end: str) -> DataFrame:
    """Customers whose first order ever, over all data, falls in the period."""
    return first_orders(sales).filter(between(start, end)).agg(F.count(F.lit(1)).alias("new_customers"))


def share_from_earlier_buyers(sales: DataFrame, year: int) -> DataFrame:
    spent = sales.filter(in_year(year - 1) | in_year(year)).groupBy("customer_id").agg(
        F.max(in_year(year - 1)).alias("known"), sum_when(in_year(year)).alias("revenue")
    )
    return spent.agg(share(sum_when(F.col("known")), F.sum("revenue")).alias("pct_of_revenue"))


def revenue_per_active_customer(sales: DataFrame, year: int) -> DataFrame:
    per_customer = customer_revenue(sales.filter(in_year(year)))
    return per_customer.agg((amount() / F.count(F.lit(1))).alias("revenue_per_customer"))


def net_by_year(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    year = F.year("invoice_date").cast("bigint").alias("year")
    gross = sales.groupBy(year).agg(F.sum("revenue").alias("gross"))
    back = cancellations.groupBy(year).agg(F.sum("revenue").alias("back"))
    return gross.join(back, "year", "left").select(
        "year", (F.col("gross") + F.coalesce("back", F.lit(0))).cast("double").alias("net_revenue")
    )


def cancelled_share(sales: DataFrame, cancellations: DataFrame, year: int) -> DataFrame:
    gross = sales.filter(in_year(year)).agg(F.sum("revenue").alias("gross"))
    back = cancellations.filter(in_year(year)).agg((-F.sum("revenue")).alias("back"))
    return beside(gross, back).select(share(F.col("back"), F.col("gross")).alias("pct_cancelled"))


def best_net_customers(sales: DataFrame, cancellations: DataFrame, n: int) -> DataFrame:
    back = cancellations.groupBy("customer_id").agg(F.sum("revenue").alias("back"))
    net = customer_revenue(sales).join(back, "customer_id", "left").select(
        "customer_id", (F.col("revenue") + F.coalesce("back", F.lit(0))).alias("net")
    )
    return net.orderBy(F.desc("net"), "customer_id").limit(n).select(
        "customer_id", F.col("net").cast("double").alias("net_revenue")
    )


def best_customers_cancellations(sales: DataFrame, cancellations: DataFrame, n: int) -> DataFrame:
    best = best_customers(sales, n)
    theirs = cancellations.join(F.broadcast(best.select("customer_id")), "customer_id", "left_semi").groupBy(
        "customer_id"
    ).agg(F.count_distinct("invoice").alias("cancelled_invoices"))
    return best.join(theirs, "customer_id", "left").select(
        "customer_id", F.col("revenue").cast("double").alias("revenue"),
        F.coalesce("cancelled_invoices", F.lit(0)).alias("cancelled_invoices"),
    )


def country_orders_and_cancellations(sales: DataFrame, cancellations: DataFrame, country: str) -> DataFrame:
    here = F.col("country") == country
    return beside(invoice_count(sales.filter(here)), invoice_count(cancellations.filter(here), "cancelled_invoices"))


def growing_countries(sales: DataFrame, base: int, later: int, at_least: int, factor: float) -> DataFrame:
    grown = (F.col("base") >= at_least) & (F.col("later") > F.lit(factor).cast("decimal(6,3)") * F.col("base"))
    return by_two_years(sales, "country", base, later).filter(grown).select("country")


def lapsed_between_periods(sales: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    gone = buyers(sales, *first).join(buyers(sales, *second), "customer_id", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("customers"))


def best_month_for_new_customers(sales: DataFrame, year: int) -> DataFrame:
    per_month = first_orders(sales).filter(in_year(year)).groupBy(month_of().alias("month")).agg(
        F.count(F.lit(1)).alias("new_customers")
    )
    return per_month.orderBy(F.desc("new_customers"), "month").limit(1)


def active_in(sales: DataFrame, start: str, end: str) -> DataFrame:
    return buyer_count(sales.filter(between(start, end)))


def order_value_of_busiest_countries(sales: DataFrame, n: int) -> DataFrame:
    orders = sales.groupBy("country", "invoice").agg(F.sum("revenue").alias("order_value"))
    per = orders.groupBy("country").agg(F.count(F.lit(1)).alias("orders"), amount("order_value").alias("total"))
    return per.orderBy(F.desc("orders"), "country").limit(n).select(
        "country", (F.col("total") / F.col("orders")).alias("avg_order_value")
    )
