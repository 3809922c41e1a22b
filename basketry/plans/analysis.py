"""Revenue, order-value, concentration and retention analyses over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.ranking import quantiles, row_positions, running_totals


def month_of(column: str = "invoice_date"):
    return F.trunc(F.col(column), "month")


def money(amount, digits: int = 2):
    """A decimal amount rounded half away from zero."""
    return F.round(amount, digits).cast(f"decimal(24,{digits})").cast("double")


def share(part, whole):
    return F.try_divide(100.0 * part.cast("double"), whole.cast("double"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    last_month = sales.agg(F.trunc(F.max("invoice_date"), "month").alias("month")).scalar()
    month = month_of().alias("month")
    # Two grouped counts, each combined before its shuffle, in place of two distinct counts that double the rows.
    orders = sales.groupBy(month, "invoice").agg(F.sum("revenue").alias("revenue")).groupBy("month").agg(
        money(F.sum("revenue")).alias("revenue"), F.count("invoice").alias("orders")
    )
    active = sales.select(month, "customer_id").distinct().groupBy("month").agg(F.count("customer_id").alias("active_customers"))
    return orders.join(active, "month").select("month", "revenue", "orders", "active_customers", (F.col("month") == last_month).alias("is_partial"))


def top_countries(sales: DataFrame, n: int = 10) -> DataFrame:
    by_country = sales.groupBy("country").agg(
        F.sum("revenue").alias("total"), F.count_distinct("customer_id").alias("customers")
    )
    overall = sales.agg(F.sum("revenue").alias("overall")).scalar()
    return (
        by_country.orderBy(F.desc("total"), "country")
        .limit(n)
        .select(
            "country", money(F.col("total")).alias("revenue"), "customers",
            F.round(share(F.col("total"), overall), 2).alias("pct_of_total"),
        )
    )


def leading_countries(sales: DataFrame, n: int) -> DataFrame:
    """The ``n`` countries with the most revenue (n rows, so it may be broadcast)."""
    return (
        sales.groupBy("country").agg(F.sum("revenue").alias("country_revenue"))
        .orderBy(F.desc("country_revenue"), "country").limit(n)
    )


def top_products_per_country(sales: DataFrame, products: DataFrame, countries: int = 5, n: int = 3) -> DataFrame:
    leaders = leading_countries(sales, countries)
    per_product = (
        sales.join(F.broadcast(leaders.select("country")), "country")
        .groupBy("country", "stock_code").agg(F.sum("revenue").alias("total"))
    )
    best_first = Window.partitionBy("country").orderBy(F.desc("total"), "stock_code")
    best = per_product.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= n)
    return best.join(products.select("stock_code", "description"), "stock_code").select(
        "country", F.col("rank").cast("bigint").alias("rank"), "stock_code", "description",
        money(F.col("total")).alias("revenue"),
    )


def customer_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))


def ranked_customers(sales: DataFrame) -> DataFrame:
    return row_positions(customer_revenue(sales), [F.desc("revenue"), "customer_id"], "place")


def revenue_concentration(sales: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Share of revenue of the best ceil(k·n) customers, for each ``{column: k}``."""
    ranked = ranked_customers(sales)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = ranked.withColumn("n", n)
    return counted.agg(
        F.max("n").alias("customers"),
        *[
            F.round(
                share(F.sum(F.when(F.col("place") <= F.ceil(F.lit(k) * F.col("n")), F.col("revenue"))), F.sum("revenue")),
                2,
            ).alias(name)
            for name, k in shares.items()
        ],
    )


def lorenz_curve(sales: DataFrame) -> DataFrame:
    per_customer = customer_revenue(sales)
    ordered = running_totals(per_customer, [F.desc("revenue"), "customer_id"], {"so_far": "revenue"}, "place")
    whole = ordered.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("total")).alias("w")).scalar()
    return ordered.withColumn("w", whole).select(
        "place",
        share(F.col("place"), F.col("w.n")).alias("customer_pct"),
        share(F.col("so_far"), F.col("w.total")).alias("cum_revenue_pct"),
    )


def order_values(sales: DataFrame) -> DataFrame:
    """One row per invoice; its month is the month of its earliest line."""
    return sales.groupBy("invoice").agg(
        F.trunc(F.min("invoice_date"), "month").alias("month"),
        F.sum("revenue").alias("order_value"),
    )


def monthly_order_value(sales: DataFrame) -> DataFrame:
    orders = order_values(sales)
    means = orders.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("order_value").cast("double") / F.count(F.lit(1)), 2).alias("avg_order_value"),
    )
    medians = quantiles(orders, "order_value", {"median_order_value": 0.5}, ["month"])
    return means.join(medians, "month").withColumn("median_order_value", F.round("median_order_value", 2))


def monthly_retention(sales: DataFrame) -> DataFrame:
    """Share of a month's buyers who buy again the next month; the last two months are left out."""
    active = sales.select("customer_id", month_of().alias("month")).distinct()
    before = active.select("customer_id", F.add_months("month", -1).alias("month"), F.lit(1).alias("again"))
    last = sales.agg(F.add_months(F.trunc(F.max("invoice_date"), "month"), -1).alias("m")).scalar()
    return (
        active.filter(F.col("month") < last)
        .join(before, ["customer_id", "month"], "left")
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("active_customers"), F.count("again").alias("retained_next_month"))
        .withColumn(
            "retention_pct",
            F.round(100.0 * F.col("retained_next_month") / F.col("active_customers"), 2),
        )
    )
