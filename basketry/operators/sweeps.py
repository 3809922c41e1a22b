"""Figures as of many dates from one ordering of the facts.

``active_series``: a customer's order day keeps the customer active until ``days`` later or the next order day, whichever
comes first; these spans do not overlap, so +1 where one begins and -1 where it ends add up, over all customers and in
the order of days, to the customers active on every day. The facts are read once, whatever the number of days.

``features_as_of``: what a day adds to a customer (orders, value, products and cancelled invoices met for the first
time) is summed up to running states, one per customer and day with anything new. A cutoff finds the state before it
by the span of cutoffs that each state is the latest for. So a customer's lines are ordered once, and only states are
handed to cutoffs, not a copy of the facts for each.

Windows run over one customer's days or over calendar days; both are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.tiering import orders_of, regularity


def _span_ends(days: DataFrame, length: int) -> DataFrame:
    """Order days (customer_id, day) with ``ends``, the first day that this order day no longer counts for."""
    following = F.lead("day").over(Window.partitionBy("customer_id").orderBy("day"))
    return days.withColumn("ends", F.least(F.date_add("day", length), F.coalesce(following, F.date_add("day", length))))


def active_series(sales: DataFrame, days: int = 90) -> DataFrame:
    """(day, active, ever, churned) for every day from the first order to ``days`` after the last one: customers with an
    order in the last ``days`` days, today included; customers with an order so far; the difference."""
    ordered = sales.select("customer_id", F.to_date("invoice_date").alias("day")).filter("customer_id is not null").distinct()
    spans = _span_ends(ordered, days)
    first = ordered.groupBy("customer_id").agg(F.min("day").alias("day"))
    zero = F.lit(0).cast("long")
    events = (
        spans.groupBy("day").agg(F.count(F.lit(1)).alias("up")).select("day", F.col("up").alias("change"), zero.alias("new"))
        .union(spans.groupBy(F.col("ends").alias("day")).agg(F.count(F.lit(1)).alias("down")).select("day", -F.col("down"), zero))
        .union(first.groupBy("day").agg(F.count(F.lit(1)).alias("new")).select("day", zero, "new"))
    )
    per_day = events.groupBy("day").agg(F.sum("change").alias("change"), F.sum("new").alias("new"))
    ends = ordered.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    calendar = ends.filter("low is not null").select(F.explode(F.sequence("low", F.date_add("high", days))).alias("day"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per calendar day
    filled = calendar.join(per_day, "day", "left")
    series = filled.select(
        "day", F.sum(F.coalesce("change", zero)).over(so_far).alias("active"), F.sum(F.coalesce("new", zero)).over(so_far).alias("ever"))
    return series.withColumn("churned", F.col("ever") - F.col("active"))


def _states(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Per customer and day with anything new the running sums up to that day and the next such day."""
    key = "customer_id"
    day = F.to_date("invoice_date")
    none = F.lit(0).cast("long")
    money = F.lit(0).cast("decimal(38,6)")
    orders = orders_of(sales, [key]).select(key, F.to_date("order_ts").alias("day"), F.lit(1).cast("long").alias("orders"), money.alias("value"), none.alias("products"), none.alias("lost"))
    value = sales.groupBy(key, day.alias("day")).agg(F.sum("revenue").cast("decimal(38,6)").alias("v")).select(key, "day", none, "v", none, none)
    products = sales.groupBy(key, "stock_code").agg(F.min(day).alias("day")).select(key, "day", none, money, F.lit(1).cast("long"), none)
    lost = cancellations.groupBy(key, "invoice").agg(F.min(day).alias("day")).select(key, "day", none, money, none, F.lit(1).cast("long"))
    added = orders.union(value).union(products).union(lost).groupBy(key, "day").agg(*[F.sum(c).alias(c) for c in ("orders", "value", "products", "lost")])

    by_day = Window.partitionBy(key).orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order_day = F.when(F.col("orders") > 0, F.col("day"))
    before = F.last(order_day, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.when(F.col("orders") > 0, F.datediff("day", before)), F.lit(0)).cast("long")
    gaps = added.withColumn("squares", gap * gap).withColumn("order_day", order_day)
    running = [F.sum(c).over(so_far).alias(c) for c in ("orders", "value", "products", "lost", "squares")]
    return gaps.select(
        key, "day", *running, F.min("order_day").over(so_far).alias("first_day"), F.max("order_day").over(so_far).alias("last_day"),
        F.lead("day").over(by_day).alias("next_day"),
    )


def features_as_of(sales: DataFrame, cancellations: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """(cutoff_date, customer_id, features) of every customer with an order before the cutoff, as ``features_at`` gives
    them for one; any number of cutoffs."""
    dates = F.array(*[F.lit(c).cast("date") for c in sorted(set(cutoffs))])
    states = _states(sales, cancellations)
    latest_for = F.filter(dates, lambda c: (c > F.col("day")) & F.coalesce(c <= F.col("next_day"), F.lit(True)))
    found = states.filter("orders > 0").select("*", F.explode(latest_for).alias("cutoff_date"))
    frequency, value = F.col("orders"), F.col("value").cast("double")
    return found.select(
        "cutoff_date", "customer_id", F.datediff("cutoff_date", "last_day").alias("recency"), frequency.alias("frequency"), value.alias("monetary"),
        F.datediff("cutoff_date", "first_day").alias("tenure"), (value / frequency).alias("avg_order_value"), F.col("products").alias("breadth"),
        (F.col("lost").cast("double") / (frequency + F.col("lost"))).alias("cancel_rate"),
        regularity(frequency, F.col("first_day"), F.col("last_day"), F.col("squares")).alias("regularity"),
    )
