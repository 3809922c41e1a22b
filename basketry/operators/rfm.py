"""Recency, frequency and monetary quintiles and the customer segments built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.ranking import quantiles, row_positions

# The segments in report order.
SEGMENT_ORDER = ["Champions", "Loyal", "Potential", "At-Risk", "Hibernating", "Lost", "Other"]
_FIFTHS = {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}


def raw_rfm(sales: DataFrame) -> DataFrame:
    """Whole days since the last purchase (snapshot = newest line + 1 day), orders and revenue."""
    newest = sales.agg(F.max("invoice_date").alias("newest")).scalar()
    orders = sales.groupBy("customer_id", "invoice").agg(
        F.max("invoice_date").alias("last"), F.sum("revenue").alias("value")
    )
    per = orders.groupBy("customer_id").agg(
        F.max("last").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("value").alias("monetary")
    )
    snapshot = newest + F.expr("interval 1 day")
    return per.select(
        "customer_id",
        F.timestamp_diff("DAY", F.col("last"), snapshot).alias("recency"),
        "frequency",
        "monetary",
    )


def fifth(value: Column, edges: Column) -> Column:
    """1..5; a value on an edge falls in the lower fifth."""
    bin_no = F.lit(1)
    for edge in _FIFTHS:
        bin_no = bin_no + (value.cast("double") > edges[edge]).cast("int")
    return bin_no


def score_rfm(rfm: DataFrame) -> DataFrame:
    """R and M by interpolated quintile edges, F by quintiles of the rank (ties in customer order)."""
    def edges(column: str) -> Column:
        return quantiles(rfm, column, _FIFTHS).select(F.struct(*_FIFTHS).alias("e")).scalar()

    numbered = row_positions(rfm, ["frequency", "customer_id"], "place")
    n = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = numbered.withColumn("n", n).withColumn(
        "edges", F.struct(edges("recency").alias("r"), edges("monetary").alias("m"))
    )
    by_rank = F.lit(1)
    for k in range(1, 5):
        by_rank = by_rank + (F.col("place") > 1 + F.lit(k) * (F.col("n") - 1) / F.lit(5.0)).cast("int")
    return placed.select(
        "customer_id", "recency", "frequency", "monetary",
        (6 - fifth(F.col("recency"), F.col("edges.r"))).alias("r"),
        by_rank.alias("f"),
        fifth(F.col("monetary"), F.col("edges.m")).alias("m"),
    )


def with_segment(scored: DataFrame) -> DataFrame:
    """The first rule that holds names the segment."""
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    segment = (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 4), "Loyal")
        .when((r >= 4) & (f <= 3), "Potential")
        .when((r <= 2) & (f >= 3), "At-Risk")
        .when((r <= 2) & (f <= 2) & (m >= 3), "Hibernating")
        .when(r <= 2, "Lost")
        .otherwise("Other")
    )
    return scored.withColumn("segment", segment)


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Customers, revenue, shares and means per segment, in report order."""
    sizes = segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"),
        F.sum("recency").alias("recency"), F.sum("frequency").alias("frequency"),
    )
    over_all = Window.partitionBy()  # at most seven rows
    place = F.array_position(F.array(*[F.lit(s) for s in SEGMENT_ORDER]), F.col("segment"))
    return sizes.select(
        place.alias("place"), "segment", "customers",
        F.bround(100.0 * F.col("customers") / F.sum("customers").over(over_all), 1).alias("pct_customers"),
        F.bround("revenue", 0).cast("bigint").alias("revenue"),
        F.bround(100.0 * F.col("revenue").cast("double") / F.sum("revenue").over(over_all).cast("double"), 1).alias("pct_revenue"),
        F.bround(F.col("recency") / F.col("customers"), 0).alias("avg_recency"),
        F.bround(F.col("frequency") / F.col("customers"), 1).alias("avg_frequency"),
    )


def recheck(sales: DataFrame, rfm: DataFrame, n: int = 2, seed: str = "42") -> DataFrame:
    """Recompute the figures of a seeded sample of customers straight from their lines and compare."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("customer_id")))
    sample = rfm.orderBy(draw, "customer_id").limit(n)
    newest = sales.agg(F.max("invoice_date").alias("newest")).scalar()
    lines = sales.join(F.broadcast(sample.select("customer_id")), "customer_id", "left_semi")  # n rows
    again = lines.groupBy("customer_id").agg(
        F.max("invoice_date").alias("last"), F.count_distinct("invoice").alias("frequency_again"),
        F.sum(F.col("quantity") * F.col("price")).alias("monetary_again"),
    )
    days = F.timestamp_diff("DAY", F.col("last"), newest + F.expr("interval 1 day"))
    same = (F.col("recency") == days) & (F.col("frequency") == F.col("frequency_again")) & (
        F.col("monetary") == F.col("monetary_again")
    )
    return sample.join(again, "customer_id").select(
        "customer_id", "recency", "frequency", F.col("monetary").cast("double").alias("monetary"), same.alias("same")
    )
