"""Modelled marts over the star schema and the declarative tests on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.star import most_frequent



def _staged(fact: DataFrame, line_id: str) -> DataFrame:
    return fact.select(
        line_id,
        F.col("invoice").alias("invoice_id"),
        F.col("invoice_date").alias("invoiced_at"),
        "date_key",
        "customer_id",
        F.col("stock_code").alias("product_code"),
        "country",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("price").cast("decimal(12,3)").alias("unit_price"),
        F.col("revenue").cast("decimal(14,3)").alias("revenue"),
    )


def stg_sales(fact_sales: DataFrame) -> DataFrame:
    return _staged(fact_sales, "sales_line_id")


def stg_cancellations(fact_cancellations: DataFrame) -> DataFrame:
    return _staged(fact_cancellations, "cancellation_line_id")


def stg_products(dim_product: DataFrame) -> DataFrame:
    return dim_product.select(F.col("stock_code").alias("product_code"), "description", "is_product")


def stg_dates(dim_date: DataFrame) -> DataFrame:
    whole = ["year", "quarter", "month", "day_of_month", "day_of_week"]
    return dim_date.select(*[F.col(c).cast("int").alias(c) if c in whole else F.col(c) for c in dim_date.columns])


def fct_sales(staged: DataFrame) -> DataFrame:
    return staged


def fct_cancellations(staged: DataFrame) -> DataFrame:
    return staged


def dim_customer(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Every customer with home country and lifetime figures (zeros for customers who only cancelled)."""
    lines = sales.select("customer_id", "country").unionByName(cancellations.select("customer_id", "country"))
    # Invoice grain first: the distinct count per customer then needs no second pass over the lines.
    invoices = sales.groupBy("customer_id", "invoice_id").agg(
        F.min("invoiced_at").alias("first"), F.max("invoiced_at").alias("last"), F.sum("revenue").alias("value")
    )
    lifetime = invoices.groupBy("customer_id").agg(
        F.min("first").alias("first_purchase_at"),
        F.max("last").alias("last_purchase_at"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("value").alias("revenue"),
    )
    return most_frequent(lines, "customer_id", "country").join(lifetime, "customer_id", "left").select(
        "customer_id", "country", "first_purchase_at", "last_purchase_at",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("revenue", F.lit(0)).cast("decimal(24,3)").alias("lifetime_revenue"),
    )


def dim_product(products: DataFrame, sales: DataFrame) -> DataFrame:
    sold = sales.groupBy("product_code").agg(
        F.sum("quantity").alias("units"), F.sum("revenue").alias("value"),
        F.min("invoiced_at").alias("first_sold_at"), F.max("invoiced_at").alias("last_sold_at"),
    )
    return products.join(sold, "product_code", "left").select(
        "product_code", "description", "is_product",
        F.coalesce("units", F.lit(0)).alias("units_sold"),
        F.coalesce("value", F.lit(0)).cast("decimal(24,3)").alias("revenue"),
        "first_sold_at", "last_sold_at",
    )


def dim_date(staged: DataFrame) -> DataFrame:
    return staged


# ---- declarative tests: each yields one row (test, model, subject, failures) -------------------------


def _result(df: DataFrame, test: str, model: str, subject: str) -> DataFrame:
    return df.select(
        F.lit(test).alias("test"), F.lit(model).alias("model"), F.lit(subject).alias("subject"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
    )


def unique_test(df: DataFrame, model: str, columns: Sequence[str], test: str = "unique") -> DataFrame:
    """Values (or combinations) that occur more than once."""
    keyed = df
    for column in columns:
        keyed = keyed.filter(F.col(column).isNotNull())
    repeated = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("failures"))
    return _result(repeated, test, model, "+".join(columns))


def column_tests(df: DataFrame, model: str, not_null: Sequence[str], accepted: dict[str, list] | None = None) -> DataFrame:
    """All not_null and accepted_values tests of a model in one scan."""
    tests: list[tuple[str, str, Column]] = [("not_null", c, F.col(c).isNull()) for c in not_null]
    tests += [("accepted_values", c, ~F.col(c).isin(values)) for c, values in (accepted or {}).items()]
    counted = df.agg(*[F.count_if(flawed).alias(f"t{i}") for i, (_, _, flawed) in enumerate(tests)])
    rows = F.array(*[
        F.struct(F.lit(t).alias("test"), F.lit(model).alias("model"), F.lit(c).alias("subject"), F.col(f"t{i}").alias("failures"))
        for i, (t, c, _) in enumerate(tests)
    ])
    return counted.select(F.inline(rows))


def relationship_test(df: DataFrame, model: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent; equal keys are counted before the join."""
    keys = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    lost = keys.join(parent.select(key), key, "left_anti").agg(F.sum("n").alias("failures"))
    return _result(lost, "relationships", model, column)


def revenue_mismatches(source: DataFrame, mart: DataFrame) -> DataFrame:
    """Months, and the total (month null), whose revenue differs between the fact and the mart."""
    by_source = source.groupBy(F.trunc("invoice_date", "month").alias("month")).agg(F.sum("revenue").alias("source_revenue"))
    by_mart = mart.groupBy(F.trunc("invoiced_at", "month").alias("month")).agg(F.sum("revenue").alias("mart_revenue"))
    months = by_source.join(by_mart, "month", "full_outer")
    total = months.agg(F.sum("source_revenue").alias("source_revenue"), F.sum("mart_revenue").alias("mart_revenue"))
    rows = months.unionByName(total.select(F.lit(None).cast("date").alias("month"), "source_revenue", "mart_revenue"))
    off = F.abs(F.col("source_revenue") - F.col("mart_revenue")) >= F.lit("0.005").cast("decimal(4,3)")
    return rows.filter(F.col("source_revenue").isNull() | F.col("mart_revenue").isNull() | off)


def future_lines(sales: DataFrame, cancellations: DataFrame, now: str) -> DataFrame:
    """Lines dated after the given moment."""
    late = F.col("invoiced_at") > F.lit(now).cast("timestamp_ntz")
    return sales.filter(late).select(
        F.lit("sales").alias("fact"), F.col("sales_line_id").alias("line_id"), "invoiced_at"
    ).unionByName(cancellations.filter(late).select(
        F.lit("cancellations").alias("fact"), F.col("cancellation_line_id").alias("line_id"), "invoiced_at"
    ))


def tier_share_deviations(tiers: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Tiers whose size is off its share by more than one customer, or that are empty."""
    sizes = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = tiers.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(s).alias("share")) for t, s in shares.items()])
    expected = tiers.sparkSession.range(1).select(F.inline(wanted))
    both = expected.join(sizes, "tier", "left").withColumn("total", total)
    return both.filter(F.col("n").isNull() | (F.abs(F.col("n") - F.col("share") * F.col("total")) > 1))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Passed and failed tests per kind."""
    status = F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status")
    return results.groupBy("test", status).agg(F.count(F.lit(1)).alias("tests"))
