"""Star schema: calendar, customer and product dimensions and the two line-grain facts."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.cleaning import is_non_product
from basketry.operators.ranking import row_positions

TABLES = ["dim_date", "dim_customer", "dim_product", "fact_sales", "fact_cancellations"]
PRIMARY_KEYS = {
    "dim_date": "date_key",
    "dim_customer": "customer_id",
    "dim_product": "stock_code",
    "fact_sales": "sales_line_id",
    "fact_cancellations": "cancellation_line_id",
}
FACT_COLUMNS = ["invoice_date", "invoice", "stock_code", "customer_id", "country", "quantity", "price", "revenue"]
_COPIES_PER_TASK = 1_000_000


def calendar(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """One row per day between the first and the last transaction on either fact."""
    days = (
        sales.select("invoice_date")
        .unionByName(cancellations.select("invoice_date"))
        .agg(F.to_date(F.min("invoice_date")).alias("first"), F.to_date(F.max("invoice_date")).alias("last"))
        .select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("full_date"))
    )
    day = F.col("full_date")
    weekday = F.weekday(day) + 1
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        day,
        F.year(day).cast("smallint").alias("year"),
        F.quarter(day).cast("smallint").alias("quarter"),
        F.month(day).cast("smallint").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.trunc(day, "month").alias("month_start"),
        F.day(day).cast("smallint").alias("day_of_month"),
        weekday.cast("smallint").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        (weekday >= 6).alias("is_weekend"),
    )


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null ``value`` per ``key``; ties go to the smallest value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("value")))
    return counted.groupBy(key).agg(best.alias("best")).select(key, F.col("best.value").alias(value))


def customers(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Every customer on either fact, with home country and the first and last sale."""
    seen = sales.select("customer_id", "country").unionByName(cancellations.select("customer_id", "country"))
    everyone = seen.select("customer_id").distinct()
    spans = sales.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_invoice_date"), F.max("invoice_date").alias("last_invoice_date")
    )
    return (
        everyone.join(most_frequent(seen, "customer_id", "country"), "customer_id", "left")
        .join(spans, "customer_id", "left")
        .select("customer_id", "country", "first_invoice_date", "last_invoice_date")
    )


def products(sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Every code on either fact; the description seen on sales wins over the one on cancellations."""
    codes = sales.select("stock_code").unionByName(cancellations.select("stock_code")).distinct()
    sold = most_frequent(sales, "stock_code", "description").withColumnRenamed("description", "sold_as")
    returned = most_frequent(cancellations, "stock_code", "description").withColumnRenamed("description", "returned_as")
    return (
        codes.join(sold, "stock_code", "left")
        .join(returned, "stock_code", "left")
        .select(
            "stock_code",
            F.coalesce("sold_as", "returned_as").alias("description"),
            (~is_non_product(F.col("stock_code"))).alias("is_product"),
        )
    )


def fact(lines: DataFrame, line_id: str) -> DataFrame:
    """Line-grain fact with line ids 1..n in the order of its columns.

    Identical lines are interchangeable, so they need no counting. Each line has the number of the bounded piece of the
    input that it is read in, last in the order: the copies of a line that repeats very often are spread over slices
    like different lines, and the ordering is the only shuffle.
    """
    piece = F.expr(f"monotonically_increasing_id() div {_COPIES_PER_TASK}")
    numbered = row_positions(lines.select(*FACT_COLUMNS, piece.alias("piece")), [*FACT_COLUMNS, "piece"], line_id)
    return numbered.select(
        F.col(line_id).cast("bigint").alias(line_id),
        "invoice",
        "invoice_date",
        F.date_format("invoice_date", "yyyyMMdd").cast("int").alias("date_key"),
        "customer_id",
        "stock_code",
        "country",
        "quantity",
        "price",
        "revenue",
    )


def build_star(sales: DataFrame, cancellations: DataFrame) -> dict[str, DataFrame]:
    with ThreadPoolExecutor(max_workers=2) as jobs:  # ordering a fact runs a job of its own
        facts = jobs.submit(fact, sales, "sales_line_id"), jobs.submit(fact, cancellations, "cancellation_line_id")
    return {
        "dim_date": calendar(sales, cancellations),
        "dim_customer": customers(sales, cancellations),
        "dim_product": products(sales, cancellations),
        "fact_sales": facts[0].result(),
        "fact_cancellations": facts[1].result(),
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def text_of(df: DataFrame, column: str):
    """A column as text that is the same on every engine and run; nulls are marked."""
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    if kind.startswith("timestamp"):
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(value.cast("string"), F.lit("<null>"))


def measured(part) -> Column:
    """A part of a digested row: its text after its length, so that no two lists of parts read alike."""
    return F.concat(F.length(part).cast("string"), F.lit(":"), part)


def digest_number(text) -> Column:
    """The first 60 bits of a text's md5 as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_digest(parts: Sequence):
    """A 60-bit number from the md5 of the measured parts; sums of it do not depend on row order."""
    return digest_number(F.concat(*[measured(p) for p in parts])).cast("decimal(20,0)")


def table_digest(df: DataFrame, name: str) -> DataFrame:
    digest = row_digest([text_of(df, c) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("digest")
    ).select(F.lit(name).alias("table_name"), "row_count", "digest")


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = table_digest(df, name)
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One md5 for the content of all tables (the list below holds one entry per table)."""
    entries = table_digests(tables).agg(F.array_sort(F.collect_list(F.concat_ws(":", "table_name", "row_count", "digest"))).alias("e"))
    return entries.select(F.md5(F.array_join("e", "|")).alias("fingerprint"))
