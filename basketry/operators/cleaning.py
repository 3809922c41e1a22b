"""Cleaning rules for raw invoice lines; every rule sees the rows the earlier rules left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.single import beside
from basketry.session import durable
from basketry.sources.retail import RAW_COLUMNS

# Stock codes of fees, postage and bookkeeping entries, and the prefixes of such codes.
NON_PRODUCT_CODES = ["POST", "DOT", "M", "D", "C2", "BANK CHARGES", "AMAZONFEE", "PADS", "CRUK", "S", "B"]
NON_PRODUCT_PREFIXES = ["ADJUST", "TEST", "GIFT_"]

# Repeated lines whose hashes are handed to every task; more of them are joined by shuffles.
BROADCAST_HASHES = 1_000_000

# The steps of the cleaning log, in order.
STEPS = [
    "drop_null_customer_id",
    "separate_cancellations",
    "drop_nonpositive_qty_price",
    "drop_exact_duplicates",
    "drop_non_product_codes",
]


def is_non_product(code: Column) -> Column:
    upper = F.upper(code)
    hit = upper.isin(NON_PRODUCT_CODES)
    for prefix in NON_PRODUCT_PREFIXES:
        hit = hit | upper.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def is_cancellation() -> Column:
    return F.coalesce(F.col("invoice").startswith("C"), F.lit(False))


def is_positive() -> Column:
    return F.coalesce((F.col("quantity") > 0) & (F.col("price") > 0), F.lit(False))


def with_customer(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("customer_id").isNotNull())


def split_cancellations(attributed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales candidates, cancellations); cancellations are neither de-duplicated nor price filtered."""
    return attributed.filter(~is_cancellation()), attributed.filter(is_cancellation())


def positive_lines(candidates: DataFrame) -> DataFrame:
    return candidates.filter(is_positive())


def without_duplicates(lines: DataFrame) -> DataFrame:
    """Distinct lines. Only lines whose 64-bit hash occurs more than once are grouped as they are; the others, nearly
    all, are shuffled as their hash alone."""
    hashed = lines.withColumn("_hash", F.xxhash64(*lines.columns))
    again = durable(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_lines")).filter("_lines > 1").select("_hash"))
    if again.count() <= BROADCAST_HASHES:
        again = F.broadcast(again)
    once = hashed.join(again, "_hash", "left_anti").drop("_hash")
    return once.unionByName(hashed.join(again, "_hash", "left_semi").drop("_hash").dropDuplicates())


def products_only(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_non_product(F.col("stock_code")))


def with_revenue(lines: DataFrame) -> DataFrame:
    return lines.withColumn("customer_id", F.col("customer_id").cast("int")).withColumn(
        "revenue", (F.col("quantity") * F.col("price")).cast("decimal(14,3)")
    )


def clean(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales, cancellations), both with revenue. The code filter commutes with de-duplication, so it runs
    first here and the shuffle of ``dropDuplicates`` carries fewer rows."""
    candidates, cancellations = split_cancellations(with_customer(raw))
    sales = without_duplicates(products_only(positive_lines(candidates)))
    return with_revenue(sales), with_revenue(cancellations)


def cleaning_log(raw: DataFrame) -> DataFrame:
    """Rows before and after each step: one cheap scan for the row rules, one grouping for the rest."""
    rule = (
        F.when(F.col("customer_id").isNull(), 0).when(is_cancellation(), 1).when(~is_positive(), 2).otherwise(3)
    )
    by_rule = raw.groupBy(rule.alias("step_no")).agg(F.count(F.lit(1)).alias("rows"))
    removed_by_row = by_rule.filter("step_no < 3").select("step_no", F.col("rows").alias("removed"))
    survivors = (
        raw.filter(rule == 3)
        .groupBy(*RAW_COLUMNS)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated"),
            F.count_if(is_non_product(F.col("stock_code"))).alias("non_product"),
            F.count_if(~is_non_product(F.col("stock_code"))).alias("kept"),
        )
    )
    later = survivors.select(F.inline(F.array(
        F.struct(F.lit(3).alias("step_no"), F.col("repeated").alias("removed")),
        F.struct(F.lit(4).alias("step_no"), F.col("non_product").alias("removed")),
        F.struct(F.lit(5).alias("step_no"), F.col("kept").alias("removed")),
    )))
    names = F.array(*[F.lit(s) for s in STEPS])
    every = raw.sparkSession.range(6).select(F.col("id").cast("int").alias("step_no"))
    counted = every.join(F.broadcast(removed_by_row.unionByName(later)), "step_no", "left").select(
        "step_no", F.coalesce("removed", F.lit(0)).alias("removed")
    )
    # Six rows: what is left before a step is everything this and the later steps remove or keep.
    onwards = Window.orderBy("step_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = counted.withColumn("rows_before", F.sum("removed").over(onwards)).filter("step_no < 5")
    return before.select(
        F.element_at(names, F.col("step_no") + 1).alias("step"),
        "rows_before",
        (F.col("rows_before") - F.col("removed")).alias("rows_after"),
        "removed",
        F.coalesce(
            F.bround(F.try_divide(F.lit(100.0) * F.col("removed"), F.col("rows_before")), 2), F.lit(0.0)
        ).alias("pct_removed"),
        F.element_at(F.array(
            F.lit("no customer to attribute revenue to"),
            F.lit("cancelled invoice, kept apart"),
            F.lit("quantity or price is not positive"),
            F.lit("line logged more than once"),
            F.lit("fee, postage, adjustment or test code"),
        ), F.col("step_no") + 1).alias("reason"),
    )


def cancellation_rates(raw: DataFrame) -> DataFrame:
    """Cancelled share by distinct invoice and by value, on rows that have a customer."""
    value = F.col("quantity") * F.col("price")
    per_invoice = with_customer(raw).groupBy("invoice").agg(
        F.sum(F.when(is_cancellation(), -value)).alias("cancelled"),
        F.sum(F.when(~is_cancellation() & (value > 0), value)).alias("gross"),
    )
    totals = per_invoice.agg(
        F.count_if(is_cancellation()).alias("cancelled_invoices"),
        F.count("invoice").alias("total_invoices"),
        F.coalesce(F.sum("cancelled"), F.lit(0)).cast("double").alias("cancelled_revenue"),
        F.coalesce(F.sum("gross"), F.lit(0)).cast("double").alias("gross_revenue"),
    )
    return totals.select(
        "cancelled_invoices",
        "total_invoices",
        F.bround(F.try_divide(100.0 * F.col("cancelled_invoices"), F.col("total_invoices")), 2).alias(
            "cancel_rate_by_invoices_pct"
        ),
        F.bround("cancelled_revenue", 2).alias("cancelled_revenue"),
        F.bround("gross_revenue", 2).alias("gross_revenue"),
        F.bround(F.try_divide(100.0 * F.col("cancelled_revenue"), F.col("gross_revenue")), 2).alias(
            "cancel_rate_by_revenue_pct"
        ),
    )


def dropped_codes(raw: DataFrame) -> DataFrame:
    """Rows per non-product code among the distinct rows that passed the earlier rules."""
    candidates, _ = split_cancellations(with_customer(raw))
    dropped = positive_lines(candidates).filter(is_non_product(F.col("stock_code")))
    return without_duplicates(dropped).groupBy("stock_code").agg(F.count(F.lit(1)).alias("rows_dropped"))


def inject_fault(sales: DataFrame, fault: str, argument: str) -> DataFrame:
    """A known regression for the checks to find: one country missing, or the first lines' prices negated."""
    if fault == "drop_country":
        return sales.filter(F.col("country") != argument)
    if fault == "negative_price":
        flipped = F.when(F.col("sales_line_id") <= int(argument), -F.col("price")).otherwise(F.col("price"))
        return sales.withColumn("price", flipped.cast("decimal(12,3)")).withColumn(
            "revenue", (F.col("quantity") * F.col("price")).cast("decimal(14,3)")
        )
    raise ValueError(f"unknown fault {fault!r}")


def cleaning_summary(raw: DataFrame, sales: DataFrame) -> DataFrame:
    """Totals of the cleaned lines with the assertions a cleaning run must satisfy."""
    source = raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.min("invoice_date").alias("raw_first"),
        F.max("invoice_date").alias("raw_last"),
    )
    any_null = F.lit(False)
    for column in ["invoice", "stock_code", "quantity", "invoice_date", "price", "customer_id", "country", "revenue"]:
        any_null = any_null | F.col(column).isNull()
    cleaned = sales.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.count_if(any_null).alias("null_keys"),
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
    )
    for column, name in (("customer_id", "customers"), ("invoice", "invoices"), ("stock_code", "products"), ("country", "countries")):
        cleaned = beside(cleaned, sales.select(column).distinct().agg(F.count(column).alias(name)))
    removed = 100.0 * (F.col("raw_rows") - F.col("clean_rows")) / F.col("raw_rows")
    return beside(source, cleaned).select(
        "raw_rows", "clean_rows", F.bround(removed, 2).alias("pct_removed"),
        "customers", "invoices", "products", "countries", "revenue",
        ((removed >= 15) & (removed <= 35)).alias("removed_in_range"),
        (F.col("null_keys") == 0).alias("no_null_keys"),
        (
            (F.to_date("first") == F.to_date("raw_first")) & (F.to_date("last") == F.to_date("raw_last"))
        ).alias("date_span_kept"),
    )
