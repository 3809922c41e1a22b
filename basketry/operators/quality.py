"""Data-quality checks. Every check is a row (name, status, detail); a FAIL stops a run, a WARN does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketry.functions.single import beside
from basketry.operators.star import PRIMARY_KEYS, table_counts

# The data contract. Raw columns are compared by type family, warehouse columns by exact type.
RAW_CONTRACT = {
    "invoice": "string", "stock_code": "string", "description": "string", "quantity": "integer",
    "invoice_date": "datetime", "price": "decimal", "customer_id": "integer", "country": "string",
}
_FACT_TYPES = {
    "invoice": "string", "invoice_date": "timestamp_ntz", "date_key": "int", "customer_id": "int",
    "stock_code": "string", "country": "string", "quantity": "int", "price": "decimal(12,3)",
    "revenue": "decimal(14,3)",
}
WAREHOUSE_CONTRACT = {
    "dim_date": {
        "date_key": "int", "full_date": "date", "year": "smallint", "quarter": "smallint", "month": "smallint",
        "month_name": "string", "month_start": "date", "day_of_month": "smallint", "day_of_week": "smallint",
        "day_name": "string", "is_weekend": "boolean",
    },
    "dim_customer": {
        "customer_id": "int", "country": "string", "first_invoice_date": "timestamp_ntz",
        "last_invoice_date": "timestamp_ntz",
    },
    "dim_product": {"stock_code": "string", "description": "string", "is_product": "boolean"},
    "fact_sales": {"sales_line_id": "bigint", **_FACT_TYPES},
    "fact_cancellations": {"cancellation_line_id": "bigint", **_FACT_TYPES},
}
KEY_COLUMNS = ["invoice", "invoice_date", "date_key", "customer_id", "stock_code", "quantity", "price"]
FOREIGN_KEYS = {"date_key": "dim_date", "customer_id": "dim_customer", "stock_code": "dim_product"}
FACTS = ["fact_sales", "fact_cancellations"]


class QualityError(RuntimeError):
    """At least one check failed."""


def type_family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.StringType):
        return "string"
    return kind.simpleString()


def _pairs(spark: SparkSession, types: dict[str, str], name: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias(name)) for c, t in types.items()])
    return spark.range(1).select(F.inline(rows))


def contract_diff(df: DataFrame, expected: dict[str, str], families: bool = False) -> DataFrame:
    """Columns that are missing, unexpected or retyped (empty when the contract holds)."""
    actual = {f.name: type_family(f.dataType) if families else f.dataType.simpleString() for f in df.schema.fields}
    spark = df.sparkSession
    both = _pairs(spark, expected, "expected").join(_pairs(spark, actual, "actual"), "column", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn(
        "problem",
        F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("retyped"),
    )


def check(df: DataFrame, name: str | Column, passed: Column, detail: Column, bad: str = "FAIL") -> DataFrame:
    label = F.lit(name) if isinstance(name, str) else name
    return df.select(
        label.alias("check_name"), F.when(passed, "PASS").otherwise(bad).alias("status"), detail.alias("detail")
    )


def number(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def contract_check(problems: DataFrame, name: str, columns: int) -> DataFrame:
    found = problems.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "problem", "column"))), "; ").alias("listed"),
    )  # one entry per column of the contract
    return check(
        found, name, F.col("n") == 0,
        F.when(F.col("n") == 0, F.lit(f"{columns} columns match the contract")).otherwise(F.col("listed")),
    )


def raw_contract_check(raw: DataFrame) -> DataFrame:
    return contract_check(contract_diff(raw, RAW_CONTRACT, families=True), "schema_drift_raw", len(raw.columns))


def warehouse_problems(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        contract_diff(tables[t], types).withColumn("column", F.concat_ws(".", F.lit(t), "column"))
        for t, types in WAREHOUSE_CONTRACT.items()
    ])


def warehouse_contract_check(tables: dict[str, DataFrame]) -> DataFrame:
    columns = sum(len(df.columns) for df in tables.values())
    return contract_check(warehouse_problems(tables), "schema_drift_warehouse", columns)


def fact_checks(name: str, loaded: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Row count, revenue, null keys, sign and freshness of one fact: one scan of it and one of its source.

    Revenue is the exact decimal sum of what was loaded against a floating-point sum of what was cleaned.
    """
    missing = F.lit(False)
    for column in KEY_COLUMNS:
        missing = missing | F.col(column).isNull()
    if name == "fact_sales":
        flawed = (F.col("quantity") <= 0) | (F.col("price") <= 0)
        rule, what = "positive_quantity_price_sales", "lines with a quantity or price of 0 or less"
    else:
        flawed = (F.col("quantity") >= 0) | ~F.col("invoice").startswith("C")
        rule, what = "negative_quantity_cancellations", "lines that are not cancellations"
    here = loaded.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(24,3)").alias("revenue"),
        F.count_if(missing).alias("null_keys"),
        F.count_if(flawed).alias("flawed"),
        F.max("invoice_date").alias("newest"),
    )
    there = cleaned.agg(
        F.count(F.lit(1)).alias("source_rows"),
        # Decimal like the loaded sum, but from quantity and price, so it is exact and still independent.
        F.coalesce(F.sum(F.col("quantity").cast("decimal(12,0)") * F.col("price")), F.lit(0)).cast("decimal(24,3)").alias("source_revenue"),
        F.max("invoice_date").alias("source_newest"),
    )

    def result(check_name: str, passed: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(check_name).alias("check_name"), F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            detail.alias("detail"),
        )

    off = F.abs(F.col("revenue") - F.col("source_revenue"))
    results = [
        result(
            f"row_count_{name}", F.col("rows") == F.col("source_rows"),
            F.concat(F.lit("loaded "), number("rows"), F.lit(" vs "), number("source_rows")),
        ),
        result(
            f"revenue_reconciliation_{name}", off < 0.005,
            F.concat(F.lit("loaded "), number("revenue"), F.lit(" vs cleaned "),
                     number("source_revenue")),
        ),
        result(f"not_null_keys_{name}", F.col("null_keys") == 0, F.concat(number("null_keys"), F.lit(" rows with a null key"))),
        result(rule, F.col("flawed") == 0, F.concat(number("flawed"), F.lit(f" {what}"))),
    ]
    if name == "fact_sales":
        shown = F.date_format("newest", "yyyy-MM-dd HH:mm:ss")
        results.append(result(
            "freshness", F.coalesce(F.col("newest") == F.col("source_newest"), F.lit(False)),
            F.concat(F.lit("newest loaded line "), F.coalesce(shown, F.lit("none"))),
        ))
    return beside(here, there).select(F.inline(F.array(*results)))


def all_fact_checks(tables: dict[str, DataFrame], sources: dict[str, DataFrame]) -> DataFrame:
    return _stack([fact_checks(t, tables[t], sources[t]) for t in FACTS])


def dimension_count_checks(tables: dict[str, DataFrame], sales: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Dimension sizes against those the cleaned lines call for, computed without the loaded tables."""
    keys = ["customer_id", "stock_code", "invoice_date"]
    both = sales.select(*keys).unionByName(cancellations.select(*keys))
    days = both.agg((F.datediff(F.max("invoice_date"), F.min("invoice_date")) + 1).cast("bigint").alias("dim_date"))
    # Each key is counted by itself: two distinct counts in one aggregate would double every fact row.
    customers = both.select("customer_id").distinct().agg(F.count("customer_id").alias("dim_customer"))
    products = both.select("stock_code").distinct().agg(F.count("stock_code").alias("dim_product"))
    due = beside(beside(days, customers), products)
    dimensions = {t: df for t, df in tables.items() if t.startswith("dim_")}
    due_rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.col(t).alias("expected_rows")) for t in dimensions])
    counted = table_counts(dimensions).join(F.broadcast(due.select(F.inline(due_rows))), "table_name")  # one row per table
    return check(
        counted, F.concat(F.lit("row_count_"), "table_name"), F.col("row_count") == F.col("expected_rows"),
        F.concat(F.lit("loaded "), number("row_count"), F.lit(" vs "), number("expected_rows")),
    )


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        tables[t].groupBy(key).agg(F.count(F.lit(1)).alias("rows")).agg(
            F.coalesce(F.sum("rows") - F.count(key), F.lit(0)).alias("repeated")
        ).select(F.lit(t).alias("table_name"), "repeated")
        for t, key in PRIMARY_KEYS.items()
    ])


def unique_keys_check(tables: dict[str, DataFrame]) -> DataFrame:
    total = repeated_keys(tables).agg(F.sum("repeated").alias("n"))
    return check(total, "unique_keys", F.col("n") == 0, F.concat(number("n"), F.lit(" repeated keys")))


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Fact rows whose key is in no dimension. Keys are counted first, so a hot key is one row in the join."""
    found = []
    for fact in FACTS:
        for key, dim in FOREIGN_KEYS.items():
            keys = tables[fact].groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            lost = keys.join(tables[dim].select(key), key, "left_anti")
            found.append(
                lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))
                .select(F.lit(fact).alias("fact"), F.lit(key).alias("key"), "orphans")
            )
    return _stack(found)


def referential_integrity_check(tables: dict[str, DataFrame]) -> DataFrame:
    total = orphans(tables).agg(F.sum("orphans").alias("n"))
    return check(total, "referential_integrity", F.col("n") == 0, F.concat(number("n"), F.lit(" orphan rows")))


def month_coverage(sales: DataFrame) -> DataFrame:
    """Rows and first and last day per month."""
    return sales.groupBy(F.trunc("invoice_date", "month").alias("month")).agg(
        F.to_date(F.min("invoice_date")).alias("first_day"),
        F.to_date(F.max("invoice_date")).alias("last_day"),
        F.count(F.lit(1)).alias("rows"),
    )


def partial_periods(coverage: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Months whose days from first to last cover too little of the calendar month (coverage to 3 places)."""
    covered = F.datediff("last_day", "first_day") + 1
    days = F.day(F.last_day("month"))
    return (
        coverage.withColumn("days_in_month", days).withColumn("days_covered", covered)
        .withColumn("coverage", F.bround(F.col("days_covered") / F.col("days_in_month"), 3))
        .withColumn("partial", F.col("coverage") < at_least)
    )


def volume_anomalies(monthly: DataFrame, order: str = "month", window: int = 6, limit: float = 3.0) -> DataFrame:
    """Periods whose row count is far from the median of the periods before them (at least three)."""
    prior = Window.orderBy(order).rowsBetween(-window, -1)  # one row per calendar month
    judged = (
        monthly.withColumn("history", F.count("rows").over(prior))
        .withColumn("rolling_median", F.percentile("rows", F.lit(0.5)).over(prior))
        .withColumn("rolling_std", F.stddev_samp("rows").over(prior))
    )
    off = F.col("rows") - F.col("rolling_median")
    enough = F.col("history") >= 3
    flat = F.col("rolling_std") == 0
    return judged.select(
        order, "rows",
        F.when(enough, F.col("rolling_median")).alias("rolling_median"),
        F.when(enough, F.col("rolling_std")).alias("rolling_std"),
        F.when(enough & ~flat, off / F.col("rolling_std")).alias("z"),
        F.coalesce(
            F.when(enough, F.when(flat, off != 0).otherwise(F.abs(off / F.nullif("rolling_std", F.lit(0.0))) > limit)),
            F.lit(False),
        ).alias("anomaly"),
    )


def volume_check(sales: DataFrame) -> DataFrame:
    coverage = partial_periods(month_coverage(sales))
    partial = coverage.filter("partial").select(
        F.concat(F.date_format("month", "yyyy-MM"), F.lit(" covers "), number("days_covered"), F.lit(" of "),
                 number("days_in_month"), F.lit(" days")).alias("finding")
    )
    odd = volume_anomalies(coverage.filter("NOT partial")).filter("anomaly").select(
        F.concat(F.date_format("month", "yyyy-MM"), F.lit(" has "), number("rows"), F.lit(" rows")).alias("finding")
    )
    listed = partial.unionByName(odd).agg(F.array_sort(F.collect_list("finding")).alias("findings"))  # per month
    return check(
        listed, "volume_anomaly", F.size("findings") == 0,
        F.when(F.size("findings") == 0, F.lit("no partial or unusual month")).otherwise(F.array_join("findings", "; ")),
        bad="WARN",
    )


def run_checks(
    raw: DataFrame, sales: DataFrame, cancellations: DataFrame, tables: dict[str, DataFrame]
) -> DataFrame:
    """All seventeen checks of one load."""
    sources = {"fact_sales": sales, "fact_cancellations": cancellations}
    return _stack([
        raw_contract_check(raw),
        warehouse_contract_check(tables),
        dimension_count_checks(tables, sales, cancellations),
        all_fact_checks(tables, sources),
        unique_keys_check(tables),
        referential_integrity_check(tables),
        volume_check(tables["fact_sales"]),
    ])


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    ).withColumn("ok", F.col("failed") == 0)


def require_no_failure(checks: DataFrame) -> None:
    """Raise with the failing checks; a check table has a handful of rows."""
    failed = checks.filter(F.col("status") == "FAIL").orderBy("check_name").collect()
    if failed:
        raise QualityError("; ".join(f"{r['check_name']}: {r['detail']}" for r in failed))


def alerts(checks: DataFrame, source: str, run_id: str) -> DataFrame:
    """One alert record per failed check."""
    return checks.filter(F.col("status") == "FAIL").select(
        F.current_timestamp().alias("ts"),
        F.lit("error").alias("severity"),
        F.lit(source).alias("source"),
        F.col("check_name").alias("check"),
        F.col("detail").alias("message"),
        F.lit(run_id).alias("run_id"),
        F.to_json(F.struct("check_name", "status", "detail")).alias("details"),
    )


def alerts_of_run(records: DataFrame, run_id: str) -> DataFrame:
    return records.filter(F.col("run_id") == run_id)

