"""Comparison of two versions of the warehouse: counts, column checksums, totals, countries and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.single import beside
from basketry.operators.star import PRIMARY_KEYS, TABLES, digest_number, measured, table_counts, text_of


def _check(df: DataFrame, kind: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), "name", "left_value", "right_value",
        F.col("left_value").eqNullSafe(F.col("right_value")).alias("match"),
    )


def _side_by_side(left: DataFrame, right: DataFrame, value: str, kind: str) -> DataFrame:
    """(name, value) of both versions in one row per name."""
    both = left.select("name", F.col(value).alias("value"), F.lit(True).alias("is_left")).unionByName(
        right.select("name", F.col(value).alias("value"), F.lit(False).alias("is_left"))
    )
    return _check(both.groupBy("name").agg(
        F.max(F.when(F.col("is_left"), F.col("value"))).alias("left_value"),
        F.max(F.when(~F.col("is_left"), F.col("value"))).alias("right_value"),
    ), kind)


def row_counts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    sides = [
        table_counts(side).select(F.col("table_name").alias("name"), F.col("row_count").cast("string").alias("n"))
        for side in (left, right)
    ]
    return _side_by_side(*sides, "n", "row_count")


def column_digests(df: DataFrame, table: str) -> DataFrame:
    """One keyed, order-free digest per column, all from one scan of the table.

    A row's key is put in text once and every column stands beside it as a row of its own, so that one short expression
    makes all digests. Their 60 bits are added in two halves, as whole numbers (exact up to 2**33 rows).
    """
    key, cell = PRIMARY_KEYS[table], F.col("cell")
    texts = F.array(*[text_of(df, c) for c in df.columns])
    cells = df.select(measured(text_of(df, key)).alias("key"), F.posexplode(texts).alias("place", "cell"))
    numbers = cells.select("place", digest_number(F.concat("key", measured(cell))).alias("n"))
    halves = numbers.groupBy("place").agg(
        F.sum(F.shiftright("n", 30)).alias("high"), F.sum(F.col("n").bitwiseAND(F.lit((1 << 30) - 1))).alias("low")
    )
    total = F.col("high").cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col("low")
    sums = halves.agg(*[
        F.coalesce(F.max(F.when(F.col("place") == i, total.cast("string"))), F.lit("0")).alias(f"c{i}") for i in range(len(df.columns))
    ])
    rows = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("name"), F.col(f"c{i}").alias("digest")) for i, c in enumerate(df.columns)])
    return sums.select(F.inline(rows))


def _all_digests(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for table in TABLES:
        one = column_digests(tables[table], table)
        out = one if out is None else out.unionByName(one)
    return out


def column_checksums(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    return _side_by_side(_all_digests(left), _all_digests(right), "digest", "column_checksum")


def revenue_totals(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    out = None
    for table in ("fact_sales", "fact_cancellations"):
        a = left[table].agg(F.sum("revenue").cast("decimal(24,3)").cast("string").alias("left_value"))
        b = right[table].agg(F.sum("revenue").cast("decimal(24,3)").cast("string").alias("right_value"))
        one = beside(a, b).withColumn("name", F.lit(table))
        out = one if out is None else out.unionByName(one)
    return _check(out, "revenue_total")


def country_drilldown(left: DataFrame, right: DataFrame) -> DataFrame:
    """Countries whose line count differs."""
    a = left.groupBy("country").agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy("country").agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, "country", "full_outer").select(
        "country", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows")
    )
    return both.filter(F.col("left_rows") != F.col("right_rows"))


def tier_transitions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Customers per (left tier, right tier); a customer on one side only is 'missing' on the other."""
    a = left.select("customer_id", F.col("tier").alias("left_tier"))
    b = right.select("customer_id", F.col("tier").alias("right_tier"))
    return a.join(b, "customer_id", "full_outer").groupBy(
        F.coalesce("left_tier", F.lit("missing")).alias("left_tier"),
        F.coalesce("right_tier", F.lit("missing")).alias("right_tier"),
    ).agg(F.count(F.lit(1)).alias("customers"))


def tier_agreement(transitions: DataFrame) -> DataFrame:
    left, right, n = F.col("left_tier"), F.col("right_tier"), F.col("customers")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return transitions.agg(
        total(left != "missing").alias("customers_left"),
        total(right != "missing").alias("customers_right"),
        total(right == "missing").alias("missing_in_right"),
        total(left == "missing").alias("extra_in_right"),
        total((left != "missing") & (right != "missing") & (left != right)).alias("tier_changed"),
        F.bround(100.0 * total(left == right) / F.sum(n), 3).alias("agreement_pct"),
    ).withColumn(
        "match", (F.col("missing_in_right") == 0) & (F.col("extra_in_right") == 0) & (F.col("tier_changed") == 0)
    )


def tier_check(agreement: DataFrame) -> DataFrame:
    return agreement.select(
        F.lit("tiers").alias("kind"), F.lit("customer_tiers").alias("name"),
        F.col("customers_left").cast("string").alias("left_value"),
        F.col("customers_right").cast("string").alias("right_value"), "match",
    )


def warehouse_checks(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    return row_counts(left, right).unionByName(column_checksums(left, right)).unionByName(revenue_totals(left, right))


def parity(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if("match").alias("checks_passed"),
        F.bround(100.0 * F.count_if("match") / F.count(F.lit(1)), 2).alias("parity_pct"),
        F.bool_and("match").alias("pass"),
    )
