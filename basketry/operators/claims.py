"""Numbers stated in an answer, checked against the result it reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import as_number, numbers

# Month spellings that make a small number a day of the month.
CALENDAR_WORDS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
QUOTED_DATE = r"'\d{4}-\d{2}-\d{2}[^']*'"
CONSTANT = r"(?U)(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"


def cell_numbers(rows: Column) -> Column:
    """The numbers in a result: numeric cells themselves, and the numbers inside text cells."""
    def of(text: Column) -> Column:
        plain = as_number(text)
        return F.when(plain.isNotNull(), F.array(plain)).otherwise(
            F.coalesce(F.transform(numbers(text), lambda n: n["value"]), F.array().cast("array<double>"))
        )

    return F.flatten(F.transform(F.flatten(rows), of))


def sql_constants(sql: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(sql, F.lit("")), QUOTED_DATE, " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(CONSTANT), F.lit(1)), lambda n: n.cast("double"))


def restates(value: Column, decimals: Column, held: Column) -> Column:
    """Whether a cell equals the number at the precision it was written in (sign and percent forms included)."""
    half_unit = F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double"))
    slack = half_unit + F.when(decimals >= 0, F.lit(1e-9)).otherwise(F.lit(0.0))

    def near(form: Column) -> Column:
        gap = F.abs(form - value)
        relative = F.greatest(F.lit(5e-4) * F.greatest(F.abs(form), F.abs(value)), F.lit(0.005))
        return (gap <= slack) | (gap <= relative)

    return near(held) | near(-held) | near(held * 100) | near(held / 100)


def is_whole(value: Column) -> Column:
    return value == F.floor(value)


def is_calendar(value: Column, raw: Column, text: Column) -> Column:
    """A year, or a day or quarter named next to a calendar word."""
    year = is_whole(value) & value.between(1900, 2100) & ~raw.contains(",") & ~raw.contains("£")
    day = F.when(value.between(1, 31) & is_whole(value), value.cast("int").cast("string")).otherwise("0")
    pattern = F.concat(
        F.lit(f"(?i)({CALENDAR_WORDS})\\.?\\s+"), day, F.lit("\\b|\\b"), day,
        F.lit(f"(st|nd|rd|th)?\\s+(of\\s+)?({CALENDAR_WORDS})|\\bq"), day, F.lit("\\b"),
    )
    dated = is_whole(value) & value.between(1, 31) & ~raw.contains("£") & ~raw.contains("%") & F.regexp_like(text, pattern)
    return year | dated


def with_unsupported(records: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``unsupported``: the numbers of the answer that nothing in the result, question or SQL explains.

    Needs question, sql and result (rows of text cells). Everything is per row; no shuffle.
    """
    prepared = (
        records.withColumn("_claims", numbers(F.col(answer)))
        .withColumn("_cells", cell_numbers(F.col("result")))
        .withColumn("_allowed", F.concat(
            F.array(F.size("result").cast("double")),
            F.transform(numbers(F.col("question")), lambda n: n["value"]),
            sql_constants(F.col("sql")),
        ))
    )

    def unexplained(claim: Column) -> Column:
        value, decimals, raw = claim["value"], claim["decimals"], claim["raw"]
        small = is_whole(value) & value.between(1, 10) & (decimals == 0) & ~raw.rlike("[£$%]")
        known = F.array_contains(F.col("_allowed"), value) | small | is_calendar(value, raw, F.col(answer))
        return ~known & ~F.exists("_cells", lambda held: restates(value, decimals, held))

    found = F.transform(F.filter("_claims", unexplained), lambda c: c["raw"])
    return prepared.withColumn("unsupported", found).drop("_claims", "_cells", "_allowed")


def corrupt(records: DataFrame) -> DataFrame:
    """Change the first digit of the first number that restates a result cell (years are left alone).

    Adds ``original`` and ``corrupted``; both are null where no number restates a cell.
    """
    numeric = F.filter(F.transform(F.flatten("result"), as_number), lambda n: n.isNotNull())

    def headline(claim: Column) -> Column:
        value = claim["value"]
        year = is_whole(value) & value.between(1900, 2100)
        return ~year & F.exists(F.col("_cells"), lambda held: restates(value, claim["decimals"], held))

    prepared = records.withColumn("_cells", numeric).withColumn(
        "original", F.get(F.transform(F.filter(numbers(F.col("answer")), headline), lambda c: c["raw"]), 0)
    )
    digit = F.regexp_extract("original", r"(\d)", 1)
    at = F.expr("locate(regexp_extract(original, '([0-9])', 1), original)")
    changed = F.overlay("original", (digit.cast("int") % 9 + 1).cast("string"), at)
    place = F.expr("locate(original, answer)")
    return prepared.withColumn(
        "corrupted", F.overlay(F.col("answer"), changed, place, F.length("original"))
    ).drop("_cells")


def detection(corrupted: DataFrame) -> DataFrame:
    """How many corrupted answers the number check flags. Distinct answers count once."""
    distinct = corrupted.dropDuplicates(["id", "answer"])
    flagged = with_unsupported(distinct.filter(F.col("corrupted").isNotNull()), "corrupted")
    summary = flagged.agg(
        F.count(F.lit(1)).alias("corrupted"), F.count_if(F.size("unsupported") > 0).alias("detected")
    )
    every = distinct.agg(F.count(F.lit(1)).alias("n")).scalar()
    return summary.select(
        every.alias("distinct_answers"), "corrupted", (every - F.col("corrupted")).alias("skipped"), "detected",
        F.bround(F.try_divide(100.0 * F.col("detected"), F.col("corrupted")), 1).alias("detection_pct"),
    )
