"""Does a recorded result set answer the question? Order-free, tolerant comparison of two small tables.

Both results sit in one row as arrays of text cells, so a whole table of records is graded without a
shuffle: columns are compared as sorted multisets, and reference columns are given answer columns one by
one. Answer columns with the same cells count as one that can be given several times. After each column only
assignments whose rows so far still line up as a multiset go on, and of those that have given the same columns
and brought the rows of both tables into the same order (with the same ties) one goes on for all: what can follow
is the same. So near-equal columns make one assignment per set of columns given, not one per order of giving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import bare_number, bound, trimmed

# Tolerances of two numbers, and the month names.
RELATIVE, ABSOLUTE = 1e-3, 0.01
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]


def cell(text: Column) -> Column:
    """A normalised cell (is_text, number, text): numbers as doubles, dates as ISO text, midnight dropped.

    Cells sort as numbers first, by value, then text.
    """
    # Most cells have no space around them; only the others are worth a replacement.
    bare = F.when(text.rlike(r"(?s)^[!-~](.*[!-~])?\z"), text).otherwise(trimmed(text))

    def plain(bare: Column) -> Column:
        return bound(bare_number(bare), lambda number: F.struct(
            number.isNull().alias("is_text"), F.coalesce(number, F.lit(0.0)).alias("number"),
            F.when(number.isNull(), F.lower(bare)).alias("text"),
        ))

    def day(moment: Column, bare: Column) -> Column:
        midnight = moment == F.date_trunc("day", moment).cast("timestamp_ntz")
        as_written = (F.length(bare) == 10) & (bare >= "0001")
        return F.when(midnight, F.when(as_written, bare).otherwise(F.date_format(moment, "yyyy-MM-dd"))).otherwise(
            F.rtrim(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        )

    def dated(bare: Column) -> Column:
        moment = F.try_to_timestamp(bare).cast("timestamp_ntz")
        return bound(moment, lambda m: F.when(m.isNull(), plain(bare)).otherwise(_text_cell(day(m, bare))))

    return bound(bare, lambda b: F.when(b.rlike(r"^\d{4}-\d{2}-\d{2}"), dated(b)).otherwise(plain(b)))


def close(a: Column, b: Column) -> Column:
    far = F.greatest(F.lit(RELATIVE) * F.greatest(F.abs(a["number"]), F.abs(b["number"])), F.lit(ABSOLUTE))
    numbers = ~a["is_text"] & ~b["is_text"] & (F.abs(a["number"] - b["number"]) <= far)
    return numbers | (a["is_text"] & b["is_text"] & a["text"].eqNullSafe(b["text"]))


def all_close(left: Column, right: Column) -> Column:
    return F.forall(F.zip_with(left, right, close), lambda same: F.coalesce(same, F.lit(False)))


def same_values(left: Column, right: Column) -> Column:
    """Two sorted columns as multisets: compared position by position."""
    ends = F.coalesce(close(F.get(left, F.lit(0)), F.get(right, F.lit(0))), F.lit(False))
    return (F.size(left) == F.size(right)) & ((F.size(left) == 0) | (ends & all_close(left, right)))


def columns_match(left: Column, right: Column) -> Column:
    return same_values(F.sort_array(left), F.sort_array(right))


def _text_cell(text: Column) -> Column:
    return F.struct(F.lit(True).alias("is_text"), F.lit(0.0).alias("number"), F.lower(text).alias("text"))


def _number_cell(number: Column) -> Column:
    return F.struct(F.lit(False).alias("is_text"), number.alias("number"), F.lit(None).cast("string").alias("text"))


def spellings(column: Column, percent: Column) -> Column:
    """Every acceptable way to write a reference column: as it is, as months, or as a fraction of a percentage."""
    is_month = F.forall(column, lambda c: c["is_text"] & F.coalesce(c["text"].rlike(r"^\d{4}-\d{2}-01$"), F.lit(False)))
    month_no = lambda c: F.substring(c["text"], 6, 2).cast("int")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    name = lambda c: F.element_at(names, month_no(c))
    year = lambda c: F.substring(c["text"], 1, 4)
    one_year = F.size(F.array_distinct(F.transform(column, year))) == 1
    months = F.array(
        F.transform(column, lambda c: _text_cell(F.substring(c["text"], 1, 7))),
        F.transform(column, lambda c: _text_cell(F.concat_ws(" ", name(c), year(c)))),
        F.transform(column, lambda c: _text_cell(F.concat_ws(" ", F.substring(name(c), 1, 3), year(c)))),
    )
    same_year = F.array(
        F.transform(column, lambda c: _number_cell(month_no(c).cast("double"))),
        F.transform(column, lambda c: _text_cell(name(c))),
    )
    numeric = F.forall(column, lambda c: ~c["is_text"])
    fractions = F.array(F.transform(column, lambda c: _number_cell(c["number"] / 100)))
    own = F.array(column)
    none = F.slice(own, 1, 0)
    return F.concat(
        own,
        F.when(is_month & (F.size(column) > 0), months).otherwise(none),
        F.when(is_month & (F.size(column) > 0) & one_year, same_year).otherwise(none),
        F.when(percent & numeric, fractions).otherwise(none),
    )


def _columns(rows: Column, width: Column) -> Column:
    numbers = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda j: F.transform(rows, lambda row: F.get(row, j)))


def with_match(records: DataFrame, reference: str, predicted: str, percent: Column) -> DataFrame:
    """Add ``matched``: whether ``predicted`` (rows of text cells) contains the result ``reference``."""
    def cells(name: str) -> Column:
        return F.transform(F.col(name), lambda row: F.transform(row, cell))

    width = lambda rows: F.coalesce(F.size(F.get(F.col(rows), 0)), F.lit(0))
    tables = records.withColumn("_ref", cells(reference)).withColumn("_pred", cells(predicted))
    in_order = lambda columns: F.transform(columns, lambda column: F.sort_array(column))
    split = tables.withColumn("_spell", F.transform(
        _columns(F.col("_ref"), width("_ref")), lambda column: spellings(column, percent)
    )).withColumn("_found", _columns(F.col("_pred"), width("_pred")))
    split = split.withColumns({
        "_spell_sorted": F.transform("_spell", in_order), "_found_sorted": in_order(F.col("_found")),
        # Of each answer column the first one with the same cells.
        "_kind": F.transform("_found", lambda column: (F.array_position(F.col("_found"), column) - 1).cast("int")),
    })
    first_of_kind = F.array_distinct("_kind")

    def options(ways: Column) -> Column:
        """(spelling, answer column) pairs that hold the same values as this reference column."""
        return F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(ways) - 1),
            lambda w: F.transform(
                F.filter(first_of_kind, lambda k: same_values(F.get(ways, w), F.get(F.col("_found_sorted"), k))),
                lambda k: F.struct(w.alias("way"), k.alias("column")),
            ),
        ))

    comparable = (F.size("_ref") == F.size("_pred")) & (F.size("_found") >= F.size("_spell")) & (F.size("_ref") > 0)
    nothing = F.array().cast("array<array<struct<way:int,column:int>>>")
    paired = split.withColumn("_options", F.when(comparable, F.transform("_spell_sorted", options)).otherwise(nothing))
    row_numbers = F.sequence(F.lit(0), F.size("_ref") - 1)

    def wanted(chosen: Column) -> Column:
        return F.transform(row_numbers, lambda i: F.transform(
            chosen, lambda c, j: F.get(F.get(F.get(F.col("_spell"), j), c["way"]), i)
        ))

    def given(chosen: Column) -> Column:
        return F.transform(F.col("_pred"), lambda row: F.transform(chosen, lambda c: F.get(row, c["column"])))

    def lines_up(chosen: Column) -> Column:
        # One column alone is an option because its values are the same ones.
        return (F.size(chosen) == 1) | F.forall(
            F.zip_with(F.sort_array(wanted(chosen)), F.sort_array(given(chosen)), all_close), lambda same: F.coalesce(same, F.lit(False))
        )

    def order(rows: Column) -> Column:
        """The row numbers in sorted order, with a mark before each that differs from the row before."""
        placed = F.array_sort(F.transform(rows, lambda row, i: F.struct(row.alias("row"), i.alias("i"))))
        return F.get(F.transform(F.array(placed), lambda p: F.array_join(F.transform(
            p, lambda x, k: F.concat(F.when(x["row"] == F.get(p, k - 1)["row"], "=").otherwise("<"), x["i"].cast("string"))
        ), "")), F.lit(0))

    def signature(chosen: Column) -> Column:
        columns = F.array_sort(F.transform(chosen, lambda c: c["column"]))
        return F.concat_ws("|", F.array_join(F.transform(columns, lambda c: c.cast("string")), ","), order(wanted(chosen)), order(given(chosen)))

    def merged(states: Column) -> Column:
        def first_of_each(states: Column, signatures: Column) -> Column:
            return F.transform(F.array_distinct(signatures), lambda s: F.get(states, (F.array_position(signatures, s) - 1).cast("int")))

        bound = F.transform(F.array(states), lambda x: F.get(F.transform(F.array(F.transform(x, signature)), lambda g: first_of_each(x, g)), F.lit(0)))
        return F.when(F.size(states) > 1, F.get(bound, F.lit(0))).otherwise(states)

    def is_left(chosen: Column, column: Column) -> Column:
        used = F.size(F.filter(chosen, lambda x: x["column"] == column))
        return used < F.size(F.filter("_kind", lambda kind: kind == column))

    def extend(so_far: Column, choices: Column) -> Column:
        longer = F.flatten(F.transform(so_far, lambda chosen: F.transform(
            F.filter(choices, lambda c: is_left(chosen, c["column"])), lambda c: F.concat(chosen, F.array(c)),
        )))
        return F.get(F.transform(F.array(F.filter(longer, lines_up)), merged), F.lit(0))

    start = F.array(F.array().cast("array<struct<way:int,column:int>>"))
    assigned = paired.withColumn("_assigned", F.aggregate("_options", start, extend))
    both_empty = (F.size("_ref") == 0) & (F.size("_pred") == 0)
    matched = both_empty | (comparable & (F.size("_assigned") > 0))
    return assigned.withColumn("matched", matched).drop(
        "_ref", "_pred", "_spell", "_found", "_spell_sorted", "_found_sorted", "_kind", "_options", "_assigned"
    )
