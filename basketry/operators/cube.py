"""A revenue cube from mergeable states: exact sums, and sketches of distinct customers and of line values.

A state table has one row per base cell (year, country, and the product for sums). States of later loads are added to it
by ``merged``; no cell needs its facts again. The cube's levels are GROUPING SETS over the states: sums add up, sketches
are united. Sums are the same whichever way the facts were split into loads, estimates stay within their error. Facts
are combined before the
shuffle, so a country with a third of all lines is one state per task.

Distinct customers are estimated with a standard error of 1.04 / sqrt(2 ** LG_K), quantiles with a rank error of about
1.65 % at ``KLL_K`` 200; ``checked`` compares both with the facts, within three errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200
CUSTOMER_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 3 * 0.0165

#: Levels of the cube by their columns.
SUM_LEVELS = [["year", "country", "stock_code"], ["year", "country"], ["country", "stock_code"], ["year"], ["country"], ["stock_code"], []]
SKETCH_LEVELS = [["year", "country"], ["year"], ["country"], []]


def _year() -> Column:
    return F.year("invoice_date").alias("year")


def sum_states(sales: DataFrame) -> DataFrame:
    return sales.groupBy(_year(), "country", "stock_code").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"))


def sketch_states(sales: DataFrame) -> DataFrame:
    return sales.groupBy(_year(), "country").agg(
        F.hll_sketch_agg("customer_id", LG_K).alias("customers"), F.kll_sketch_agg_double(F.col("revenue").cast("double"), KLL_K).alias("amounts"))


def _sums() -> list[Column]:
    return [F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines")]


def _unions() -> list[Column]:
    return [F.hll_union_agg("customers").alias("customers"), F.kll_merge_agg_double("amounts", KLL_K).alias("amounts")]


def merged(states: DataFrame, more: DataFrame) -> DataFrame:
    """States of both loads together."""
    keys = [c for c in ("year", "country", "stock_code") if c in states.columns]
    return states.unionByName(more).groupBy(*keys).agg(*(_sums() if "revenue" in states.columns else _unions()))


def _levels(states: DataFrame, levels: list[list[str]], keys: list[str], values: list[Column]) -> DataFrame:
    sets = [[F.col(c) for c in level] for level in levels]
    return states.groupingSets(sets, *keys).agg(F.grouping_id().cast("int").alias("level"), *values)


def revenue_cube(states: DataFrame) -> DataFrame:
    """(year, country, stock_code, level, revenue, lines); a level's bit is set where a column is summed over."""
    return _levels(states, SUM_LEVELS, ["year", "country", "stock_code"], _sums())


def sketch_cube(states: DataFrame) -> DataFrame:
    """(year, country, level, customers, median): estimates from united sketches."""
    cells = _levels(states, SKETCH_LEVELS, ["year", "country"], _unions())
    return cells.select(
        "year", "country", "level", F.hll_sketch_estimate("customers").alias("customers"),
        F.kll_sketch_get_quantile_double("amounts", F.lit(0.5)).alias("median"))


def _cells_of(rows: DataFrame) -> DataFrame:
    """Each row once for every level it is counted in."""
    nothing = F.lit(None)
    year, country = F.col("year"), F.col("country")
    cells = [(0, year, country), (1, year, nothing.cast("string")), (2, nothing.cast("int"), country), (3, nothing.cast("int"), nothing.cast("string"))]
    kinds = F.array(*[F.struct(F.lit(n).alias("level"), y.alias("year"), c.alias("country")) for n, y, c in cells])
    others = [c for c in rows.columns if c not in ("year", "country")]
    return rows.select(*others, F.inline(kinds))


def checked(sales: DataFrame, states: DataFrame) -> DataFrame:
    """(year, country, level, customers, customers_close, median_close): exact distinct customers, and whether the
    estimate and the rank of the estimated median among all line values are within three errors."""
    lines = sales.select(_year(), "country", "customer_id", F.col("revenue").cast("double").alias("amount"))
    keys = ["level", "year", "country"]
    exact = _cells_of(lines.select("year", "country", "customer_id").distinct()).groupBy(*keys, "customer_id").agg(F.lit(1)).groupBy(*keys).agg(
        F.count("customer_id").alias("customers"))
    estimated = sketch_cube(states).withColumnRenamed("customers", "about")
    cells = exact.alias("e").join(estimated.alias("s"), [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).select(
        *[F.col(f"e.{k}").alias(k) for k in keys], "customers", "about", "median")  # a row per cell
    amounts = _cells_of(lines.select("year", "country", "amount").groupBy("year", "country", "amount").agg(F.count(F.lit(1)).alias("n")))
    ranks = amounts.alias("a").join(cells.alias("c"), [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]).groupBy(
        *[F.col(f"c.{k}").alias(k) for k in keys], "c.customers", "c.about").agg(
        (F.sum(F.when(F.col("amount") < F.col("median"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("amount") <= F.col("median"), F.col("n")).otherwise(0)) / F.sum("n")).alias("up_to"))
    return ranks.select(
        "year", "country", "level", "customers",
        (F.abs(F.col("about") - F.col("customers")) <= F.greatest(F.lit(1.0), CUSTOMER_ERROR * F.col("customers"))).alias("customers_close"),
        ((F.col("below") <= 0.5 + RANK_ERROR) & (F.col("up_to") >= 0.5 - RANK_ERROR)).alias("median_close"))
