"""Global order at scale: positions, running totals, tie ranks and exact quantiles without one-task windows.

Rows are range partitioned and sorted on the order columns, and the layout is written to the shared
folder once. Each row then knows its slice and its place in the slice; the rows of earlier slices are
added from a table with one line per slice. Equal values are counted before they are ordered, so a
value held by a third of all rows is one row here and never overloads a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import durable

_AT = "_at"
_SLICE = "_slice"
_ROWS_PER_SLICE = 1 << 33  # monotonically_increasing_id keeps the partition in the bits above this


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _laid_out(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    keys = _columns(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    return durable(placed).withColumn(_SLICE, F.shiftright(_AT, 33))


def _with_offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Join, per slice, the totals of all earlier slices (one row per slice, so the broadcast is bounded)."""
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = placed.groupBy(_SLICE).agg(*[expr.alias(name) for name, expr in totals.items()])
    offsets = per_slice.select(_SLICE, *[F.sum(name).over(earlier).alias(name) for name in totals])
    return placed.join(F.broadcast(offsets), _SLICE, "left")


def row_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number all rows 1..n in the given total order."""
    placed = _with_offsets(_laid_out(df, order), {"_rows": F.count(F.lit(1))})
    here = F.col(_AT) % F.lit(_ROWS_PER_SLICE) + 1
    return placed.withColumn(name, F.coalesce("_rows", F.lit(0)) + here).drop(_AT, _SLICE, "_rows")


def running_totals(
    df: DataFrame, order: Sequence[str | Column], weights: dict[str, str], position: str | None = None
) -> DataFrame:
    """Add inclusive running sums ``{new column: weight column}`` in the given total order."""
    placed = _laid_out(df, order)
    totals = {f"_sum_{name}": F.sum(weight) for name, weight in weights.items()}
    totals["_rows"] = F.count(F.lit(1))
    shifted = _with_offsets(placed, totals)
    so_far = Window.partitionBy(_SLICE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = shifted
    for name, weight in weights.items():
        out = out.withColumn(name, F.sum(weight).over(so_far) + F.coalesce(F.col(f"_sum_{name}"), F.lit(0)))
    if position:
        out = out.withColumn(position, F.coalesce("_rows", F.lit(0)) + F.col(_AT) % F.lit(_ROWS_PER_SLICE) + 1)
    return out.drop(_AT, _SLICE, *totals)


def _in_groups(placed: DataFrame, groups: Sequence[str], weight: Column) -> tuple[Column, Column, DataFrame]:
    """Weight of the rows before each row in its group, the group's weight, and the frame that holds both.

    Rows are in slices, ordered by group, so a group lies in one slice or reaches over the border of two; only for
    the latter, at most two per slice, is anything joined, and that by broadcast.
    """
    keys = [_SLICE, *groups]
    here = Window.partitionBy(*keys)
    so_far = here.orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy(*groups)
    parts = placed.groupBy(*keys).agg(F.sum(weight).alias("_part"))
    spread = parts.select(
        *keys, F.count(F.lit(1)).over(of_group).alias("_slices"), F.sum("_part").over(of_group).alias("_all"),
        F.coalesce(F.sum("_part").over(of_group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
    ).filter("_slices > 1").drop("_slices")
    local = placed.withColumns({"_here": F.coalesce(F.sum(weight).over(so_far), F.lit(0)), "_own": F.sum(weight).over(here)})
    joined = local.join(F.broadcast(spread), keys, "left")
    return F.col("_here") + F.coalesce("_earlier", F.lit(0)), F.coalesce("_all", "_own"), joined


_GROUP_COLUMNS = ("_here", "_own", "_all", "_earlier", _AT, _SLICE)


def group_positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """Number rows 1..n inside each group; a group of any size is spread over many slices."""
    before, size, joined = _in_groups(_laid_out(df, [*groups, *order]), groups, F.lit(1))
    return joined.withColumns({name: before + 1, "group_rows": size}).drop(*_GROUP_COLUMNS)


def tie_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value: ``below`` (rows with a smaller value), ``ties`` and ``size``."""
    keys = list(groups)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    if keys:
        before, size, joined = _in_groups(_laid_out(counted, [*keys, value]), keys, F.col("ties"))
        return joined.select(*keys, value, before.alias("below"), "ties", size.alias("size"))
    summed = running_totals(counted, [value], {"_upto": "ties"})
    size = summed.agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("size"))
    return summed.select(value, (F.col("_upto") - F.col("ties")).alias("below"), "ties", size.scalar().alias("size"))


def with_tie_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``below``, ``ties`` and ``size`` of its value, null for null values.

    Values that fill more than one shuffle partition's share, at most as many as there are partitions, come by
    broadcast; only the other rows are joined by value.
    """
    keys = [*groups, value]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = durable(tie_ranks(df, value, groups))
    total = ranks.agg(F.sum("ties").alias("n")).scalar()
    is_heavy = F.coalesce(F.col("ties") * parts > total, F.lit(False))
    heavy = ranks.filter(is_heavy)
    met = df.join(F.broadcast(heavy), keys, "left")
    rest = met.filter(F.col("ties").isNull() & F.col(value).isNotNull()).drop("below", "ties", "size")
    return met.filter(F.col("ties").isNotNull() | F.col(value).isNull()).unionByName(rest.join(ranks.filter(~is_heavy), keys, "left"))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles ``{name: p}`` of ``value`` per group (all rows when none)."""
    ranked = tie_ranks(df, value, groups)
    number = F.col(value).cast("double")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("ties")), number))

    aggregates = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("size") - 1)
        aggregates += [
            at(F.floor(place)).alias(f"_{name}_low"),
            at(F.ceil(place)).alias(f"_{name}_high"),
            F.max(place - F.floor(place)).alias(f"_{name}_part"),
        ]
    ends = ranked.groupBy(*groups).agg(*aggregates)
    return ends.select(
        *groups,
        *[
            (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n)
            for n in probabilities
        ],
    )
