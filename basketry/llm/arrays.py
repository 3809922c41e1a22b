"""Array expressions that stay inside one row: bound values, prefix sums and repeats, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where a lambda inside uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """[0, ..., n - 1], empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Sums of all earlier elements of an int array; blocks keep the work linear for all lengths in practice."""
    empty = F.array().cast("array<bigint>")

    def running(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("sums"))
        return F.aggregate(
            part, start, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["sums"], F.array(acc["total"])).alias("sums"))
        )

    def all_blocks(own: Column) -> Column:
        parts = F.transform(indices(F.ceil(F.size(own) / block).cast("int")), lambda b: running(F.slice(own, b * block + 1, F.lit(block))))

        def shifted(done: Column) -> Column:
            offsets = running(F.transform(done, lambda p: p["total"]))["sums"]
            return let(offsets, lambda at: F.flatten(F.transform(done, lambda p, i: F.transform(p["sums"], lambda s: s + F.get(at, i)))))

        return let(parts, shifted)

    return let(values, all_blocks)


def covered_by_repeats(words: Column, window: int) -> Column:
    """How many words lie in a window of so many consecutive words that occurs twice or more, the first included.

    Windows are compared by 64-bit hashes; only rows with a repeat sort them with their places.
    """

    def with_hashes(hashes: Column) -> Column:
        n = F.size(hashes)

        def marked(ordered: Column) -> Column:
            places = F.filter(
                F.transform(
                    ordered,
                    lambda x, i: F.when(
                        (x["hash"] == F.get(ordered, i - 1)["hash"]) | (x["hash"] == F.get(ordered, i + 1)["hash"]), x["at"]
                    ),
                ),
                lambda at: at.isNotNull(),
            )
            return let(
                F.array_sort(places),
                lambda at: F.aggregate(
                    F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))),
                    F.lit(0).cast("bigint"),
                    lambda total, x: total + x,
                ),
            )

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("bigint")).otherwise(let(ordered, marked))

    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            indices(F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        ),
    )
    return let(windows, with_hashes)
