"""Which rows differ between two versions of a table, reading only the parts whose digests differ.

A table is stored in leaves by a hash of its key. Each leaf has a count and an order-free digest of its rows, each node
above it the sums of its children. Two versions are compared from the root down: of nodes that agree nothing below is
looked at, and of the leaves that differ both sides are read and joined on the key. So a few changed rows cost a few
leaves, whatever the size of the table; the digests themselves are one small table per version.

A key that occurs several times is compared by occurrence, in the order of the rows' digests. Null keys are keys like
any other. Tables without rows agree with each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketry.operators.star import row_digest, text_of

#: Children of a node and levels below the root: FAN_OUT ** LEVELS leaves.
FAN_OUT, LEVELS = 16, 2


@dataclass
class Stored:
    """A version in leaves: its folder, key and columns."""

    spark: SparkSession
    folder: str
    key: list[str]
    columns: list[str]
    schema: T.StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    @property
    def digests(self) -> DataFrame:
        """(leaf, n, digest)"""
        return self.spark.read.parquet(f"{self.folder}/digests")


def store(df: DataFrame, key: Sequence[str], folder: str) -> Stored:
    """Write a version: rows by leaf (one folder per leaf, each written by few tasks) and the leaves' digests."""
    leaves = FAN_OUT**LEVELS
    hashed = F.crc32(F.concat_ws("|", *[F.concat(F.length(text_of(df, k)).cast("string"), F.lit(":"), text_of(df, k)) for k in key]).cast("binary"))
    kept = df.withColumn("_digest", row_digest([text_of(df, c) for c in df.columns])).withColumn("_leaf", (hashed % leaves).cast("int"))
    kept.repartition("_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(f"{folder}/rows")
    stored = Stored(df.sparkSession, folder, list(key), df.columns, kept.schema)
    stored.rows.groupBy(F.col("_leaf").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum("_digest").alias("digest")).write.mode("overwrite").parquet(f"{folder}/digests")
    return stored


def _level(digests: DataFrame, level: int) -> DataFrame:
    node = F.floor(F.col("leaf") / FAN_OUT ** (LEVELS - level)).cast("int")
    return digests.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


def differing_leaves(left: Stored, right: Stored) -> list[int]:
    """From the root down; at most FAN_OUT ** LEVELS numbers are looked at here."""
    suspects: list[int] | None = None
    for level in range(LEVELS + 1):
        a, b = (_level(x.digests, level) for x in (left, right))
        if suspects is not None:
            below = [s * FAN_OUT + k for s in suspects for k in range(FAN_OUT)]
            a, b = (x.filter(F.col("node").isin(below)) for x in (a, b))
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        suspects = sorted(r["node"] for r in both.filter(~same).select("node").collect())
        if not suspects:
            return []
    return suspects


def _numbered(side: Stored, leaves: list[int]) -> DataFrame:
    rows = side.rows.filter(F.col("_leaf").isin(leaves))
    order = Window.partitionBy(*side.key).orderBy("_digest")
    return rows.withColumn("_nth", F.row_number().over(order))


def changed_rows(left: Stored, right: Stored) -> DataFrame:
    """Rows of one side only and rows that differ: the key, ``change`` and, for changed ones, the columns that differ."""
    leaves = differing_leaves(left, right)
    a, b = _numbered(left, leaves).alias("a"), _numbered(right, leaves).alias("b")
    on = F.col("a._nth") == F.col("b._nth")
    for k in left.key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, on, "full_outer")
    change = F.when(F.col("b._nth").isNull(), "missing").when(F.col("a._nth").isNull(), "added").otherwise("changed")
    differ = F.array_compact(F.array(*[
        F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in left.columns if c not in left.key
    ] or [F.lit(None).cast("string")]))
    found = both.filter(~F.col("a._digest").eqNullSafe(F.col("b._digest"))).select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in left.key], change.alias("change"),
        F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("columns"))
    return found


def read_share(left: Stored, right: Stored) -> DataFrame:
    """One row: leaves and rows of both sides, and how many of them a comparison reads."""
    leaves = differing_leaves(left, right)
    both = left.digests.unionByName(right.digests)
    inside = F.col("leaf").isin(leaves)
    return both.agg(
        F.countDistinct("leaf").alias("leaves"), F.countDistinct(F.when(inside, F.col("leaf"))).alias("leaves_read"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("rows_read"))
