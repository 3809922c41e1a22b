"""One-row results used beside other rows, as scalar subqueries instead of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row")).scalar()


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """All columns of ``df`` with the columns of the one-row ``one`` next to them."""
    return df.withColumn("_one", only_row(one)).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one.columns])
