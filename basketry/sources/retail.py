"""Raw invoice lines derived from the order tables.

The derivation injects, by fixed arithmetic on the keys, what a real export contains: rows without a
customer, cancelled invoices, zero quantities, repeated lines and codes that are not products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import spread

RAW_COLUMNS = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country"]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("invoice_date", T.TimestampNTZType()),
        T.StructField("price", T.DecimalType(12, 3)),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_country"))
    origin = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin_country"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(home, "c_nationkey")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(origin, "s_nationkey")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
    ))
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    order_key, part_key, line_no = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    cancelled = F.col("l_returnflag") == "R"
    logged_twice = (order_key % 29 == 0) & (line_no == 1)
    shaped = joined.select(
        F.concat(F.when(cancelled, "C").otherwise(""), order_key.cast("string")).alias("invoice"),
        F.when(part_key % 97 == 0, "POST")
        .when(part_key % 89 == 0, F.concat(F.lit("ADJUST"), part_key.cast("string")))
        .otherwise(F.concat(F.lit("P"), part_key.cast("string")))
        .alias("stock_code"),
        F.col("p_name").alias("description"),
        F.when(cancelled, -F.col("l_quantity"))
        .when((order_key * 7 + line_no) % 211 == 0, 0)
        .otherwise(F.col("l_quantity"))
        .cast("int")
        .alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("p_retailprice").cast("decimal(12,3)").alias("price"),
        F.when(order_key % 5 != 0, F.col("o_custkey")).alias("customer_id"),
        F.when(order_key % 13 == 0, F.col("origin_country")).otherwise(F.col("home_country")).alias("country"),
        F.explode(F.when(logged_twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return shaped.select(*RAW_COLUMNS)
