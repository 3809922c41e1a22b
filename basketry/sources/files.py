"""File sources and sinks: stacked yearly exports, parse-once cache, CSV, JSON and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.star import fingerprint
from basketry.sources.retail import RAW_SCHEMA


def read_yearly_exports(spark: SparkSession, paths: list[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Stack one export per year; the explicit schema keeps identifiers text whatever they look like."""
    parts = [
        spark.read.schema(schema).option("header", True).option("escape", '"').csv(path) for path in paths
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parse_once(spark: SparkSession, cache: str, parse, refresh: bool = False) -> DataFrame:
    """Read the Parquet cache; parse the exports into it first when it is missing or to be refreshed."""
    if not refresh:
        try:
            return spark.read.parquet(cache)
        except Exception as err:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
                raise
    parse().write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def profile(df: DataFrame, date_column: str) -> DataFrame:
    """Rows, columns, date range and null count of every column, from one scan; one row per column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date_column).alias("first_date"),
        F.max(date_column).alias("last_date"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)],
    )
    per_column = F.array(*[
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(f"nulls_{i}").alias("nulls"))
        for i, (name, kind) in enumerate(df.dtypes)
    ])
    return counted.select(
        "rows", F.lit(len(df.columns)).alias("columns"), "first_date", "last_date", F.inline(per_column)
    )


def hand_off(frames: dict[str, DataFrame], run_folder: str) -> None:
    """Stage files of one run, one folder per frame."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{run_folder}/{name}")


def pick_up(spark: SparkSession, run_folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{run_folder}/{name}") for name in names}


def run_record(tables: dict[str, DataFrame], run_id: int) -> DataFrame:
    """Rows, revenue, newest line and content fingerprint of a load, as one row."""
    sales = tables["fact_sales"].agg(
        F.count(F.lit(1)).alias("sales_rows"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(16,3)").alias("sales_revenue"),
        F.max("invoice_date").alias("max_invoice_date"),
    )
    cancel_rows = tables["fact_cancellations"].agg(F.count(F.lit(1)).alias("n")).scalar()
    return sales.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.current_timestamp().alias("finished_at"),
        "sales_rows",
        cancel_rows.alias("cancel_rows"),
        "sales_revenue",
        "max_invoice_date",
        fingerprint(tables).scalar().alias("fingerprint"),
    )


def append_run(record: DataFrame, log_path: str) -> None:
    record.coalesce(1).write.mode("append").parquet(log_path)


def last_runs(log: DataFrame, n: int = 2) -> DataFrame:
    return log.orderBy(F.desc("run_id")).limit(n)


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, fingerprint and revenue of one version, as one row."""
    revenue = tables["fact_sales"].agg(F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("r"))
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(f"{name}_rows") for name, df in tables.items()
    ]
    return fingerprint(tables).select(*counts, "fingerprint", revenue.scalar().alias("sales_revenue"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# The columns of a hand-label file.
LABEL_COLUMNS = [
    "label_id", "question", "sql", "sql_result", "answer", "cited_docs", "docs_shown_to_agent", "faithful",
    "citation_correct", "notes",
]
LABEL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LABEL_COLUMNS])
_LABELS = ["faithful", "citation_correct"]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand labels as text, without the instruction lines (quoted or not) that stand above the header."""
    read = spark.read.schema(LABEL_SCHEMA).option("comment", "#").option("multiLine", True).option("escape", '"')
    rows = read.csv(path).filter(F.col("label_id").isNotNull())
    return rows.filter(~F.col("label_id").startswith("#") & (F.col("label_id") != "label_id"))


def invalid_labels(labels: DataFrame) -> DataFrame:
    """Every label cell that is not 0 or 1."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(c, F.lit(""))).alias("value")) for c in _LABELS])
    return labels.select("label_id", F.inline(cells)).filter(~F.col("value").isin("0", "1"))


def checked_labels(labels: DataFrame, report: str) -> DataFrame:
    """Labels as integers; bad cells raise. Every one of them is written to ``report`` (label_id, column, value), so
    neither the list nor the driver is bounded by their number."""
    invalid_labels(labels).write.mode("overwrite").parquet(report)
    bad = labels.sparkSession.read.parquet(report).count()
    if bad:
        raise ValueError(f"{bad} labels missing or not 0/1, listed in {report}")
    return labels.select("label_id", *[F.trim(c).cast("int").alias(c) for c in _LABELS], F.coalesce("notes", F.lit("")).alias("notes"))


def read_answer_sets(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Recorded answers of several sets, each row tagged with its set.

    A file holds one JSON array, indented or not, or one record per line; anything else raises. Files of lines are
    read in splits like any text; only a file that is an array, which no line of records starts as, is read whole.
    """
    out = None
    file = F.col("_metadata.file_path")
    for name, path in paths.items():
        opened = spark.read.text(path).filter(F.ltrim("value").startswith("[")).select(file.alias("file")).distinct()
        arrays_at = [r["file"] for r in opened.collect()]  # at most one name per file that the driver has listed anyway
        lines = spark.read.text(path).filter(~file.isin(arrays_at)).filter(F.trim("value") != "")
        found = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
        if arrays_at:
            whole = spark.read.text(path, wholetext=True).filter(file.isin(arrays_at))
            kind = T.ArrayType(schema)
            found = found.unionByName(whole.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("r")))
        one = found.select("r.*").withColumn("set", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions present in ``df``; running it twice leaves the same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def parameterised(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A SQL text with ``:name`` parameters."""
    return spark.sql(text, args=parameters)
