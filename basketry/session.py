"""Session settings and the shared folder in which jobs keep written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "basketry", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only for local runs without one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="basketry-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df):
    """``df`` written as Parquet to the shared folder and read back: no lineage, and later reads are pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/basketry-{spark.sparkContext.applicationId}/durable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(source, rows_per_task: int | None = None):
    """Rows of a source that has fewer splits than there are cores, handed to all of them.

    For work that is heavy per row, such as text; a source with enough splits is left as it is. Splits are cut by bytes,
    so small rows come by the million to a task; with ``rows_per_task`` a task gets at most about so many.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        return source.repartition(max(cores, -(-source.count() // rows_per_task)))
    return source.repartition(cores) if source.rdd.getNumPartitions() < cores else source


def bounded_batches(df):
    """``df`` for Python in tasks: rows are handed over in Arrow batches of so many bytes, not only so many rows, so that long
    texts do not come by the thousand. Kept for the session, which may name another size before."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, "4m")
    return df
