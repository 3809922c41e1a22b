"""Reading the given tables, writing intermediate ones in the shared folder, and running Arrow functions."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import basketry
from basketry.session import shared_folder

_shipped: set[str] = set()

#: Rows go to the workers by the 10,000 unless bytes bound a batch too; that many long texts would be held, in and out, by
#: an executor's JVM and by each of its workers.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: Folders written on the way to each result that is being finished, the innermost last.
_on_the_way: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a fresh folder that every executor can reach, read back from there.

    Cuts the lineage, keeps column pruning, and a lost executor costs nothing but its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _on_the_way:
        _on_the_way[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``build()``, written; the folders that were written on the way to it are removed."""
    _on_the_way.append([])
    try:
        df = build()
    finally:
        made = _on_the_way.pop()
    result = written(df, name)
    context = df.sparkSession.sparkContext
    for folder in made:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return result


_kept: dict[str, object] = {}


def kept_by_worker(key: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under a key; the next key takes its place, so that operators that follow each
    other in the same worker do not add up."""
    if key not in _kept:
        drop_all_but(key)
        _kept[key] = make()
    return _kept[key]


def drop_all_but(key: str | None) -> None:
    """A worker lets go of what it keeps under other keys."""
    if _kept.keys() - {key}:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Memory that Arrow or malloc holds for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def mapped(df: DataFrame, run, schema: str, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the workers, which may not have it installed.

    ``keeps`` is the key under which ``run`` keeps something by worker. What another operator has kept goes when a task
    begins, and unused memory when it ends. Batches are bounded by bytes, as the session says or else by ``BATCH_BYTES``.
    """
    if df.sparkSession.conf.get(BATCH_BYTES[0], None) is None:
        df.sparkSession.conf.set(*BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_all_but(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        packed = io.BytesIO()
        top = Path(basketry.__file__).parent
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(top.rglob("*.py")):
                archive.write(file, str(file.relative_to(top.parent)))
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(df.sparkSession)}/llm-{context.applicationId}/basketry_package.zip")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(packed.getvalue())
        out.close()
        context.addPyFile(path.toString())
        _shipped.add(context.applicationId)
    return df.mapInArrow(task, schema)
