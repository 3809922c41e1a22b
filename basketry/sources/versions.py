"""All-or-nothing publishing of several tables without a table format.

A load writes every table under a new version folder and only then creates the next numbered manifest file, which
names it. A number is created once: of two loads that began from the same live version the second gets a
``Conflict`` and its folder is removed, whatever the clocks say. Readers take the newest complete manifest and stay on
its folder; ``clean_up`` removes what no reader can still be sent to. The shared folder's file system must create a
file only if it is absent in one step, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another load became live since this one's parent."""


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write each table once and hand back frames that read what was written.

    The tables do not depend on each other, so their jobs are submitted together and share the executors.
    """
    def write(item: tuple[str, DataFrame]) -> None:
        name, df = item
        df.write.mode("overwrite").parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(max_workers=len(tables)) as jobs:
        list(jobs.map(write, tables.items()))
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}


class _Folder:
    """Files below a root, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._context, self._root = spark.sparkContext, root
        self._paths = self._context._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(root).getFileSystem(self._context._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._paths(f"{self._root}/{name}")

    def names(self, name: str) -> list[str]:
        path = self.path(name)
        return sorted(x.getPath().getName() for x in self._files.listStatus(path)) if self._files.exists(path) else []

    def create(self, name: str, text: str) -> bool:
        """Write a file unless it is there."""
        try:
            out = self._files.create(self.path(name), False)
        except Py4JJavaError as err:
            if "AlreadyExists" in str(err.java_exception):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def text(self, name: str) -> str:
        stream = self._files.open(self.path(name))
        try:
            return self._context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._files.delete(self.path(name), True)


def _manifests(folder: _Folder) -> list[int]:
    return [int(n.removesuffix(".json")) for n in folder.names("manifest") if n.endswith(".json") and not n.startswith(".")]


def _manifest(folder: _Folder, number: int) -> dict | None:
    """What a manifest says; none while its writer has not finished it."""
    try:
        return json.loads(folder.text(f"manifest/{number:012d}.json"))
    except ValueError:
        return None


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 before the first."""
    return max(_manifests(_Folder(spark, root)), default=0)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, parent: int | None = None) -> str:
    """Write all tables as a new version, then make it the live one; ``Conflict`` if ``parent`` (by default the newest
    version as the load begins) is no longer the newest."""
    folder = _Folder(spark, root)
    number = (newest(spark, root) if parent is None else parent) + 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    write_tables(tables, f"{root}/versions/{version}")
    if not folder.create(f"manifest/{number:012d}.json", json.dumps({"version": version, "tables": list(tables)})):
        folder.remove(f"versions/{version}")
        raise Conflict(f"version {number} of {root} was published by another load")
    return version


def live_version(spark: SparkSession, root: str) -> str:
    folder = _Folder(spark, root)
    for number in sorted(_manifests(folder), reverse=True):
        found = _manifest(folder, number)
        if found is not None:
            return found["version"]
    raise LookupError(f"nothing is published in {root}")


def read_version(spark: SparkSession, root: str, version: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of one version; a reader that keeps the version's name is not moved on by later loads."""
    return {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in names}


def read_live(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return read_version(spark, root, live_version(spark, root), names)


def clean_up(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove versions that ``keep`` or more newer complete ones have followed, and what loads that died or lost their
    number have left; a load that may still become live is left alone. Returns the folders removed."""
    folder = _Folder(spark, root)
    numbers = sorted(_manifests(folder), reverse=True)
    complete = {n: m["version"] for n in numbers if (m := _manifest(folder, n)) is not None}
    kept = set(list(complete.values())[: keep + 1])
    removed = []
    for version in folder.names("versions"):
        head = version.split("-")[0]
        ended = not head.isdigit() or int(head) <= max(complete, default=0)
        if version not in kept and ended:
            folder.remove(f"versions/{version}")
            removed.append(version)
    for number in list(complete)[keep + 1 :]:
        folder.remove(f"manifest/{number:012d}.json")
    return removed
