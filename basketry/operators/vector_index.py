"""Exact cosine search over an index of cells: cells that cannot hold one of the best rows are not read.

Building: unit vectors are clustered by k-means (fitted on a bounded sample); each row goes to the cell of its nearest
centre, and a cell knows its radius, the largest angle between its centre and a row. Cells are cut into slices of
bounded size, so that one cell with a third of all rows is many tasks.

Searching: the angle between a query and a row is at least the query's angle to the centre less the radius, which
bounds every row of a cell from above by one cosine. Each query first visits the cells with the best bounds until
they hold k rows; its k-th best similarity there is a floor, and of the other cells only those whose bound reaches the
floor are visited. The result is that of comparing every row. Queries are dealt by (cell, slice, block of queries), so
any number of them makes one plan, and nothing but centres and radii (at most ``MOST_CELLS``) goes to all tasks.

Rows and queries whose vector is zero have similarity 0 to everything; such rows lie in a cell of their own. Equal
similarities are ordered by id. Fewer than k rows give all rows; an empty corpus gives no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.retrieval import _cosine, dense_matrix
from basketry.session import durable

#: Cells at most, rows the centres are fitted on at most, rows of a slice and queries of a block.
MOST_CELLS, SAMPLE_ROWS, SLICE_ROWS, BLOCK_QUERIES = 512, 50_000, 20_000, 2_000
#: Angles are rounded; bounds keep this much to the safe side, far more than their error and far less than a cell.
_SLACK = 1e-7
_ZERO = -1


@dataclass
class Cells:
    """Per cell its number, unit centre, radius, rows and slices."""

    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    slices: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell a similarity that no row of the cell exceeds."""
        if not self.centres.any():
            return np.zeros((len(queries), len(self.cells)))
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        unit = np.divide(queries, lengths, out=np.zeros_like(queries), where=lengths > 0)
        angles = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        best = np.cos(np.maximum(0, angles - self.radii - _SLACK)) + _SLACK
        best[:, self.cells == _ZERO] = 0.0
        best[lengths[:, 0] == 0] = 0.0
        return best


@dataclass
class Index(Cells):
    """The cells with their rows (cell, slice, id, vector)."""

    rows: DataFrame

    def alone(self) -> Cells:
        """The cells without their rows, as tasks get them."""
        return Cells(self.cells, self.centres, self.radii, self.sizes, self.slices)


def _units(vectors: pd.Series) -> np.ndarray:
    rows = dense_matrix(vectors)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _centres(corpus: DataFrame, n_rows: int, cells: int, seed: int) -> np.ndarray:
    """Unit centres of k-means on about ``SAMPLE_ROWS`` rows."""
    drawn = corpus.filter(F.exists("vector", lambda v: v != 0))
    if n_rows > SAMPLE_ROWS:
        drawn = drawn.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(SAMPLE_ROWS / n_rows * (1 << 30)))
    sample = durable(drawn.select(array_to_vector("vector").alias("features")))
    if sample.limit(1).count() == 0:
        return np.zeros((0, 0))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample) if cells > 1 else None
    found = np.stack(model.clusterCenters()) if model else np.asarray([sample.head().features.toArray()])
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def build(corpus: DataFrame, cells: int | None = None, seed: int = 7) -> Index:
    """Index a corpus of (id, vector); by default about one cell for the square root of the number of rows."""
    rows = corpus.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n_rows = rows.count()
    wanted = min(MOST_CELLS, cells or max(1, round(math.sqrt(n_rows))))
    centres = _centres(rows, n_rows, wanted, seed)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _units(batch["vector"])
            zero = ~unit.any(axis=1)
            near = unit @ centres.T if centres.size else np.zeros((len(batch), 1))
            cell = np.where(zero, _ZERO, near.argmax(axis=1))
            angle = np.where(zero, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))
            yield batch.assign(cell=cell.astype("int32"), angle=angle)[["cell", "angle", "id", "vector"]]

    assigned = durable(rows.mapInPandas(placed, "cell int, angle double, id string, vector array<double>"))
    known = sorted(assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect())  # a row per cell
    numbers = np.array([r["cell"] for r in known], int)
    sizes = np.array([r["n"] for r in known], int)
    slices = -(-sizes // SLICE_ROWS)
    of_cell = F.create_map(*[F.lit(int(x)) for pair in zip(numbers, slices) for x in pair]) if known else None
    part = F.pmod(F.xxhash64("id"), of_cell[F.col("cell")]).cast("int") if known else F.lit(0)
    width = centres.shape[1] if centres.size else 1
    own = [centres[c] if c != _ZERO else np.zeros(width) for c in numbers]
    stored = assigned.select("cell", part.alias("slice"), "id", "vector")
    return Index(numbers, np.array(own).reshape(-1, width), np.array([r["radius"] for r in known]), sizes, slices, stored)


def _plans(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vector, cells, bounds, first): cells by falling bound; the first of them hold k rows."""
    known = index.alone()

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = known.bounds(dense_matrix(batch["vector"]))
            order = np.argsort(-bounds, axis=1, kind="stable")
            held = np.cumsum(known.sizes[order], axis=1)
            first = np.minimum((held < k).sum(axis=1) + 1, len(known.cells))
            yield batch.assign(
                cells=list(known.cells[order].astype("int32")), bounds=list(np.take_along_axis(bounds, order, axis=1)), first=first.astype("int32"))

    return queries.mapInPandas(plan, "query_id string, vector array<double>, cells array<int>, bounds array<double>, first int")


def _visited(index: Index, visits: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, id, similarity): the best k rows of every slice of every cell that a query visits."""
    of_cell = F.create_map(*[F.lit(int(x)) for pair in zip(index.cells, index.slices) for x in pair])
    keys = ["cell", "slice", "block"]
    asked = visits.withColumn("slice", F.explode(F.sequence(F.lit(0), of_cell[F.col("cell")] - 1))).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    wanted = asked.select(*keys).distinct().toDF(*keys)

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        similar = _cosine(dense_matrix(rows["vector"]), dense_matrix(queries["vector"]))
        n = min(k, len(rows))
        least = np.partition(similar, len(rows) - n, axis=0)[len(rows) - n]
        at, query = np.nonzero(similar >= least)  # what ties with the k-th best is still in
        found = pd.DataFrame({"query": query, "id": rows["id"].to_numpy()[at], "similarity": similar[at, query]})
        found = found.sort_values(["query", "similarity", "id"], ascending=[True, False, True], kind="stable")
        found = found[found.groupby("query").cumcount() < k]
        return found.assign(query_id=queries["query_id"].to_numpy()[found["query"].to_numpy()])[["query_id", "id", "similarity"]]

    stored = index.rows.join(wanted, ["cell", "slice"]).groupBy(*keys)
    return stored.cogroup(asked.select(*keys, "query_id", "vector").groupBy(*keys)).applyInPandas(
        best, "query_id string, id string, similarity double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` rows (query_id, id, similarity, rank), and per query what was read (query_id, cells, rows)."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    if not len(index.cells):
        none = asked.limit(0)
        return (none.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")),
                asked.select("query_id", F.lit(0).alias("cells"), F.lit(0).cast("long").alias("rows")))
    plans = durable(_plans(index, asked, k))
    blocks = max(1, -(-plans.count() // BLOCK_QUERIES))
    near = plans.select("query_id", "vector", F.explode(F.slice("cells", F.lit(1), F.col("first"))).alias("cell"))
    first = durable(_ranked(_visited(index, near, blocks, k), k))
    floors = first.groupBy("query_id").agg(F.min("similarity").alias("floor"))
    rest = plans.join(floors, "query_id").select(
        "query_id", "vector", "first", F.filter(
            F.arrays_zip(F.slice("cells", F.col("first") + 1, F.size("cells")).alias("cell"), F.slice("bounds", F.col("first") + 1, F.size("cells")).alias("bound")),
            lambda c: c["bound"] >= F.col("floor")).alias("far"))
    rest = durable(rest)
    far = rest.select("query_id", "vector", F.explode("far").alias("c")).select("query_id", "vector", F.col("c.cell").alias("cell"))
    hits = _ranked(first.drop("rank").union(_visited(index, far, blocks, k)), k)
    size = F.create_map(*[F.lit(int(x)) for pair in zip(index.cells, index.sizes) for x in pair])
    visits = near.select("query_id", "cell").union(far.select("query_id", "cell"))
    read = visits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("cells"), F.sum(size[F.col("cell")]).cast("long").alias("rows"))
    return hits, read
