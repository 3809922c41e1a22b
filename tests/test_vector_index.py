import numpy as np
import pytest

from basketry.operators import vector_index


def vectors(spark, rows, name):
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} string, vector array<double>")


def brute(rows, queries, k):
    out = []
    for q, v in enumerate(queries):
        n = np.linalg.norm(rows, axis=1) * np.linalg.norm(v)
        s = np.round(np.divide(rows @ v, n, out=np.zeros(len(rows)), where=n > 0), 12)
        best = sorted(range(len(rows)), key=lambda i: (-s[i], str(i)))[:k]
        out += [(str(q), str(i), rank + 1, round(float(s[i]), 9)) for rank, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows, block", [(vector_index.SLICE_ROWS, vector_index.BLOCK_QUERIES), (40, 7)])
def test_search_is_that_of_all_rows_and_reads_few_cells(spark, monkeypatch, slice_rows, block):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    rows = np.concatenate([middles[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 16)), np.zeros((3, 16)), np.tile(middles[:1], (90, 1))])
    queries = np.concatenate([middles + 0.02 * rng.normal(size=(12, 16)), rng.normal(size=(6, 16)), np.zeros((1, 16))])
    index = vector_index.build(vectors(spark, rows, "id"), cells=12)
    hits, read = vector_index.search(index, vectors(spark, queries, "query_id"), 8)
    assert sorted((r.query_id, r.id, r["rank"], round(r.similarity, 9)) for r in hits.collect()) == brute(rows, queries, 8)
    cells = {int(r.query_id): r.cells for r in read.collect()}
    assert len(cells) == len(queries) and np.mean([cells[q] for q in range(12)]) <= 3


def test_few_or_no_rows(spark):
    rows = np.eye(3)
    index = vector_index.build(vectors(spark, rows, "id"))
    hits, _ = vector_index.search(index, vectors(spark, rows[:1], "query_id"), 8)
    assert [(r.id, r["rank"]) for r in sorted(hits.collect(), key=lambda r: r["rank"])] == [("0", 1), ("1", 2), ("2", 3)]
    empty = vector_index.build(vectors(spark, rows, "id").limit(0))
    hits, read = vector_index.search(empty, vectors(spark, rows, "query_id"), 8)
    assert hits.count() == 0 and read.agg({"rows": "sum"}).head()[0] == 0
    zeros = vector_index.build(vectors(spark, np.zeros((4, 3)), "id"))
    assert vector_index.search(zeros, vectors(spark, rows[:1], "query_id"), 2)[0].count() == 2
