"""Ranked lexical search, reversed: the items are indexed and the documents are streamed through the index.

Terms are the maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. Weights, lengths and scores are
whole numbers (see ``term_weight`` and ``Index.scores``), so results do not depend on how the work is dealt.

1. The items' distinct terms are grouped into blocks of bounded size. A block is the only thing sent to all tasks, and
   each block costs one pass over the documents; a usual item table is one block.
2. One pass over the whole texts writes, per document, its length and the counts of the block's terms that it holds.
   The same pass counts documents, lengths and, per term, the documents with it, added up per task and then by Spark.
3. The block becomes an inverted index (term -> items, with weights). The written counts are streamed through it; each
   task keeps one heap of the best documents per item, and Spark merges the heaps.

Null and empty texts hold no term, count for nothing and are found by nothing. Items without a term, or whose terms no
document holds, have no rows. Rows of items with the same id are one item with all their terms. Every row of ``docs`` is
a document of its own, also where ids repeat; equal scores go to the smaller doc_id, null ids last. Empty tables
give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.tables import mapped, written

TOP = 10
#: (item, term) pairs of a block: some 20 MB of index and 50 MB of terms in a task.
BLOCK_POSTINGS = 500_000
#: Scores held at once while documents are streamed.
SCORES_AT_ONCE = 2_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (data or b"").translate(_AS_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.split(lowered, _NOT_TERM)).alias("term"))
    return words.filter("term != ''").distinct()


def term_weight(n_docs: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_holding + 1)))


class Index:
    """A block of items as an inverted index: for each term its weight and its items."""

    def __init__(self, pairs: list[tuple[int | None, str]]) -> None:
        self.terms = {t: i for i, t in enumerate(sorted({t.encode() for _, t in pairs}))}
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        places = {i: k for k, i in enumerate(self.items)}
        at = np.array([(self.terms[t.encode()], places[i]) for i, t in pairs], np.int64).reshape(-1, 2)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        self.postings = at[:, 1]
        self.first = np.searchsorted(at[:, 0], np.arange(len(self.terms) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)

    def scores(self, docs: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of documents x items; ``lengths`` are the documents' m, the other arrays have one entry per term of a document."""
        parts = self.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * lengths[docs]))
        sizes = self.first[terms + 1] - self.first[terms]
        places = np.arange(sizes.sum()) + np.repeat(self.first[terms] - (np.cumsum(sizes) - sizes), sizes)
        found = np.zeros(len(lengths) * len(self.items), np.int64)
        np.add.at(found, np.repeat(docs, sizes) * len(self.items) + self.postings[places], np.repeat(parts, sizes))
        return found.reshape(len(lengths), len(self.items))


class Heaps:
    """The best documents of each item of a task; the worst of them is on top."""

    def __init__(self, n_items: int, top: int) -> None:
        self._top = top
        self._least = np.ones(n_items, np.int64)
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_items)]

    def offer(self, ids: list[int | None], scores: np.ndarray) -> None:
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= self._least))):
            key = ids[doc]
            entry = (int(scores[doc, item]), key is not None, -(key or 0))
            heap = self.heaps[item]
            if len(heap) < self._top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self._top:
                self._least[item] = heap[0][0]


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with one of the terms; the last row of a task has, with n null, its sums.

    ``terms`` and ``counts`` are little-endian 32-bit numbers. A task's own row has the terms met there with the
    number of documents that hold each, the number of documents with any term at all and the number of all their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0

        def rows(ids, lengths, found, counts, totals=(None,) * 4) -> pa.RecordBatch:
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary()),
                 *(pa.array([x] * len(ids), kind) for x, kind in zip(totals, kinds))],
                ["doc_id", "n", "terms", "counts", "met", "holding", "n_docs", "n_terms"],
            )

        for batch in batches:
            ids, lengths, found, counts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                own = [(terms[w], c) for w, c in Counter(words).items() if w in terms]
                if own:
                    pairs = np.array(own, "<u4")
                    holding[pairs[:, 0]] += 1
                    ids.append(key)
                    lengths.append(len(words))
                    found.append(pairs[:, 0].tobytes())
                    counts.append(pairs[:, 1].tobytes())
            if ids:
                yield rows(ids, lengths, found, counts)
        met = np.flatnonzero(holding)
        yield rows([None], [None], [None], [None], (met.tolist(), holding[met].tolist(), n_docs, n_terms))

    schema = "doc_id long, n long, terms binary, counts binary, met array<long>, holding array<long>, n_docs long, n_terms long"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, schema)


def _weighted(index: Index, counted: DataFrame) -> tuple[int, int]:
    """Fill the index's weights from the tasks' sums; the number of documents and of terms. Read here: a row per term of the block."""
    sums = counted.filter("n is null")
    totals = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).head()
    holding = np.zeros(len(index.terms), np.int64)
    met = sums.select(F.explode(F.arrays_zip("met", "holding")).alias("x")).groupBy("x.met").agg(F.sum("x.holding").alias("n"))
    for row in met.collect():
        holding[row.met] = row.n
    index.weights = np.array([term_weight(totals.docs, int(h)) for h in holding], np.int64)
    return totals.docs, totals.terms


def _best_of_tasks(index: Index, counted: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(index.items), top)
        step = max(1, SCORES_AT_ONCE // max(len(index.items), 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                found = [np.frombuffer(x.as_py(), "<u4") for x in part.column(2)]
                counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in part.column(3)]).astype(np.int64)
                docs = np.repeat(np.arange(len(found)), [len(x) for x in found])
                lengths = np.array([10 + 90 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                heaps.offer(part.column(0).to_pylist(), index.scores(docs, np.concatenate(found).astype(np.int64), counts, lengths))
        rows = [(index.items[k], -doc if known else None, score) for k, heap in enumerate(heaps.heaps) for score, known, doc in heap]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    slim = counted.filter("n is not null").select("doc_id", "n", "terms", "counts")
    return mapped(slim, run, "item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 of every item."""
    pairs = written(item_terms(items), "item_terms")
    blocks = max(1, -(-pairs.count() // BLOCK_POSTINGS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for k in range(blocks):
        index = Index([(r.item_id, r.term) for r in pairs.filter(block == k).toLocalIterator()])
        counted = written(term_counts(docs, index.terms), "term_counts")
        best = _best_of_tasks(index, counted, *_weighted(index, counted), top)
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
