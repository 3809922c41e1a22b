"""Lexical retrieval packing: documents into sequences of at most 2,048 tokens with their nearest neighbours.

1. One pass over the texts writes each document's ids (public word vocabulary, then the end id) and, per task, in
   how many documents each id occurs; summed, these give inverse document frequencies over the whole corpus, one
   number per vocabulary entry.
2. Documents longer than a sequence fill sequences of their own; what is left of each, shorter than a sequence,
   goes to a shard, a block of consecutive documents. A shard has an inverted index of its ids with BM25 weights.
   The first unused document is the seed; its BM25 neighbours, best first, fill the window, and the last one is
   cut to fit, its rest staying unused. An unfinished sequence goes on in the next shard, and a task's very last
   one is cut at powers of two, so no sequence needs padding.

Shards are blocks of the written ids, so packing shuffles nothing, and memory is bounded by the shard.

Null and empty texts give the end id alone. Repeated rows are packed each on its own; equal scores go to the earlier
document. An empty table gives no rows. A very long text makes many full sequences, one piece each.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import kept_by_worker, mapped, written

LENGTH = 2048
END_ID = 1
#: Documents and tokens of a shard.
SHARD_DOCUMENTS, SHARD_TOKENS = 1024, 1_000_000
K1, B = 1.2, 0.75
#: Chunks in a generation of a worker's cache; it keeps two.
CACHE_CHUNKS = 600_000

#: White space for str.split() but not for the vocabulary's normaliser.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that the ids of a word do not depend on while its letters are Latin-1; the vocabulary splits them off. Other
#: letters may become a letter and a mark when lower-cased, and marks stand together.
_STOPS = ".,"


class _Recent(dict):
    """Ids by chunk, bounded in two generations: what is asked for moves to the new one; the old one goes when it fills."""

    def __init__(self, encode: Callable[[str], bytes], chunks: int) -> None:
        super().__init__()
        self._encode, self._chunks = encode, chunks
        self._old: dict[str, bytes] = {}
        #: Whether the chunks asked for are Latin-1.
        self.latin = False

    def __missing__(self, chunk: str) -> bytes:
        if self.latin and chunk[-1] in _STOPS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1]]  # a word with its full stop or comma is not kept
        ids = self._old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        self[chunk] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self._chunks:
            self._old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts by the tokenizers library; the vocabulary drops white space, so chunks are independent."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = self._library.get_vocab_size()
        self._known = _Recent(self._encode, cache_chunks)

    def _encode(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()  # four bytes each

    def of(self, text: str) -> np.ndarray:
        if any(c in text for c in _SEPARATORS):
            ids = self._encode(text)
        else:
            # The vocabulary lower-cases; within Latin-1 that can be done first, so that fewer chunks differ, but not
            # where it could make a special token of one in capitals.
            self._known.latin = _in_latin_1(text)
            chunks = (text.lower() if self._known.latin and "<|" not in text else text).split()
            ids = b"".join(map(self._known.__getitem__, chunks))
            self._known.trim()
        return np.frombuffer(ids, np.uint32)


def _in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _encoder(key: str, path: str, cache_chunks: int) -> WordIds:
    return kept_by_worker(key, lambda: WordIds(path, cache_chunks))


def tokenised(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """(doc_id, ids, counts): ids as little-endian 32-bit integers with the end id.

    The last row of each task has no ids but counts: of each vocabulary id the documents with it, then the number
    of documents and of tokens that do not fill a sequence.
    """

    key = f"{path} {cache_chunks}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, path, cache_chunks)
        counts = np.zeros(max(encoder.size, end_id + 1) + 2, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                coded = []
                for text in batch.column(1).slice(i, 256).to_pylist():
                    ids = np.concatenate([encoder.of(text or ""), end])
                    counts[ids] += 1  # once per document: repeated indices are written once
                    counts[-2] += 1
                    counts[-1] += len(ids) % length
                    coded.append(ids.astype("<u4").tobytes())
                nulls = pa.nulls(len(coded), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(coded, pa.binary()), nulls], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))], ["doc_id", "ids", "counts"]
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(slim, run, "doc_id long, ids binary, counts array<long>", keeps=key)


class Shard:
    """Unused rests of documents with an inverted index of their ids."""

    def __init__(self, rests: list[tuple[int | None, np.ndarray, int]], idf: np.ndarray, average: float) -> None:
        self.rests = rests
        n = len(rests)
        self.starts = np.array([start for _, _, start in rests], np.int64)
        self.left = np.array([len(ids) for _, ids, _ in rests], np.int64) - self.starts
        lengths = self.left.copy()
        of = np.repeat(np.arange(n), lengths)
        terms = np.concatenate([ids[start:] for _, ids, start in rests]).astype(np.int64)
        posting, frequency = np.unique(terms * n + of, return_counts=True)
        term, self._docs = np.divmod(posting, n)
        scale = K1 * (1 - B + B * lengths[self._docs] / average)
        self._weights = (idf[term] * frequency * (K1 + 1) / (frequency + scale)).astype(np.float32)
        self._terms, self._first = np.unique(term, return_index=True)
        self._last = np.r_[self._first[1:], len(term)]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the distinct ids of the query."""
        wanted = np.unique(query)
        at = np.minimum(np.searchsorted(self._terms, wanted), len(self._terms) - 1)
        at = at[self._terms[at] == wanted]
        first, sizes = self._first[at], self._last[at] - self._first[at]
        if not len(at):
            return np.zeros(len(self.rests))
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        return np.bincount(self._docs[places], self._weights[places], len(self.rests))


class Packer:
    """Packs one task's documents; collects rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, idf: np.ndarray, average: float, length: int, first_sequence: int) -> None:
        self._idf, self._average, self._length = idf, average, length
        self._sequence = first_sequence
        self._open: list[tuple[int | None, np.ndarray, int, int]] = []
        self._waiting: list[tuple[int | None, np.ndarray, int]] = []
        self._tokens = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple[int | None, np.ndarray, int, int]]) -> None:
        offset = 0
        for doc_id, ids, start, n in pieces:
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self._sequence, offset))
            offset += n
        self._sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self._length * self._length
        for start in range(0, whole, self._length):
            self._close([(doc_id, ids, start, self._length)])
        if whole < len(ids):
            self._waiting.append((doc_id, ids, whole))
            self._tokens += len(ids) - whole
            if len(self._waiting) >= SHARD_DOCUMENTS or self._tokens >= SHARD_TOKENS:
                self.pack()

    def pack(self) -> None:
        """Pack what waits; the sequence that stays unfinished goes on with the next shard."""
        if not self._waiting:
            return
        shard = Shard(self._waiting, self._idf, self._average)
        self._waiting, self._tokens = [], 0
        left, starts = shard.left, shard.starts
        following = 0
        while True:
            if not self._open:
                while following < len(left) and not left[following]:
                    following += 1
                if following == len(left):
                    return
                doc_id, ids, _ = shard.rests[following]
                self._open.append((doc_id, ids, int(starts[following]), int(left[following])))
                left[following] = 0
            room = self._length - sum(p[3] for p in self._open)
            _, ids, start, n = self._open[0]
            scores = shard.scores(ids[start : start + n])
            scores[left == 0] = -1.0
            while room:
                best = int(np.argmax(scores))
                if scores[best] < 0:
                    return
                taken = min(room, int(left[best]))
                self._open.append((shard.rests[best][0], shard.rests[best][1], int(starts[best]), taken))
                starts[best] += taken
                left[best] -= taken
                room -= taken
                if not left[best]:
                    scores[best] = -1.0
            self._close(self._open)
            self._open = []

    def finish(self) -> None:
        """The unfinished sequence becomes sequences whose lengths are powers of two."""
        self.pack()
        total = sum(p[3] for p in self._open)
        pieces = self._open[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            room, part = total & (1 << bit), []
            while room:
                doc_id, ids, start, n = pieces.pop()
                taken = min(n, room)
                part.append((doc_id, ids, start, taken))
                if taken < n:
                    pieces.append((doc_id, ids, start + taken, n - taken))
                room -= taken
            if part:
                self._close(part)
        self._open = []


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``cache_chunks`` bounds a worker's cache of ids and nothing else: fewer cost time, more cost memory.
    """
    coded = written(tokenised(docs, path, length, end_id, cache_chunks), "ids")
    per_id = coded.filter("counts is not null").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.array([r["n"] for r in per_id.orderBy("at").collect()], float)  # one number per vocabulary entry
    if not len(counts):
        counts = np.zeros(2)
    n_docs, tokens = counts[-2:]
    idf = np.log1p((n_docs - counts[:-2] + 0.5) / (counts[:-2] + 0.5))
    average = max(tokens, 1.0) / max(n_docs, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf, average, length, TaskContext.get().partitionId() << 40)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * len(_NAMES))], _NAMES)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.frombuffer(ids.as_py(), "<u4"))
            yield out()
        packer.finish()
        yield out()

    documents = coded.filter("ids is not null").select("doc_id", "ids")
    return mapped(documents, run, ", ".join(f"{n} long" for n in _NAMES))
