"""Byte-pair encoding with a priority queue of merges over a doubly linked symbol list, and decoding.

Merge candidates wait in a heap ordered by rank and place. A taken merge unlinks one symbol and adds the two
new neighbours' candidates; entries whose pair is no longer there are stale and skipped. Texts are cut into
the pieces that merges never cross, and each worker keeps the ids of pieces it has seen in a bounded cache.

Null texts count as empty and give no ids. Rows, repeated or not, are encoded each on its own; a very long
text or piece costs n log n. Columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import mapped

#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept by a worker; beyond it the cache starts anew.
CACHE_PIECES = 400_000

_SPLIT = regex.compile(PATTERN)
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SHIFT = 20
_LOW = (1 << _SHIFT) - 1
_PLACE = (1 << 40) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


class _Cache(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self[key] = self._make(key)
        return value


class Codec:
    """A byte-level vocabulary with its merges and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {
            (vocabulary[a] << _SHIFT) | vocabulary[b]: (rank << _SHIFT) | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)
        }
        letters = byte_letters()
        self.byte_ids = [vocabulary[x] for x in letters]
        back = {x: b for b, x in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t.encode() if any(c not in back for c in t) else bytes(back[c] for c in t) for t, i in {**vocabulary, **special}.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.special = special
        self._special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces = _Cache(lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes())
        self.inner = _Cache(lambda chunk: self._split(" " + chunk))
        self.first = _Cache(self._split)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.byte_ids[b] for b in data]
        n = len(symbols)
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i] << _SHIFT) | symbols[i + 1])
            if found is not None:
                heap.append(((found >> _SHIFT) << 40) | i)
        if not heap:
            return symbols
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & _PLACE
            j = after[i]
            left = symbols[i]
            if left < 0 or j >= n:
                continue
            found = merges.get((left << _SHIFT) | symbols[j])
            if found is None or found >> _SHIFT != entry >> 40:
                continue  # stale: one of the two symbols has changed
            merged = symbols[i] = found & _LOW
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged << _SHIFT) | symbols[k])
                if found is not None:
                    heapq.heappush(heap, ((found >> _SHIFT) << 40) | i)
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h] << _SHIFT) | merged)
                if found is not None:
                    heapq.heappush(heap, ((found >> _SHIFT) << 40) | h)
        return [s for s in symbols if s >= 0]

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text)))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        single = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
        if not single or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text):
            return self._split(text)
        # Single spaces and line ends only: no piece reaches over one, so the parts between are looked up whole.
        line_end = self.pieces["\n"]
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(self.inner.__getitem__, rest)))
        return line_end.join(lines)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        if self._special_split is None or "<|" not in text:
            return self._plain(text)
        parts = self._special_split.split(text)
        return b"".join(
            np.uint32(self.special[p]).astype("<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        """The ids' vocabulary strings in a row; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def trim(self) -> None:
        for cache in (self.pieces, self.inner, self.first):
            if len(cache) > CACHE_PIECES:
                cache.clear()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text as an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [id_column, "ids"])
            coder.trim()

    kind = docs.schema[id_column].dataType.simpleString()
    return mapped(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return mapped(encoded.select(id_column, "ids"), run, f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            coder.trim()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(slim, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
