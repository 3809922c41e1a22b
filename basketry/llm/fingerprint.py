"""Document fingerprints by one-permutation MinHash with b-bit values, and their likeness.

A text's five-word shingles are hashed once into bins, empty bins are filled by optimal densification, and of
each bin's least value only the low bits are kept and packed. Two unrelated values agree by chance in one of
2**b cases; the likeness takes that share out again.

For the comparison with the next document, rows are dealt by ranges of doc_id and sorted, so each task reads
neighbours in order; the first document of a range is also handed to the range before it, the first of all to
the last. Text is shuffled once, and a task keeps two documents at a time.

Null texts count as empty. A text without words has the empty fingerprint, which is like another empty one (1)
and like nothing else (0). Rows with equal doc_id are ordered by text; a single document is its own next one.
Null doc_ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import mapped
from basketry.llm.vectors import OnePermutation, mixed, shingle_set

#: 512 bins of 4 bits: 256 bytes a document, standard error of a likeness at most 2.4 %.
BIN_BITS, VALUE_BITS = 9, 4
#: Ranges of doc_id dealt to each shuffle partition, so that their sizes even out.
RANGES_PER_PARTITION = 4


class Fingerprints:
    def __init__(self, bin_bits: int = BIN_BITS, value_bits: int = VALUE_BITS) -> None:
        if value_bits not in (1, 2, 4, 8):
            raise ValueError("value_bits must be 1, 2, 4 or 8")
        self._bins = OnePermutation(bin_bits)
        # Values are mixed with their bin, so that chance agreement is independent from bin to bin even where
        # a short text has few values that fill all bins.
        self._own = mixed(np.arange(1, self._bins.size + 1, dtype=np.uint64))
        self.bits = value_bits

    def of(self, data: bytes) -> bytes:
        """Packed low bits; empty for a text without words."""
        shingles = shingle_set(data)
        if not len(shingles):
            return b""
        low = (mixed(self._bins.sketch(shingles) ^ self._own) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        packed = np.zeros(len(low) * self.bits // 8, np.uint8)
        per_byte = 8 // self.bits
        for k in range(per_byte):
            packed |= low[k::per_byte] << np.uint8(k * self.bits)
        return packed.tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity of the shingle sets, corrected for chance agreement, from 0 to 1."""
        if not a or not b:
            return float(a == b)
        x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        per_byte, mask = 8 // self.bits, np.uint8((1 << self.bits) - 1)
        same = sum(int(np.count_nonzero((x >> np.uint8(k * self.bits)) & mask == 0)) for k in range(per_byte))
        chance = 0.5**self.bits
        return min(1.0, max(0.0, (same / (len(x) * per_byte) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, bin_bits: int = BIN_BITS, value_bits: int = VALUE_BITS) -> DataFrame:
    """(doc_id, fingerprint in hex) of each row, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprints(bin_bits, value_bits)
        for batch in batches:
            made = [maker.of(x.as_py() or b"").hex() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return mapped(slim, run, "doc_id long, fingerprint string")


def edited(own: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = len(own) // 2
    return own[: len(own) - n] + following[:n]


def _dealt_by_range(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, tail, doc_id, text): ranges of doc_id; tail rows repeat the first document of the next range."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [i / (RANGES_PER_PARTITION * parts) for i in range(1, RANGES_PER_PARTITION * parts)]
    named = slim.filter(~F.col("unnamed"))
    bounds = sorted(set(named.agg(F.percentile_approx("doc_id", wanted, F.lit(10_000))).head()[0] or []))
    keyed = slim.withColumn("part", _range_of(F.col("doc_id"), bounds))
    # Of each range its first doc_id: so many rows as there are ranges, whatever the documents.
    firsts = sorted((r["part"], r["first"]) for r in keyed.groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    starts = spark.createDataFrame(before, "first long, before int")
    homes = F.array(F.struct("part", F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail")))
    placed = keyed.join(F.broadcast(starts), F.col("doc_id") == F.col("first"), "left").withColumn("home", F.explode(homes))
    return placed.filter("home.part is not null").select("home.part", "home.tail", "doc_id", "unnamed", "text"), parts


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the value, counted in steps of a block and then one by one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda n, b: n + F.when(value > b, 1).otherwise(0)
    whole = F.aggregate(F.array(*[F.lit(b[-1]) for b in blocks]), F.lit(0), below)
    rest = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), whole)
    return F.least(whole * step + F.coalesce(F.aggregate(rest, F.lit(0), below), F.lit(0)), F.lit(len(bounds)))


def compare_neighbours(docs: DataFrame, bin_bits: int = BIN_BITS, value_bits: int = VALUE_BITS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses (module docstring)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprints(bin_bits, value_bits)
        held = None  # (part, doc_id, text, fingerprint) of the document whose next one is still to come
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for part, tail, doc_id, unnamed, text in zip(*(c.to_pylist() for c in columns)):
                if held is None or held[0] != part or not held[4]:
                    mark = maker.of((text or "").encode())
                    if held is not None and held[0] == part:
                        _, own_id, own, own_mark, _ = held
                        changed = edited(own, text or "").encode()
                        changed_mark = maker.of(changed)
                        out.append((
                            own_id, len(own), hashlib.sha256(changed).hexdigest(), own_mark.hex(), changed_mark.hex(),
                            maker.likeness(own_mark, changed_mark), maker.likeness(own_mark, mark),
                        ))
                    held = (part, None if unnamed else doc_id, text or "", mark, bool(tail))
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    placed, parts = _dealt_by_range(docs)
    ordered = placed.repartition(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "text")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return mapped(ordered, run, schema)
