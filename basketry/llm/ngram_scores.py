"""Language-model scores by Katz backoff over words, from counts of the whole training part.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text and one end per document. With c counts and
d the Good-Turing discounts of each order,

    P(w | v) = d(c(v, w)) c(v, w) / c(v)   where (v, w) occurs in training,
               alpha(v) P(w)               else, for a known word v,
               P(w)                        for an unknown v,
    P(w)     = d(c(w)) c(w) / N            for a known word, and what is left for the one type of all unknown words.

alpha(v) is what the pairs seen after v leave over, divided by what P gives to all words not seen after v, so that the
probabilities after every v add up to 1. The first token's v is a start mark. Counts up to ``RELIABLE`` get Katz's
discount from counts of counts (for fewer counts, or by half an occurrence each, where the table's counts of counts
do not allow it); larger counts give up half an occurrence each, so that no v is left without mass for other words.
The order is two: in running text hardly a three-word sequence of one document is found in another.

The texts are read once. Blocks of whole documents (about ``BLOCK_TOKENS`` tokens) keep their tokens as places in their
own list of distinct words, and only distinct words and pairs with their counts in the block are dealt to the partitions
of the count tables: a word or pair that makes up a third of all tokens is one entry per block.

1. Words are dealt by ranges of their 64-bit hash. A partition adds up its counts, sorts its words by count, and tells
   the blocks the places of their words. Ids are dealt over all partitions by falling count, so a table of one row per
   distinct count (at most sqrt(2 N) of them) gives the count, and P, of every id. It is the only thing sent to all tasks.
2. Pairs of ids are dealt by v, a frequent v over several partitions. A partition adds up counts and what alpha needs.
3. Sums of a frequent v are added up over its partitions; with the counts of counts of all pairs, alphas are known, and
   each block gets back the count of each of its pairs and the alpha of each pair not seen.
4. A block evaluates the recursion for its pairs and adds up its documents' tokens.

Null and empty texts are one end token. A null doc_id is no held-out one. Each row of ``docs`` is a document of its own. A
very long text is a block of its own. Without training documents every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.tables import mapped, written
from basketry.llm.vectors import mixed, word_hashes

RELIABLE = 5
BLOCK_TOKENS = 1_000_000
#: Characters of text, and training tokens, that one partition of the tables is made for.
CHARS_PER_PART, TOKENS_PER_PART = 40_000_000, 2_000_000
#: A word's pairs are dealt over several partitions when it has more than this share of a partition.
SHARE = 8

_END = mixed(np.array([0xE2D], np.uint64))[0]
#: Messages between blocks and partitions; what the columns a to e hold is said where they are made.
_COLUMNS = [("block", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in "abcde"), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64())), ("z", pa.list_(pa.float64()))]
_NAMES = [n for n, _ in _COLUMNS]
_SCHEMA = "block long, part long, a binary, b binary, c binary, d binary, e binary, x array<long>, y array<long>, z array<double>"
#: Values of ``block`` in rows that are a partition's own, and in those of a frequent word in a partition.
_OWN, _FREQUENT = -1, -2


def _message(block: int, part: int, *binaries: bytes, **lists: list) -> pa.RecordBatch:
    values = [block, part, *binaries, *[None] * (5 - len(binaries)), lists.get("x"), lists.get("y"), lists.get("z")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _COLUMNS)], _NAMES)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with equal values of the column."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    for key, group in groupby(rows, key=lambda r: r[column]):
        yield key, list(group)


def discounts(counts_of_counts: dict[int, int], reliable: int = RELIABLE) -> np.ndarray:
    """d[r] for counts r up to the largest that is discounted by Katz's rule; index 0 is unused."""
    n = counts_of_counts
    for k in range(reliable, 0, -1):
        if any(not n.get(r) for r in range(1, k + 2)):
            continue
        out = (k + 1) * n[k + 1] / n[1]
        d = [0.0] + [((r + 1) * n[r + 1] / (r * n[r]) - out) / (1 - out) if out < 1 else -1.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d[1:]):
            return np.array(d)
    return np.zeros(1)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for counts above 0."""
    small = counts < len(d)
    return np.where(small, counts * d[np.where(small, counts, 0)], counts - 0.5)


class Words:
    """Counts and probabilities of word ids; ids go by falling count, then come the unknown word and the start mark."""

    def __init__(self, steps: list[tuple[int, int]], documents: int) -> None:
        """``steps``: (count, words with that count); ``documents``: those of the training part."""
        steps = sorted(steps, reverse=True)
        counts, sizes = [c for c, _ in steps], [n for _, n in steps]
        self.types, self.tokens, self.documents = sum(sizes), sum(c * n for c, n in steps), documents
        self.unknown, self.start = self.types, self.types + 1
        self.kind = np.uint32 if self.types + 2 < 1 << 32 else np.uint64
        self._ends = np.cumsum(np.array([*sizes, 1, 1], np.int64))
        self._counts = np.array([*counts, 0, documents], np.int64)
        d = discounts({c: n for c, n in steps if c <= RELIABLE + 1})
        known = np.array(counts, np.int64)
        mass = discounted(known, d)
        left = float(np.sum((known - mass) * np.array(sizes))) if counts else 1.0
        total = max(self.tokens, 1)
        self.unknown_share = left / total
        self._shares = np.array([*(mass / total), left / total, 0.0])

    def _step(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._ends, ids, "right")

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self._counts[self._step(ids)]

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """P of each word."""
        return self._shares[self._step(ids)]


def _held_out(held_out: Column | None) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)) if held_out is None else held_out


def _block_rows(docs: DataFrame, parts: int) -> DataFrame:
    """Per block its documents (part -1: ids, marks, lengths, tokens) and its distinct words by part (hashes, counts)."""
    edges = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, bool, np.ndarray]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            ids = np.array([i or 0 for i, _, _ in waiting], np.int64)
            marks = np.array([2 * (i is None) + held for i, held, _ in waiting], np.uint8)
            lengths = np.array([len(t) for _, _, t in waiting], np.int64)
            hashes, tokens = np.unique(np.concatenate([t for _, _, t in waiting]), return_inverse=True)
            counts = np.bincount(tokens[np.repeat(marks & 1 == 0, lengths)], minlength=len(hashes))
            yield _message(block, -1, _pack(ids), _pack(marks), _pack(lengths), _pack(tokens.astype(np.uint32)))
            part = np.searchsorted(edges, hashes, "right") - 1
            cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(hashes)]
            for i, j in zip(cuts, cuts[1:]):
                yield _message(block, int(part[i]), hashes[i:j].tobytes(), _pack(counts[i:j].astype(np.uint32)))

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = np.append(word_hashes((text.as_py() or b"").lower()), _END)  # bytes.lower() changes A-Z alone
                if waiting and size + len(tokens) > BLOCK_TOKENS:
                    yield from close()
                    block, waiting, size = block + 1, [], 0
                waiting.append((doc_id, held, tokens))
                size += len(tokens)
        if waiting:
            yield from close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "_held")
    return mapped(slim, run, _SCHEMA)


def _word_tables(rows: DataFrame, parts: int) -> DataFrame:
    """Per part its own row (hashes by falling count, counts; x, y: distinct counts and how many words have them) and,
    per block, the places of the block's words among them; words that training lacks have the place behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _groups(batches, "part"):
            hashes = [np.frombuffer(r["a"], np.uint64) for r in group]
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(at, np.concatenate([_unpack(r["b"], np.uint32) for r in group])).astype(np.int64)
            order = np.lexsort((distinct, -totals))
            known = int((totals > 0).sum())
            place = np.empty(len(distinct), np.int64)
            place[order] = np.arange(len(distinct))
            ordered = totals[order][:known]
            counts, sizes = np.unique(ordered, return_counts=True)
            yield _message(_OWN, part, distinct[order][:known].tobytes(), _pack(ordered), x=counts[::-1].tolist(), y=sizes[::-1].tolist())
            places = np.minimum(place[at], known).astype(np.uint32)
            ends = np.cumsum([len(h) for h in hashes])
            for r, own in zip(group, np.split(places, ends[:-1])):
                yield _message(r["block"], part, _pack(own))

    return mapped(_dealt(rows, parts, "part", "block"), run, _SCHEMA)


def _dealt(rows: DataFrame, groups: int, by: str, *order: str) -> DataFrame:
    """Rows of a group together and in order; over as many tasks as groups where the session's number is smaller."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(groups, by) if groups > usual else rows.repartition(by)).sortWithinPartitions(by, *order)


def _steps(words: DataFrame) -> DataFrame:
    """(part, count, n): how many words of a part have a count."""
    return words.filter(F.col("block") == _OWN).select("part", F.explode(F.arrays_zip("x", "y")).alias("s")).select(
        "part", F.col("s.x").alias("count"), F.col("s.y").alias("n"))


def _word_ids(words: DataFrame, model: Words) -> DataFrame:
    """Per block and part the ids of the block's words."""
    steps = _steps(words)
    per_count = steps.groupBy("count").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = per_count.select("count", before.alias("first"))  # a row per distinct count, sqrt(2 N) at most
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = steps.withColumn("inside", inside).join(begun, "count").select("part", "count", "n", (F.col("first") + F.col("inside")).alias("first"))
    ordered = placed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "n", "first"))).alias("s"))
    firsts = ordered.select("part", F.transform("s", lambda s: s["n"]).alias("x"), F.transform("s", lambda s: s["first"]).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places = _unpack(r["a"], np.uint32).astype(np.int64)
                ends = np.cumsum(np.array([*(r["x"] or []), 0], np.int64))  # one more step: unknown words
                first = np.array([*(r["y"] or []), model.unknown], np.int64)
                step = np.searchsorted(ends[:-1], places, "right")
                begins = np.append(0, ends[:-1])[step]
                ids = np.where(step == len(ends) - 1, model.unknown, first[step] + places - begins)
                yield _message(r["block"], r["part"], _pack(ids.astype(model.kind)))

    asked = words.filter(F.col("block") >= 0).select("block", "part", "a").join(firsts, "part", "left").select("block", "part", "a", "x", "y")
    return mapped(asked, run, _SCHEMA)


class Pairs:
    """The distinct pairs of a block, in the order in which they are dealt to parts."""

    def __init__(self, own: dict, ids: list[bytes], model: Words, parts: int) -> None:
        self.doc_ids, self.marks, lengths = _unpack(own["a"], np.int64), _unpack(own["b"], np.uint8), _unpack(own["c"], np.int64)
        tokens = _unpack(own["d"], np.uint32).astype(np.int64)
        known = np.concatenate([_unpack(x, model.kind) for x in ids]).astype(np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.tokens = known[tokens]
        n = len(known) + 1
        before = np.append(n - 1, tokens[:-1])
        before[self.starts] = n - 1
        distinct, self.at = np.unique(before * n + tokens, return_inverse=True)
        ids_of = np.append(known, model.start)
        self.v, self.w = ids_of[distinct // n], ids_of[distinct % n]
        self.context = model.counts(self.v)
        self.counts = np.bincount(self.at[np.repeat(self.marks & 1 == 0, lengths)], minlength=len(distinct))
        asked = np.flatnonzero(self.context > 0)
        part = part_of(self.v[asked], self.w[asked], self.context[asked], model, parts)
        order = np.argsort(part, kind="stable")
        #: Pairs with a known first word, by part.
        self.asked, self.parts = asked[order], part[order]


def _n_blocks(model: Words) -> int:
    return -(-model.tokens // BLOCK_TOKENS)


def splits(context: np.ndarray, model: Words, parts: int) -> np.ndarray:
    """Over how many parts the pairs of words with these counts are dealt."""
    return np.minimum(-(-context // max(1, model.tokens // (SHARE * parts))), parts)


def part_of(v: np.ndarray, w: np.ndarray, context: np.ndarray, model: Words, parts: int) -> np.ndarray:
    over = np.maximum(splits(context, model, parts), 1).astype(np.uint64)
    first = mixed(v.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)
    return ((first + mixed(w.astype(np.uint64) + np.uint64(1)) % over) % np.uint64(parts)).astype(np.int64)


def _pair_requests(blocks: DataFrame, model: Words, parts: int) -> DataFrame:
    """Per block and part the block's distinct pairs (v, w, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (own, *ids) in _groups(batches, "block"):
            pairs = Pairs(own, [r["a"] for r in ids], model, parts)
            cuts = [*np.flatnonzero(np.diff(pairs.parts, prepend=-1)), len(pairs.parts)]
            for i, j in zip(cuts, cuts[1:]):
                at = pairs.asked[i:j]
                yield _message(block, int(pairs.parts[i]), *(_pack(x[at].astype(model.kind)) for x in (pairs.v, pairs.w)), _pack(pairs.counts[at].astype(np.uint32)))

    return mapped(_dealt(blocks, _n_blocks(model), "block", "part"), run, _SCHEMA)


def _pair_tables(requests: DataFrame, model: Words, parts: int) -> DataFrame:
    """The table of pairs in parts, with what the backoff weights need.

    A part's own row: v, w and counts of its pairs; first words of pairs that are asked for but not seen, and their
    sums; x: counts of counts. Rows of a frequent word: x the word, z its sums in the part. Per block: the counts of
    its pairs, and for those not seen the place of the first word in the part's own row.
    The sums of a word: seen pairs with count 1, 2, ... RELIABLE, with more, all counts of the latter, P of the words seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _groups(batches, "part"):
            v = np.concatenate([_unpack(r["a"], model.kind) for r in group])
            w = np.concatenate([_unpack(r["b"], model.kind) for r in group])
            counts = np.concatenate([_unpack(r["c"], np.uint32) for r in group])
            order = np.lexsort((w, v))
            new = np.flatnonzero(np.r_[True, (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)])
            at = np.empty(len(v), np.int64)
            at[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(v))))
            v, w, totals = v[order][new], w[order][new], np.bincount(at, counts).astype(np.int64)
            words, context = np.unique(v, return_inverse=True)
            seen = totals > 0
            sums = np.zeros((len(words), RELIABLE + 3))
            small = seen & (totals <= RELIABLE)
            np.add.at(sums, (context[small], totals[small] - 1), 1)
            large = totals > RELIABLE
            sums[:, RELIABLE] = np.bincount(context[large], minlength=len(words))
            sums[:, RELIABLE + 1] = np.bincount(context[large], totals[large], len(words))
            sums[:, RELIABLE + 2] = np.bincount(context[seen], model.shares(w[seen]), len(words))
            needed = np.zeros(len(words), bool)
            needed[context[~seen]] = True
            place = np.cumsum(needed) - 1
            spread_out = np.flatnonzero(splits(model.counts(words), model, parts) > 1)
            yield _message(
                _OWN, part, _pack(v[seen]), _pack(w[seen]), _pack(totals[seen]), _pack(words[needed]), _pack(sums[needed].reshape(-1)),
                x=[int((totals == r).sum()) for r in range(1, RELIABLE + 2)])
            for k in spread_out.tolist():
                yield _message(_FREQUENT, part, x=[int(words[k])], z=sums[k].tolist())
            ends = np.cumsum([len(_unpack(r["c"], np.uint32)) for r in group])
            for r, own in zip(group, np.split(at, ends[:-1])):
                yield _message(r["block"], part, _pack(totals[own]), _pack(place[context[own[~seen[own]]]]))

    return mapped(_dealt(requests, parts, "part", "block"), run, _SCHEMA)


def backoff_weights(sums: np.ndarray, context: np.ndarray, d: np.ndarray, unknown_share: float) -> np.ndarray:
    """alpha of words with these sums (a row each) and counts."""
    r = np.arange(1, RELIABLE + 1)
    used = sums[:, :RELIABLE] @ discounted(r, d) + sums[:, RELIABLE + 1] - 0.5 * sums[:, RELIABLE]
    return (1 - used / context) / np.maximum(1 - sums[:, RELIABLE + 2], unknown_share)


def _answers(tables: DataFrame, model: Words, d: np.ndarray, parts: int) -> DataFrame:
    """Per block and part the counts of the block's pairs and the backoff weights of those not seen."""
    width = RELIABLE + 3
    frequent = tables.filter(F.col("block") == _FREQUENT).select("part", F.col("x")[0].alias("v"), "z")
    whole = frequent.groupBy("v").agg(F.array(*[F.sum(F.col("z")[i]) for i in range(width)]).alias("z"))
    joined = frequent.select("part", "v").join(whole, "v").groupBy("part").agg(F.collect_list(F.struct("v", "z")).alias("s"))
    totals = joined.select("part", F.transform("s", lambda s: s["v"]).alias("y"), F.flatten(F.transform("s", lambda s: s["z"])).alias("z"))
    own = tables.filter(F.col("block") == _OWN).select("block", "part", "d", "e").join(totals, "part", "left")
    empty = F.lit(None).cast("binary")
    own = own.select("block", "part", empty.alias("a"), empty.alias("b"), empty.alias("c"), "d", "e", F.array().cast("array<long>").alias("x"), "y", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphas = np.empty(0)
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for r in rows:
            if r["block"] == _OWN:
                words, sums = _unpack(r["d"], model.kind), _unpack(r["e"], np.float64).reshape(-1, width).copy()
                for v, total in zip(r["y"] or [], np.array(r["z"] or []).reshape(-1, width)):
                    sums[words == v] = total
                alphas = backoff_weights(sums, model.counts(words), d, model.unknown_share)
            else:
                yield _message(r["block"], r["part"], r["a"], alphas[_unpack(r["b"], np.int64)].tobytes())

    asked = tables.filter(F.col("block") >= 0)
    return mapped(_dealt(own.union(asked.select(own.columns)), parts, "part", "block"), run, _SCHEMA)


def _evaluated(rows: DataFrame, model: Words, d: np.ndarray, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (own, *rest) in _groups(batches, "block"):
            pairs = Pairs(own, [r["a"] for r in rest if r["x"] is None], model, parts)
            answers = [r for r in rest if r["x"] is not None]
            logs = np.log10(model.shares(pairs.w))
            counts = np.concatenate([np.empty(0, np.int64), *(_unpack(r["a"], np.int64) for r in answers)])
            alphas = np.concatenate([np.empty(0), *(np.frombuffer(r["b"]) for r in answers)])
            seen = counts > 0
            at = pairs.asked[seen]
            logs[pairs.asked[~seen]] += np.log10(alphas)
            logs[at] = np.log10(discounted(counts[seen], d) / pairs.context[at])
            token_counts = model.counts(pairs.tokens)
            base = np.log10((token_counts + 1) / (model.tokens + model.types + 1))
            sums = [np.add.reduceat(x, pairs.starts) for x in (token_counts > 0, base, logs[pairs.at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.doc_ids, mask=pairs.marks >= 2), pa.array(pairs.marks % 2 == 1), pa.array(pairs.lengths),
                 pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(pairs.lengths), model.tokens)), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return mapped(_dealt(rows, _n_blocks(model), "block", "kind", "part").drop("kind"), run, schema)


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    ``held_out`` marks documents that nothing is learned from (crc32 of the id, mod 7, is 2).
    """
    docs = docs.withColumn("_held", _held_out(held_out)).select("doc_id", "text", "_held")
    extent = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(~F.col("_held")).alias("train")).head()
    word_parts = max(1, -(-extent.chars // CHARS_PER_PART))
    rows = written(_block_rows(docs, word_parts), "blocks")
    own = rows.filter("part = -1")
    words = written(_word_tables(rows.filter("part >= 0").select(_NAMES), word_parts), "words")
    per_count = _steps(words).groupBy("count").agg(F.sum("n").alias("n")).collect()  # a row per distinct count, sqrt(2 N) at most
    model = Words([(r["count"], r["n"]) for r in per_count], extent.train)
    parts = max(1, -(-model.tokens // TOKENS_PER_PART))
    ids = written(_word_ids(words, model), "word_ids")
    tables = written(_pair_tables(_pair_requests(own.union(ids), model, parts), model, parts), "pairs")
    sums = [F.coalesce(F.sum(F.col("x")[r]), F.lit(0)).alias(f"n{r + 1}") for r in range(RELIABLE + 1)]
    seen = tables.filter(F.col("block") == _OWN).agg(*sums).head()
    d = discounts({r + 1: seen[r] for r in range(RELIABLE + 1)})
    answers = _answers(tables, model, d, parts).withColumn("x", F.array().cast("array<long>"))  # tells answers from ids
    kinds = [df.select(*_NAMES, F.lit(k).alias("kind")) for k, df in enumerate((own, ids, answers))]
    return _evaluated(kinds[0].union(kinds[1]).union(kinds[2]), model, d, parts)
