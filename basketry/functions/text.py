"""Text expressions: words, paragraphs, greedy chunks, hashed word buckets, numbers in prose."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

# The size of a hashed vector, and the number pattern with its unit suffixes.
DIMENSIONS = 384
NUMBER = (
    r"(?U)(?i)(?<![\w.])[-−]?[£$]?\s?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\s?"
    r"(%|percent|million|mn|m\b|bn|billion|k\b)?"
)
ISO_DATE = r"(?U)\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?"
CLOCK_TIME = r"(?U)\b\d{1,2}:\d{2}(:\d{2})?\b"
POWERS = {"million": 6, "mn": 6, "m": 6, "bn": 9, "billion": 9, "k": 3}

_SPACE = r"[\s\x1c-\x1f]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def bound(value: Column, build) -> Column:
    """``build(value)`` with the value computed once, however often it is used; inside a lambda function an expression
    that stands in several places is computed in each."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda w: w != "")


def paragraphs(body: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    blocks = F.split(body, rf"(?U)\n{_SPACE}*\n")
    return F.filter(F.transform(blocks, trimmed), lambda p: p != "")


def word_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(tokens) - overlap) - 1, F.lit(step))
    return F.transform(starts, lambda at: F.slice(tokens, at + 1, size))


def chunks(body: Column, size: int | None, overlap: int = 16) -> Column:
    """Paragraphs packed greedily into pieces of at most ``size`` words; a longer paragraph becomes windows.

    The paragraphs first become units (a short paragraph, or each window of a long one, which stands
    alone); a fold then finds the runs of units that fit in one piece.
    """
    if size is None:
        return F.array(body)

    def unit(tokens: Column, alone: bool) -> Column:
        return F.struct(
            F.array_join(tokens, " ").alias("text"), F.size(tokens).alias("n"), F.lit(alone).alias("alone")
        )

    def units_of(tokens: Column) -> Column:
        return F.when(
            F.size(tokens) > size,
            F.transform(word_windows(tokens, size, overlap), lambda w: unit(w, True)),
        ).otherwise(F.array(unit(tokens, False)))

    # The words of a paragraph are bound by a step of their own: an expression used for every window would be split anew.
    units = F.flatten(F.transform(F.transform(paragraphs(body), words), units_of))

    def pieces(units: Column) -> Column:
        # The fold keeps only where pieces begin and end; the texts are put together once, from those places.
        start = F.struct(F.array().cast("array<struct<first:int,n:int>>").alias("cuts"), F.lit(0).alias("first"), F.lit(0).alias("n"))

        def cut(acc: Column, first: Column, n: Column) -> Column:
            return F.concat(acc["cuts"], F.array(F.struct(first.alias("first"), n.alias("n"))))

        def closed(acc: Column, at: Column) -> Column:
            return F.when(acc["n"] > 0, cut(acc, acc["first"], at - acc["first"])).otherwise(acc["cuts"])

        def state(cuts: Column, first: Column, n: Column) -> Column:
            return F.struct(cuts.alias("cuts"), first.alias("first"), n.alias("n"))

        def add(acc: Column, unit: Column) -> Column:
            done = closed(acc, unit["at"])
            alone = state(F.concat(done, F.array(F.struct(unit["at"].alias("first"), F.lit(1).alias("n")))), unit["at"] + 1, F.lit(0))
            joined = state(acc["cuts"], acc["first"], acc["n"] + unit["n"])
            full = (acc["n"] == 0) | (acc["n"] + unit["n"] > size)
            return F.when(unit["alone"], alone).when(full, state(done, unit["at"], unit["n"])).otherwise(joined)

        sizes = F.transform(units, lambda u, i: F.struct(i.alias("at"), u["n"].alias("n"), u["alone"].alias("alone")))
        cuts = F.aggregate(sizes, start, add, lambda acc: closed(acc, F.size(units)))
        return F.transform(cuts, lambda c: F.array_join(F.transform(F.slice(units, c["first"] + 1, c["n"]), lambda u: u["text"]), " "))

    return F.get(F.transform(F.array(units), pieces), F.lit(0))


#: Characters that part words, as in ``_SPACE``, outside ASCII.
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Bytes of texts that are looked at together.
_BYTES_PER_STEP = 2_000_000
_SPACES, _TOKENS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
_TOKENS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about so many bytes that their tables stay small; one slice at least."""
    sizes = pa.compute.coalesce(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // _BYTES_PER_STEP)) + 1
    for start, end in zip([0, *edges], [*edges, len(texts)], strict=True):
        yield texts.slice(start, end - start)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, null as empty, where each text ends, and which bytes begin one."""
    texts = pa.compute.coalesce(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[ends[:-1] - ends[0]] = True
    return data, ends[1:] - ends[0], first


def _starts(inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first byte of every run of bytes inside one text."""
    found = inside.copy()
    found[1:] &= ~inside[:-1] | first[1:-1]
    return found


def token_lists(texts: pa.Array) -> tuple[np.ndarray, list[str], list[int]]:
    """For lower-cased texts: the tokens of all texts as places in a list of different ones, that list, and where each
    text's tokens begin and the last's end."""
    data, ends, first = _bytes(texts)
    inside = _TOKENS[data]
    starts = np.flatnonzero(_starts(inside, first))
    sizes = np.add.reduceat(inside, starts, dtype=np.int32) if len(starts) else np.zeros(0, dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist(), [0, *np.searchsorted(starts, ends).tolist()]


def paragraph_words(bodies: pa.Array) -> tuple[list[list[int]], np.ndarray]:
    """For lower-cased texts: the words of each paragraph of each text, and the number of tokens before each word of all
    texts and after the last, as ``paragraphs``, ``words`` and ``tokens`` find them. All texts are read at once, by bytes."""
    data, ends, first = _bytes(pa.compute.replace_substring_regex(bodies, _WIDE_SPACE, " "))
    words = np.flatnonzero(_starts(~_SPACES[data], first))
    tokens = np.cumsum(_starts(_TOKENS[data], first), dtype=np.int64)
    before = np.concatenate([np.where(words > 0, tokens[words - 1], 0), tokens[-1:] if len(tokens) else [0]])
    lines = np.cumsum(data == 10, dtype=np.int64)[words]
    owner = np.searchsorted(ends, words, side="right")
    breaks = np.flatnonzero((np.diff(lines, prepend=-2) >= 2) | (np.diff(owner, prepend=-1) > 0))
    counts = np.diff(np.append(breaks, len(words))).tolist()
    edges = np.searchsorted(owner[breaks], np.arange(len(ends) + 1)).tolist()
    return [counts[a:b] for a, b in zip(edges, edges[1:], strict=False)], before


def cuts(paragraphs: list[int], size: int, overlap: int = 16) -> list[tuple[int, int]]:
    """The pieces that ``chunks`` makes of paragraphs with so many words, each as its first word and the one after its last."""
    step = max(1, size - overlap)
    out, first, at = [], 0, 0  # the words from ``first`` wait in a piece that is not full
    for n in paragraphs:
        if n > size:
            if at > first:
                out.append((first, at))
            out += [(at + s, at + min(s + size, n)) for s in range(0, max(1, n - overlap), step)]
            first = at + n
        elif at > first and at + n - first > size:
            out.append((first, at))
            first = at
        at += n
    if at > first:
        out.append((first, at))
    return out


def as_number(text: Column) -> Column:
    """The text as a double if it is written as one; a code such as 10D is not."""
    return bare_number(trimmed(text))


def bare_number(bare: Column) -> Column:
    """``as_number`` of a text without space around it."""
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bucket(word: Column) -> Column:
    """md5(word) as a number, modulo the vector size, in pieces that fit 60 bits.

    16**15 and 16**2 both leave 256 modulo 384, so each step multiplies the remainder by 256.
    """
    return F.get(F.transform(F.array(F.md5(word)), _remainder), F.lit(0))


def _remainder(digest: Column) -> Column:
    rest = F.lit(0).cast("bigint")
    for start, digits in ((1, 15), (16, 15), (31, 2)):
        piece = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
        rest = (rest * F.lit(16**digits % DIMENSIONS) + piece) % DIMENSIONS
    return rest.cast("int")


#: Words whose bucket a worker remembers; frequent words come back soon after the cache was emptied.
_REMEMBERED_WORDS = 200_000
_remembered: dict[str, int] = {}


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, list[int]]:
    """For lower-cased texts: the buckets of all tokens, and where each text's begin and the last's end."""
    if len(_remembered) > _REMEMBERED_WORDS:
        _remembered.clear()
    found, listed, edges = token_lists(texts)
    for word in listed:
        if word not in _remembered:
            _remembered[word] = int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % DIMENSIONS
    return np.fromiter(map(_remembered.__getitem__, listed), dtype=np.int32, count=len(listed))[found], edges


def _bucket_lists(texts: pd.Series) -> pd.Series:
    out = []
    for part in steps(pa.array(texts, pa.string(), from_pandas=True)):
        values, edges = hashed_tokens(part)
        out += [values[a:b] if there else None for a, b, there in zip(edges, edges[1:], part.is_valid().to_pylist(), strict=False)]
    return pd.Series(out, dtype=object)


def buckets(text: Column) -> Column:
    """The hashed bag of words as a list with one entry per word; a worker hashes a word it has met once."""
    listed = F.pandas_udf(_bucket_lists, "array<int>")
    return listed(F.lower(text))


def normalised(text: Column) -> Column:
    """Lower case, single spaces, letters a-z, digits and spaces only: the key of a question."""
    single = F.array_join(words(F.lower(text)), " ")
    return F.regexp_replace(single, "[^a-z0-9 ]", "")


def numbers(text: Column) -> Column:
    """Numbers stated in prose as (value, decimals, raw); ISO dates and clock times do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, ISO_DATE, " "), CLOCK_TIME, " ")

    def all_of(group: int) -> Column:
        return F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(group))

    found = F.arrays_zip(
        all_of(0).alias("raw"), all_of(1).alias("whole"), all_of(2).alias("fraction"), all_of(3).alias("suffix")
    )
    power = F.create_map(*[x for k, v in POWERS.items() for x in (F.lit(k), F.lit(v))])

    def claim(m: Column) -> Column:
        exponent = F.coalesce(F.try_element_at(power, F.lower(m["suffix"])), F.lit(0))
        digits = F.concat(F.regexp_replace(m["whole"], ",", ""), m["fraction"])
        decimals = F.greatest(F.length(m["fraction"]) - 1, F.lit(0)) - exponent
        scale = F.when(exponent == 6, 1e6).when(exponent == 9, 1e9).when(exponent == 3, 1e3).otherwise(1.0)
        return F.struct(
            (digits.try_cast("double") * scale).alias("value"), decimals.alias("decimals"), trimmed(m["raw"]).alias("raw")
        )

    return F.transform(found, claim)
