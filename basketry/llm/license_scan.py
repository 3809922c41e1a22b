"""License notices in whole texts: fixed phrases word by word, and short notices with a few edits.

A notice is a frame around its key words, which alone tell one licence from another: "released under the {mit} license".
Key words must stand as they are; each part of the frame may have an edit for every ``CHARS_PER_EDIT`` characters,
one at least if it is a word or more.

Fuzzy search: a frame part that may have k edits is cut into k + 1 seeds; at most k edits leave at least one seed
intact (pigeonhole), so the exact occurrences of the seeds of a notice's longest part are all places the notice can be.
Around each the regex library searches the notice with at most k errors in each part and reports its span and edits. It
takes the best match of the place first; what stands before and after that is searched again, until nothing more is
found. Where notices overlap the one with the least edits stays, of equal ones the longest.

Texts are lower-cased (A-Z) and reduced to words, runs of digits, letters a-z and characters beyond ASCII,
joined by one space; word positions count from 0, spans are word ranges. Null texts count as empty: no words,
no places, empty labels, score 0. Nothing is looked up between rows, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import mapped

#: Phrases that count word by word, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices in common use with their key words in braces, and their labels.
NOTICES = (
    ("released under the {mit} license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the {apache} license version 2 0", "apache"),
    ("this work is licensed under the {gnu general public} license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the {mozilla public} license", "mpl"),
    ("licensed under {cc by nc 4 0}", "cc-by-nc"),
    ("licensed under {cc by sa 4 0}", "cc-by-sa"),
    ("licensed under {cc by 4 0}", "cc-by"),
    ("licensed under a {creative commons} attribution", "cc"),
    ("all rights reserved", "reserved"),
)
#: One edit is allowed for so many characters of a part of a notice, and one in parts of ``LEAST_EDITED`` or more.
CHARS_PER_EDIT, LEAST_EDITED = 9, 6


def _word_table() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    lower = {b: b + 32 for b in range(0x41, 0x5B)}
    return bytes(b if b in keep else lower.get(b, 0x20) for b in range(256))


_WORD_BYTES = _word_table()


def normalised(data: bytes) -> bytes:
    """Lower-cased words with one space before, between and after them; only a space when there are none."""
    words = data.translate(_WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[int, str], ...]
    pattern: regex.Pattern


def notice(marked: str, label: str, chars_per_edit: int = CHARS_PER_EDIT) -> Notice:
    """A notice whose key words are in braces; seeds have their distance from the notice's start."""
    parts = re.split(r"( ?\{[^}]*\} ?)", marked)
    text, pattern, edits, frames = "", "(?b)", 0, []
    for i, part in enumerate(parts):
        key = i % 2 == 1
        plain = part.replace("{", "").replace("}", "") if key else part
        allowed = 0 if key or len(plain) < LEAST_EDITED else max(1, len(plain) // chars_per_edit)
        # Key words end where words end, also at the end of the notice.
        exact = ("" if plain.startswith(" ") else "(?<= )") + regex.escape(plain, literal_spaces=True) + ("" if plain.endswith(" ") else "(?= )")
        pattern += exact if key else f"(?:{regex.escape(plain, literal_spaces=True)}){{e<={allowed}}}" if plain else ""
        frames += [] if key else [(len(plain), len(text), plain, allowed)]
        text, edits = text + plain, edits + allowed
    size, start, longest, allowed = max(frames)
    cuts = [round(k * size / (allowed + 1)) for k in range(allowed + 2)]
    seeds = tuple((start + a, longest[a:b]) for a, b in zip(cuts, cuts[1:]))
    return Notice(text, label, edits, seeds, regex.compile(pattern.encode()))


def matches(pattern: regex.Pattern, words: bytes, start: int, end: int, least: int) -> Iterator[regex.Match]:
    """Best match of a range, then those of the parts on both sides; no match is shorter than ``least``."""
    parts = [(start, end)]
    while parts:
        start, end = parts.pop()
        if end - start >= least and (m := pattern.search(words, start, end)):
            yield m
            parts += [(start, m.start()), (m.end(), end)]


def _apart(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Of matches that overlap those with the least edits, of equal ones the longest, of equal ones the first."""
    firsts: list[int] = []
    kept: list[tuple[int, int, str, int, int]] = []
    for match in sorted(found, key=lambda x: (x[3], -x[4], x)):
        at = bisect(firsts, match[0])
        if (at == 0 or kept[at - 1][1] < match[0]) and (at == len(kept) or match[1] < kept[at][0]):
            firsts.insert(at, match[0])
            kept.insert(at, match)
    return kept


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], chars_per_edit: int) -> None:
        self.phrases = [(f" {p} ".encode(), label, len(p.split())) for p, label in phrases]
        self.notices = [notice(t, label, chars_per_edit) for t, label in notices]
        by_seed: dict[bytes, list[tuple[Notice, int]]] = {}
        for n in self.notices:
            for at, seed in n.seeds:
                by_seed.setdefault(seed.encode(), []).append((n, at))
        self.by_seed = by_seed

    def base(self, words: bytes) -> list[tuple[int, str, int]]:
        """(first word, label, number of words) of every place of a phrase."""
        found = []
        for phrase, label, n in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                found.append((words.count(b" ", 0, at), label, n))
                at = words.find(phrase, at + 1)
        return found

    def fuzzy(self, words: bytes) -> list[tuple[int, int, str, int, int]]:
        """(first word, last word, label, edits, notice length) of the notices found with at most their edits."""
        windows: dict[str, list[list[int]]] = {}
        kinds: dict[str, Notice] = {}
        for seed, owners in self.by_seed.items():
            at = words.find(seed)
            while at >= 0:
                for n, offset in owners:
                    start, end = at - offset - n.edits, at - offset + len(n.text) + n.edits
                    windows.setdefault(n.text, []).append([max(0, start), min(len(words), end)])
                    kinds[n.text] = n
                at = words.find(seed, at + 1)
        found = []
        for text, spans in windows.items():
            n = kinds[text]
            merged: list[list[int]] = []
            for start, end in sorted(spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            for start, end in merged:
                for m in matches(n.pattern, words, start, end, len(n.text) - n.edits):
                    a, b = m.span()
                    while a < b and words[a : a + 1] == b" ":
                        a += 1
                    while b > a and words[b - 1 : b] == b" ":
                        b -= 1
                    found.append((words.count(b" ", 0, a) - 1, words.count(b" ", 0, b) - 1, n.label, sum(m.fuzzy_counts), len(text)))
        return _apart(found)


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, n_fuzzy long, spans array<struct<first_word: long, last_word: long, label: string, edits: int>>"
)


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """One row per row of ``docs``: word and phrase counts, labels, the fuzzy notices' spans, and a score.

    ``first_word`` and ``last_word`` are the smallest and largest start of a phrase. The score is 1 when a
    phrase stands word by word, else the best notice's share of characters without edits, else 0.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_fuzzy", pa.int64()),
        ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for batch in batches:
            rows = []
            for data in batch.column(1):
                words = normalised(data.as_py() or b"")
                base, fuzzy = scanner.base(words), scanner.fuzzy(words)
                starts = [x[0] for x in base]
                base_labels = {x[1] for x in base}
                score = 1.0 if base else max((1 - edits / length for _, _, _, edits, length in fuzzy), default=0.0)
                spans = [dict(zip(("first_word", "last_word", "label", "edits"), x[:4])) for x in sorted(fuzzy)]
                rows.append((
                    words.count(b" ") - 1, len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x[2] for x in fuzzy})), score, len(fuzzy), spans,
                ))
            columns = list(zip(*rows)) or [()] * (len(schema) - 1)
            arrays = [batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return mapped(slim, run, _SCHEMA)
