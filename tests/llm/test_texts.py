"""Encoding, license notices, fingerprints and quality rules against plain models of their contracts."""
import hashlib
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import bpe, fingerprint, license_scan, quality_rules
from basketry.llm.tables import table

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(BYTE_BPE)


PARTS = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "a", "don't", "'ll", "123", "é", "é", "ß", "日本", "😀", "<|endoftext|>", "<|", ".", "!!", "​", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_encoding_is_the_librarys(text):
    library, coder = Tokenizer.from_file(BYTE_BPE), bpe.codec(BYTE_BPE)
    ids = library.encode(text, add_special_tokens=False).ids
    coded = coder.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == ids
    assert coder.decode(coded) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000, "\n" * 500 + "x", "日" * 2000])
def test_long_pieces(library, coder, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_letters_are_distinct_and_printable():
    letters = bpe.byte_letters()
    assert len(set(letters)) == 256 and letters[ord("A")] == "A" and all(c.isprintable() for c in letters)


def test_digests(spark, library, odd, nothing):
    assert bpe.digests(nothing, BYTE_BPE).count() == 0
    rows = bpe.digests(odd, BYTE_BPE).collect()
    want = []
    for doc_id, text in odd.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_encode_and_decode_are_inverse(odd):
    back = bpe.decode(bpe.encode(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), BYTE_BPE), BYTE_BPE)
    want = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    assert all(want[r.doc_id] == r.text for r in back.collect())


def _base_model(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


LICENSED = [
    "Released under the MIT License.", "MIT-License mit license MIT\nLICENSE", "Apache License apache  license x general public license", "apache licenses", "mit license" * 3,
    "Relaesed undr the MIT Licence", "Licensed under CC BY-NC 4.0.", "", None, "Ünder the ﬁ mit license é",
]


def test_license_base_counts(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string"))
    want = sorted((str(r.doc_id), *map(str, _base_model(r.text))) for r in docs.collect())
    got = sorted((str(r.doc_id), str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word), r.base_labels) for r in license_scan.scan(docs).collect())
    assert got == want


@pytest.mark.parametrize("text, want", [
    ("all rights reservd all rights reserved", [(0, 2, 1), (3, 5, 0)]),
    ("all rights reserved all rights reservd", [(0, 2, 0), (3, 5, 1)]),
    ("x all right reserved foo all rights reserved all rigths reserved", [(1, 3, 1), (5, 7, 0), (8, 10, 2)]),
    ("all rights reservd all right reserved all rights reserved", [(0, 2, 1), (3, 5, 1), (6, 8, 0)]),
])
def test_notices_close_together_are_all_reported(text, want):
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, license_scan.CHARS_PER_EDIT)
    found = sorted((first, last, edits) for first, last, _, edits, _ in scanner.fuzzy(license_scan.normalised(text.encode())))
    assert found == want


def test_license_notices_with_edits(spark, nothing):
    assert license_scan.scan(nothing).count() == 0
    texts = ["Here: Relesed undr the MIT Licence today", "released under the mit license", "all rights resrvd", "nothing of the kind, all writes observed", "released under the full moon"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "mit", "reserved", "", ""]
    first = rows[0].spans[0]
    assert (first.first_word, first.last_word) == (1, 5) and 0 < first.edits <= 3
    assert rows[1].score == 1.0 and 0.8 < rows[0].score < 1.0 and rows[3].score == 0.0


def _edited(rng, marked):
    """A notice with as many changed letters in each part of its frame as it may have."""
    out = []
    for i, part in enumerate(re.split(r"( ?\{[^}]*\} ?)", marked)):
        part = part.replace("{", "").replace("}", "")
        letters = list(part)
        allowed = 0 if i % 2 or len(part) < license_scan.LEAST_EDITED else max(1, len(part) // license_scan.CHARS_PER_EDIT)
        for at in rng.sample(range(1, len(part) - 1), allowed) if allowed else []:
            if letters[at] != " ":
                letters[at] = rng.choice("qxz")
        out.append("".join(letters))
    return "".join(out)


def test_every_notice_is_found_with_all_its_edits_and_under_no_other_label():
    rng = random.Random(3)
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, license_scan.CHARS_PER_EDIT)
    for marked, label in license_scan.NOTICES:
        for text in [marked.replace("{", "").replace("}", "")] + [_edited(rng, marked) for _ in range(20)]:
            words = license_scan.normalised(("so it is " + text + " here").encode())
            assert {x[2] for x in scanner.fuzzy(words)} == {label}, text


@pytest.mark.parametrize("text", [
    "released under the bsd license", "released under the gpl license", "released under the limit license", "licensed under cc by nd 4 0",
    "this work is licensed under the gnu lesser general public license version 3", "licensed under the apaches license version 2 0"])
def test_other_licences_get_no_label(text):
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, license_scan.CHARS_PER_EDIT)
    assert scanner.fuzzy(license_scan.normalised(text.encode())) == []


def test_of_overlapping_matches_the_nearest_stays():
    found = [(0, 4, "a", 2, 30), (3, 7, "b", 0, 20), (8, 9, "c", 1, 10), (7, 9, "d", 1, 12), (5, 6, "e", 3, 9)]
    assert license_scan._apart(found) == [(3, 7, "b", 0, 20), (8, 9, "c", 1, 10)]


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_fingerprints_against_exact_similarity(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = {r.doc_id: r for r in fingerprint.compare_neighbours(docs).collect()}
    texts = dict(docs.orderBy("doc_id").collect())
    ids = sorted(texts)
    assert len(rows) == len(ids)
    for i, doc_id in enumerate(ids):
        own, following, row = texts[doc_id], texts[ids[(i + 1) % len(ids)]], rows[doc_id]
        n = len(own) // 2
        changed = own[: len(own) - n] + following[:n]
        assert row.n_chars == len(own) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, estimate in ((changed, row.near_edited), (following, row.near_next)):
            a, b = _shingles(own), _shingles(other)
            assert abs(len(a & b) / len(a | b) - estimate) < 0.15 and 0 <= estimate <= 1
    by_text = {}
    assert all(by_text.setdefault(texts[i], rows[i].fingerprint) == rows[i].fingerprint for i in ids)


def test_fingerprints_of_odd_rows(odd, nothing):
    assert fingerprint.compare_neighbours(nothing).count() == 0
    rows = fingerprint.compare_neighbours(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == "" and by_id[2].near_next == 1.0 and by_id[4].near_next == 1.0
    alone = fingerprint.compare_neighbours(odd.filter("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_range_of_counts_bounds(spark):
    bounds = [3, 7, 8, 20, 21, 22, 40]
    got = spark.range(50).select("id", fingerprint._range_of(F.col("id"), bounds).alias("part")).collect()
    assert all(r.part == sum(b < r.id for b in bounds) for r in got)


def _quality_model(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, odd, nothing):
    assert quality_rules.measure(nothing).count() == 0
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((str(r.doc_id), *_quality_model(r.text)) for r in docs.collect())
    got = quality_rules.measure(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_lines(spark, odd, nothing):
    text = "Home | News | About\nThis is a sentence that ends as sentences should end, with a full stop.\nSign up.\n### $$$ %%% &&& a\nAnother whole sentence stands here and it is kept as well."
    docs = spark.createDataFrame([(1, text, 0, "x")], "doc_id long, text string, n_chars long, r string")
    row = quality_rules.clean(docs).collect()[0]
    assert row.text.split("\n") == [text.split("\n")[1], text.split("\n")[4]] and row.n_chars == len(row.text) and row.r == "x"
    assert quality_rules.clean(odd).columns == odd.columns and quality_rules.clean(nothing).count() == 0


@pytest.mark.parametrize("text", [
    "When the ship came in at last the whole town went down to the harbour to see what it had brought. Nobody had slept. "
    "Old Peter from the Northern Quay, who had waited longest, stood in front. He said nothing. The Captain waved and the crew began to unload, "
    "crate after crate, until the sun was low and the smell of oranges hung over the water and the houses behind it.",
    "Der Wind kam aus Norden und die Boote lagen still im Hafen. Am Abend erzählten die Alten von der Zeit, als Die Brücke noch aus Holz war. "
    "Keiner wollte glauben, dass man damals für einen Taler hinüberfuhr und am Ende der Fahrt noch Geld zurückbekam.",
])
@pytest.mark.parametrize("width", [66, 50, 34])
def test_wrapped_prose_is_judged_like_its_paragraph(spark, text, width):
    wrapped = "\n".join(textwrap.wrap(text, width))
    rows = quality_rules.measure(spark.createDataFrame([(1, text), (2, wrapped)], "doc_id long, text string")).collect()
    assert all(r.kept and r.chars_left > 0.6 * r.word_chars for r in rows)


def test_rules_are_evaluated_once_where_documents_are_cleaned(spark, odd):
    plan = quality_rules.clean(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("skip to content") == 1


def test_quality_keeps_good_documents(spark):
    judged = quality_rules.measure(table(spark, "/root/testdata/sf0.01", "documents")).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    shares = {r.quality: r.share for r in judged.filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] == 1.0 and shares.get(0, 0.0) < 0.1
