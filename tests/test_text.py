"""Text expressions against small Python models."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import text


def test_chunks_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(40))
    bodies = ["", "  ", "one two\n\nthree", "a b c\n\nd e f\n \ng h i", long]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    found = {r.i: r.c for r in df.select("i", text.chunks(F.col("body"), 6).alias("c")).collect()}
    assert found[0] == [] and found[1] == [] and found[2] == ["one two three"] and found[3] == ["a b c d e f", "g h i"]


@pytest.mark.parametrize("size", [32, 64])
def test_chunks_keep_every_word_in_order(spark, size):
    """No chunk beyond the size, whole paragraphs together where they fit, and windows of long ones overlap."""
    rng = random.Random(5)
    bodies = []
    for _ in range(40):
        lengths = [rng.choice([1, 3, 7, 20, 31]) for _ in range(rng.randrange(1, 7))]
        names = iter(range(10_000))
        bodies.append("\n\n".join(" ".join(f"w{next(names)}" for _ in range(n)) for n in lengths))
    bodies.append(" ".join(f"w{i}" for i in range(200)))
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    for r in df.select("i", text.chunks(F.col("body"), size).alias("c")).collect():
        words = [c.split() for c in r.c]
        assert all(len(w) <= size for w in words)
        if r.i < 40:
            assert [w for c in words for w in c] == bodies[r.i].split()
            paragraphs = [p.split() for p in bodies[r.i].split("\n\n")]
            starts = {p[0]: len(p) for p in paragraphs}
            assert all(c[0] in starts for c in words)
            assert all(len(a) + starts[b[0]] > size for a, b in zip(words, words[1:]))  # packing is maximal
        else:
            assert all(a[-16:] == b[:16] for a, b in zip(words, words[1:])) and words[-1][-1] == "w199"


def test_whole_document_is_one_chunk(spark):
    df = spark.createDataFrame([("a\n\nb",)], "body string")
    assert df.select(text.chunks(F.col("body"), None)).first()[0] == ["a\n\nb"]


def test_buckets_equal_md5_modulo(spark):
    words = ["revenue", "churn", "x", "2011", "a" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = [r[0] for r in df.select(text.bucket(F.col("w"))).collect()]
    assert found == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 384 for w in words]


def test_numbers(spark):
    said = "AOV £445.60, up 5.2%, £17.1 million total, 1,168 orders on 2011-09-30 12:50:00 at 9:30"
    found = spark.createDataFrame([(said,)], "t string").select(text.numbers(F.col("t"))).first()[0]
    assert [(n.raw, n.value, n.decimals) for n in found] == [
        ("£445.60", 445.6, 2), ("5.2%", 5.2, 1), ("£17.1 million", 17_100_000.0, -5), ("1,168", 1168.0, 0),
    ]


def test_normalised(spark):
    df = spark.createDataFrame([("  What WAS\n the  revenue, in 2011?? ",)], "t string")
    assert df.select(text.normalised(F.col("t"))).first()[0] == "what was the revenue in 2011"


def test_codes_are_not_numbers(spark):
    df = spark.createDataFrame([(v,) for v in ["10D", "1.5", "-2e3", "85123A", ".5", "7f"]], "t string")
    assert [r[0] for r in df.select(text.as_number(F.col("t"))).collect()] == [None, 1.5, -2000.0, None, 0.5, None]
