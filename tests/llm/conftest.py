import pytest

LONG = "the quick brown fox jumps over the lazy dog and runs far away. " * 3000
CLASHES = {"ids": "x", "part": 3, "tail": 1, "label": "l", "n": 9, "digest": "d", "r": "r", "d": "d", "f": "f", "shown": "s", "band": 1, "listed": True, "shard": 5, "word": "w"}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and clashing column names."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "src0", 62),
        (2, "", "en", "src0", 0),
        (3, None, None, None, None),
        (None, "Words without any id stand here, quite alone in the table.", "en", None, None),
        (4, LONG, "en", "src1", len(LONG)),
        (5, LONG, "en", "src2", len(LONG)),
        (6, "Eins zwei drei.", "de", "src0", 15),
        (6, "Eins zwei drei.", "de", "src0", 15),
        (7, "   \n\t \n", "en", "src0", 6),
        (8, "42 %%% 17 ... 99", None, "src9", 16),
        (9, 'Ünïcödé 😀 text with token = "0123456789abcdef0123456789abcdef01234567" inside it.', "de", "tests/x", 80),
    ]
    names = ", ".join(f"`{k}` {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in CLASHES.items())
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    return spark.createDataFrame([r + tuple(CLASHES.values()) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
