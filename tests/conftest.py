import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketry.session import local_session  # noqa: E402
from basketry.sources.retail import RAW_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", shuffle_partitions=8)
    yield session
    session.stop()


def make_raw(spark, rows):
    """Raw lines from (invoice, code, description, quantity, day, price, customer, country)."""
    typed = [
        (i, s, d, q, datetime.datetime.fromisoformat(t), Decimal(str(p)), c, country)
        for i, s, d, q, t, p, c, country in rows
    ]
    return spark.createDataFrame(typed, RAW_SCHEMA)


@pytest.fixture(scope="session")
def raw(spark):
    """Two lines that stay, one cancellation, and one line or more for every cleaning rule."""
    spring, may = "1999-03-02 08:30:00", "1999-05-17 16:05:00"
    almond = ("4002", "PART-9", "almond", 4, may, 0.5, 12, "NATION_5")
    return make_raw(spark, [
        ("4001", "PART-7", "linen", 3, spring, 2.25, 11, "NATION_2"),
        almond, almond, almond,                                              # given three times
        ("C4003", "PART-7", "linen", -2, may, 2.25, 11, "NATION_2"),         # cancelled
        ("4004", "PART-7", "linen", 1, spring, 2.25, None, "NATION_2"),      # nobody's
        ("4005", "PART-9", "almond", 0, spring, 0.5, 12, "NATION_5"),        # nothing sold
        ("4006", "PART-9", "almond", 2, spring, 0.0, 12, "NATION_5"),        # without a price
        ("4007", "PART-9", "almond", 2, may, 0.0, 11, "NATION_2"),
        ("4008", "BANK CHARGES", "fee", 1, may, 15.0, 12, "NATION_5"),       # no products
        ("4009", "TEST002", "trial", 1, may, 3.0, 11, "NATION_2"),
        ("4010", "ADJUST", "Adjustment", 1, may, 9.0, 11, "NATION_2"),
    ])
