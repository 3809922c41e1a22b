"""Every registered query at the smallest scale, against its checking SQL where there is one."""
import pytest

import __spark_entry__ as entry
from basketry.plans import catalogue
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in catalogue.QUERIES}
ORACLES = catalogue.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        verdict = compare(df, con, ORACLES[name])
        assert verdict.startswith("ok"), verdict
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {
        "v7_logistic_scores", "v8_boosted_tree_scores", "v9_gain_importance", "v11_learned_weights", "v11_rounded_method", "v15_learned_verdict",
        "e13_numbers_in_prose",
    }


def test_learned_scores_and_gains(spark):
    """One probability per customer and model; gains are shares, biggest first; every model is judged."""
    customers = QUERIES["f9_percentile_ranks"](spark, SF).count()
    for name, models in (("v7_logistic_scores", 1), ("v8_boosted_tree_scores", 3)):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == models * customers == len({(r.method, r.customer_id) for r in rows})
        assert all(0 <= r.score <= 1 for r in rows)
    gains = QUERIES["v9_gain_importance"](spark, SF).collect()
    by_model = {}
    for r in gains:
        by_model.setdefault(r.method, []).append(r.gain_share)
    assert len(by_model) == 2 and all(len(g) == 5 and sorted(g, reverse=True) == g and 0.5 < sum(g) <= 1 + 1e-9 for g in by_model.values())
    assert len(QUERIES["v15_learned_verdict"](spark, SF).collect()) == 4 and len(QUERIES["v11_rounded_method"](spark, SF).collect()) == 4
