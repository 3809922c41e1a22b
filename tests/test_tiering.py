"""Features, scores and tiers of the supplied customers against plain models in this file."""
import datetime
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import tiering, validation
from basketry.plans.workspace import CUTOFF, Workspace
from tests.conftest import make_raw

SF = "/root/testdata/sf0.001"
LOWER_IS_BETTER = {"recency", "cancel_rate", "regularity"}


@pytest.fixture(scope="module")
def features(spark):
    return Workspace.of(spark, SF).features()


@pytest.fixture(scope="module")
def plain(features):
    """The same customers with shares of the best rank, worked out by counting."""
    rows = [r.asDict() for r in features.collect()]
    for name in tiering.FEATURES:
        known = [r[name] for r in rows if r[name] is not None]
        for r in rows:
            if r[name] is None:
                r[f"pct_{name}"] = 0.0
                continue
            better = sum(v < r[name] if name in LOWER_IS_BETTER else v > r[name] for v in known)
            equal = sum(v == r[name] for v in known)
            r[f"pct_{name}"] = (len(known) - better - (equal - 1) / 2) / len(known)
    for r in rows:
        r["score"] = sum(w * r[f"pct_{f}"] for f, w in tiering.WEIGHTS.items()) / sum(tiering.WEIGHTS.values())
    return {r["customer_id"]: r for r in rows}


def test_percentile_ranks_by_counting(features, plain):
    found = tiering.percentile_ranks(features).collect()
    assert len(found) == len(plain) > 50
    for r in found:
        assert [r[f"pct_{f}"] for f in tiering.FEATURES] == pytest.approx([plain[r.customer_id][f"pct_{f}"] for f in tiering.FEATURES])


def test_scores_and_tiers_by_counting(features, plain):
    scored = tiering.score_customers(features).collect()
    assert {r.customer_id: r.score for r in scored} == pytest.approx({i: r["score"] for i, r in plain.items()})
    reached, edges = 0.0, {}
    for name, part in tiering.TIER_SHARES.items():
        reached += part
        edges[name] = reached
    for place, r in enumerate(sorted(scored, key=lambda r: (-r.score, r.customer_id)), 1):
        assert r.tier == next(t for t, edge in edges.items() if place / len(scored) <= edge + 1e-12)


def test_equal_scores_share_a_standard_rank_and_split_tiers_by_id(spark):
    scored = spark.createDataFrame([(7 * i % 30, [0.9, 0.4][i % 3 == 0]) for i in range(30)], "customer_id int, score double")
    ranks = {r.customer_id: r["rank"] for r in tiering.standard_ranks(scored).collect()}
    scores = {r.customer_id: r.score for r in scored.collect()}
    assert ranks == {c: 1 + sum(s > scores[c] for s in scores.values()) for c in scores}
    tiers = {r.customer_id: r.tier for r in tiering.with_tiers(scored).collect()}
    order = sorted(scores, key=lambda c: (-scores[c], c))
    assert [tiers[c] for c in order[:3]] == ["Tier 1"] * 3 and tiers[order[3]] == "Tier 2" and tiers[order[-1]] == "Tier 4"


def test_explanations_add_up_to_the_score(features, plain):
    scored = tiering.score_customers(features)
    points = {}
    for r in tiering.explain(scored).collect():
        points.setdefault(r.customer_id, []).append((r.points, r.score_100))
    assert len(points) == len(plain)
    assert all(len(p) == 8 and abs(sum(x for x, _ in p) - p[0][1]) <= 0.45 for p in points.values())
    lines = {r.customer_id: r.text for r in tiering.explanation_lines(tiering.explain(scored)).collect()}
    tiers = {r.customer_id: r.tier for r in scored.collect()}
    assert all(text.startswith(f"Customer {c} is in {tiers[c]}") for c, text in lines.items())
    few = next(c for c, r in plain.items() if r["regularity"] is None)
    assert "too few orders" in lines[few]


def test_features_of_lines_before_the_cutoff(spark, features):
    """Every feature of a few customers from their own lines, and what they spend later."""
    ws = Workspace.of(spark, SF)
    chosen = sorted(r.customer_id for r in features.select("customer_id").collect())[::9]
    sales = ws.star("fact_sales").filter(F.col("customer_id").isin(chosen)).toPandas()
    back = ws.star("fact_cancellations").filter(F.col("customer_id").isin(chosen)).toPandas()
    cutoff = datetime.datetime.fromisoformat(CUTOFF)
    later = {r.customer_id: float(r.future_revenue) for r in tiering.future_revenue(ws.star("fact_sales"), CUTOFF, "2000-12-01").collect()}
    found = {r.customer_id: r for r in features.collect()}
    for c in chosen:
        own = sales[(sales.customer_id == c) & (sales.invoice_date < cutoff)]
        lost = back[(back.customer_id == c) & (back.invoice_date < cutoff)].invoice.nunique()
        days = sorted(own.groupby("invoice").invoice_date.min().dt.date)
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        r = found[c]
        assert (r.frequency, r.breadth, r.recency, r.tenure) == (len(days), own.stock_code.nunique(), (cutoff.date() - days[-1]).days, (cutoff.date() - days[0]).days)
        assert r.monetary == pytest.approx(float(own.revenue.sum())) and r.avg_order_value == pytest.approx(r.monetary / len(days))
        assert r.cancel_rate == pytest.approx(lost / (lost + len(days)))
        assert (r.regularity is None) == (len(gaps) < 2)
        if len(gaps) > 1:
            assert r.regularity == pytest.approx(statistics.stdev(gaps))
        after = sales[(sales.customer_id == c) & (sales.invoice_date >= cutoff) & (sales.invoice_date < datetime.datetime(2000, 12, 1))]
        assert later.get(c, 0.0) == pytest.approx(float(after.revenue.sum()))


def test_regularity_counts_orders_of_one_day(spark):
    days = ["1998-07-02", "1998-07-02", "1998-07-02", "1998-07-30", "1998-09-11", "1998-09-11"]
    lines = make_raw(spark, [(f"7{i}", "PART-3", "x", 2, f"{d} 11:{i}0:00", 1.5, 31, "NATION_6") for i, d in enumerate(days)])
    sales = lines.withColumn("revenue", (F.col("quantity") * F.col("price")).cast("decimal(18,3)"))
    found = tiering.features_at(sales, sales.limit(0), "1998-10-01").first()
    assert found.frequency == 6 and found.regularity == pytest.approx(statistics.stdev([0, 0, 28, 43, 0]))


def test_capture_by_counting(spark):
    rng = random.Random(8)
    rows = [("m", i, float(rng.randrange(1000)) + i / 100, rng.randrange(500)) for i in range(40)]
    scores = spark.createDataFrame(rows, "method string, customer_id int, score double, outcome int").withColumn("outcome", F.col("outcome").cast("decimal(24,3)"))
    order = [o for *_, o in sorted(rows, key=lambda r: -r[2])]
    found = validation.captures(validation.rank_methods(scores), {"a": 0.1, "b": 0.35, "c": 1.0}).first()
    assert [found.a, found.b, found.c] == pytest.approx([round(100 * sum(order[:n]) / sum(order), 2) for n in (4, 14, 40)], abs=0.01)
    curve = {r.pct_customers: r.pct_revenue for r in validation.capture_curve(scores).collect()}
    assert len(curve) == 101
    assert all(curve[float(p)] == pytest.approx(100 * sum(order[: math.floor(40 * p / 100 + 1e-9)]) / sum(order)) for p in range(101))


def test_spearman_equals_the_correlation_of_average_ranks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"score": rng.integers(0, 9, 200).astype(float), "outcome": rng.integers(0, 4, 200)})
    rows = [("m", i, float(s), int(o)) for i, (s, o) in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "method string, customer_id int, score double, outcome int").withColumn(
        "outcome", F.col("outcome").cast("decimal(24,3)"))
    want = pdf["score"].rank().corr(pdf["outcome"].rank())
    assert validation.spearman(df).first().spearman == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_implied_weights_by_rounding(spark, seed):
    rng = random.Random(seed)
    coefficients = {f"f{i}": rng.uniform(-0.6, 1.4) for i in range(6)} | {"last": 0.7}
    found = {r.feature: r for r in validation.implied_weights(spark.createDataFrame(list(coefficients.items()), "feature string, coefficient double")).collect()}
    total = sum(max(0.0, c) for c in coefficients.values())
    steps = {f: round(round(max(0.0, c) / total, 3) / 0.05) * 0.05 for f, c in coefficients.items()}
    for f, r in found.items():
        assert r.implied_weight == pytest.approx(max(0.0, coefficients[f]) / total, abs=6e-4)
        assert r.rounded_weight == pytest.approx(steps[f] / sum(steps.values()), abs=6e-4)


def test_learned_models_give_probabilities_with_missing_values(features):
    ranked = tiering.percentile_ranks(features).withColumn("future_revenue", F.col("monetary").cast("decimal(24,3)"))
    train = validation.top_quintile_label(ranked)
    n = train.count()
    assert abs(train.filter("label = 1").count() - n / 5) <= 1 and train.filter("regularity is null").count() > 0
    logistic = validation.predict(validation.fit_logistic(train, n), train, "l")
    trees = validation.fit_trees(validation.with_missing_flag(train), trees=3, depth=2)
    both = logistic.unionByName(validation.predict(trees, validation.with_missing_flag(train), "t"))
    assert both.count() == 2 * n and both.filter("score < 0 or score > 1 or isnan(score)").count() == 0
    gains = [r.gain_share for r in validation.importances(trees, train).collect()]
    assert gains and gains == sorted(gains, reverse=True)


def test_lines_are_grouped_before_they_are_handed_to_cutoffs(spark):
    lines = spark.sql("""SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ '1999-01-01 10:00:00', 'P1', 2.000BD), (1, 'a', TIMESTAMP_NTZ '1999-03-01 00:00:00', 'P2', 3.000BD),
        (1, 'b', TIMESTAMP_NTZ '1999-02-01 00:00:00', 'P1', 5.000BD), (2, 'c', TIMESTAMP_NTZ '1999-02-01 09:00:00', 'P1', 7.000BD), (2, 'd', NULL, 'P9', 1.000BD),
        (3, 'e', TIMESTAMP_NTZ '1999-04-01 00:00:00', 'P1', 1.000BD) t(customer_id, invoice_id, invoiced_at, product_code, revenue)""")
    found = tiering.feature_snapshots(lines, lines.filter("invoice_id = 'a'"), ["1999-04-01", "1999-02-01"])
    rows = {(str(r.cutoff_date), r.customer_id): (r.frequency, r.monetary, r.breadth, round(r.cancel_rate, 3), r.recency, r.tenure) for r in found.collect()}
    assert rows == {
        ("1999-02-01", 1): (1, 2.0, 1, 0.5, 31, 31), ("1999-04-01", 1): (2, 10.0, 2, 0.333, 59, 90), ("1999-04-01", 2): (1, 7.0, 1, 0.0, 59, 59),
    }
    plan = [x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "Generate" in x or "Aggregate" in x]
    deepest = max(plan, key=lambda x: len(x) - len(x.lstrip(" :+-")))
    assert "Aggregate" in deepest
