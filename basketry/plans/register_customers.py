"""Registered customer products: RFM segments, features, score, tiers, explanations and their validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from basketry.operators import rfm, sweeps, tiering, trees, validation
from basketry.operators.tiering import FEATURES
from basketry.plans import oracle
from basketry.plans.oracle import features_sql, using
from basketry.plans.registry import register
from basketry.plans.workspace import CUTOFF, TRAIN_CUTOFF, Workspace

# ---- RFM --------------------------------------------------------------------------------------------

_RFM = """
rfm AS (SELECT customer_id,
               CAST(floor(epoch((SELECT max(invoice_date) FROM sales) + INTERVAL 1 DAY - max(invoice_date)) / 86400) AS BIGINT) AS recency,
               count(DISTINCT invoice) AS frequency, sum(revenue) AS monetary
        FROM sales GROUP BY customer_id)"""
_SCORED_RFM = _RFM + """,
edges AS (SELECT quantile_cont(recency::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS re,
                 quantile_cont(monetary::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS me, count(*) AS n FROM rfm),
rfm_scored AS (
  SELECT customer_id, recency, frequency, monetary,
         CAST(5 - len(list_filter(re, lambda e: recency > e)) AS INTEGER) AS r,
         CAST(1 + len(list_filter([1, 2, 3, 4], lambda k: place > 1 + k * (n - 1) / 5.0)) AS INTEGER) AS f,
         CAST(1 + len(list_filter(me, lambda e: monetary::DOUBLE > e)) AS INTEGER) AS m
  FROM (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS place FROM rfm), edges)"""
_SEGMENTED = _SCORED_RFM + """,
segmented AS (
  SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN f >= 4 AND r >= 3 THEN 'Loyal'
                 WHEN r >= 4 AND f <= 3 THEN 'Potential' WHEN r <= 2 AND f >= 3 THEN 'At-Risk'
                 WHEN r <= 2 AND f <= 2 AND m >= 3 THEN 'Hibernating' WHEN r <= 2 THEN 'Lost' ELSE 'Other' END AS segment
  FROM rfm_scored)"""


def _raw_rfm(ws: Workspace):
    """One aggregate over the fact, written for the three orderings and every query on them."""
    return ws.written("raw_rfm", lambda: rfm.raw_rfm(ws.star("fact_sales")))


def _rfm(ws: Workspace):
    return ws.written("rfm", lambda: rfm.with_segment(rfm.score_rfm(_raw_rfm(ws))))


def _in_double(df, *columns):
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


@register("r1_raw_rfm", using("sales", f"WITH {_RFM} SELECT customer_id, recency, frequency, monetary::DOUBLE AS monetary FROM rfm"))
def r1(ws: Workspace):
    return _in_double(_raw_rfm(ws), "monetary")


@register("r2_recency_monetary_quintiles", using("sales", f"WITH {_SCORED_RFM} SELECT customer_id, r, m FROM rfm_scored"))
def r2(ws: Workspace):
    return rfm.score_rfm(_raw_rfm(ws)).select("customer_id", "r", "m")


@register("r3_frequency_rank_quintile", using("sales", f"WITH {_SCORED_RFM} SELECT customer_id, frequency, f FROM rfm_scored"))
def r3(ws: Workspace):
    return rfm.score_rfm(_raw_rfm(ws)).select("customer_id", "frequency", "f")


@register("r4_segments", using("sales", f"WITH {_SEGMENTED} SELECT customer_id, r, f, m, segment FROM segmented"))
def r4(ws: Workspace):
    return _rfm(ws).select("customer_id", "r", "f", "m", "segment")


@register("r5_segment_summary", using("sales", f"""WITH {_SEGMENTED}
SELECT CAST(list_position(['Champions', 'Loyal', 'Potential', 'At-Risk', 'Hibernating', 'Lost', 'Other'], segment) AS BIGINT) AS place,
       segment, count(*) AS customers, half_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM segmented), 1) AS pct_customers,
       CAST(half_even(sum(monetary), 0) AS BIGINT) AS revenue,
       half_even(100.0::DOUBLE * sum(monetary)::DOUBLE / (SELECT sum(monetary) FROM segmented)::DOUBLE, 1) AS pct_revenue,
       half_even(sum(recency)::DOUBLE / count(*), 0) AS avg_recency, half_even(sum(frequency)::DOUBLE / count(*), 1) AS avg_frequency
FROM segmented GROUP BY segment"""))
def r5(ws: Workspace):
    return rfm.segment_summary(_rfm(ws))


@register("r6_recheck_sample", using("sales", f"""WITH {_RFM}
SELECT customer_id, recency, frequency, monetary::DOUBLE AS monetary, true AS same
FROM rfm ORDER BY md5('42:' || customer_id), customer_id LIMIT 2"""))
def r6(ws: Workspace):
    return rfm.recheck(ws.star("fact_sales"), _raw_rfm(ws))


# ---- features ---------------------------------------------------------------------------------------

_BEFORE = f"invoice_date < DATE '{CUTOFF}'"


@register("f1_orders_before_cutoff", using("sales", f"""
SELECT customer_id, invoice, min(invoice_date)::DATE AS order_day, sum(revenue)::DOUBLE AS order_value
FROM sales WHERE {_BEFORE} GROUP BY 1, 2"""))
def f1(ws: Workspace):
    return tiering.orders_before(ws.star("fact_sales"), CUTOFF).select(
        "customer_id", "invoice", F.to_date("order_ts").alias("order_day"),
        F.col("order_value").cast("double").alias("order_value"),
    )


def _feature_query(name: str, columns: list[str]) -> None:
    listed = ", ".join(["customer_id", *columns])

    def product(ws: Workspace):
        found = tiering.features_at(ws.star("fact_sales"), ws.star("fact_cancellations"), CUTOFF)
        return found.select("customer_id", *columns)

    register(name, using("features", f"SELECT {listed} FROM features"))(product)


_feature_query("f2_recency_tenure", ["recency", "tenure"])
_feature_query("f3_frequency_monetary", ["frequency", "monetary", "avg_order_value"])
_feature_query("f4_breadth", ["breadth"])
_feature_query("f5_cancel_rate", ["cancel_rate"])
_feature_query("f7_regularity", ["regularity"])


@register("f6_order_gaps", using("sales", f"""
SELECT customer_id, count(*) AS gaps, CAST(sum(g) AS BIGINT) AS gap_days, CAST(sum(g * g) AS BIGINT) AS gap_days_squared, max(g) AS longest
FROM (SELECT customer_id, date_diff('day', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts), ts) AS g
      FROM (SELECT customer_id, min(invoice_date) AS ts FROM sales WHERE {_BEFORE} GROUP BY customer_id, invoice))
WHERE g IS NOT NULL GROUP BY customer_id"""))
def f6(ws: Workspace):
    days = tiering.order_days(tiering.orders_before(ws.star("fact_sales"), CUTOFF), ["customer_id"])
    gap = F.col("gap_days")
    per = days.groupBy("customer_id").agg(
        (F.sum("orders") - 1).alias("gaps"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("gap_days"),
        F.coalesce(F.sum(gap * gap), F.lit(0)).alias("gap_days_squared"),
        F.coalesce(F.max(gap), F.lit(0)).alias("longest"),
    )
    return per.filter("gaps > 0")


#: The first of every month of five years.
MONTHLY_CUTOFFS = [f"{year}-{month:02d}-01" for year in range(1996, 2001) for month in range(1, 13)]


@register("m10_features_every_month", using("sales cancellations", f"SELECT * FROM ({features_sql('sales', 'cancellations', MONTHLY_CUTOFFS)})"))
def m10_monthly(ws: Workspace):
    """Features at sixty cutoffs from one ordering of the facts."""
    return sweeps.features_as_of(ws.star("fact_sales"), ws.star("fact_cancellations"), MONTHLY_CUTOFFS)


@register("f8_future_revenue", using("features future", """
SELECT customer_id, coalesce(future_revenue, 0)::DOUBLE AS future_revenue FROM features LEFT JOIN future USING (customer_id)"""))
def f8(ws: Workspace):
    return _in_double(tiering.with_outcome(ws.features().select("customer_id"), ws.future()), "future_revenue")


_PCT = [f"pct_{f}" for f in FEATURES]
_CONTRIB = [f"contrib_{f}" for f in FEATURES]


@register("f9_percentile_ranks", using("ranked_features", f"SELECT customer_id, {', '.join(_PCT)} FROM ranked_features"))
def f9(ws: Workspace):
    return tiering.percentile_ranks(ws.features()).select("customer_id", *_PCT)


@register("f10_weighted_score", using("scored", f"SELECT customer_id, {', '.join(_CONTRIB)}, score FROM scored"))
def f10(ws: Workspace):
    return tiering.weighted(tiering.percentile_ranks(ws.features())).select("customer_id", *_CONTRIB, "score")


@register("f11_tiers", using("scored", "SELECT customer_id, score, score_rank, tier FROM scored"))
def f11(ws: Workspace):
    return tiering.with_tiers(ws.scored().drop("score_rank", "tier")).select("customer_id", "score", "score_rank", "tier")


def _explain_sql() -> str:
    parts = [
        f"SELECT customer_id, tier, score, '{f}' AS feature, '{tiering.LABELS[f]}' AS label, {f}::DOUBLE AS value,"
        f" half_even(100.0::DOUBLE * pct_{f}, 1) AS percentile, {round(w / oracle.TOTAL, 3)!r}::DOUBLE AS weight,"
        f" half_even(100.0::DOUBLE * contrib_{f}, 1) AS points FROM scored"
        for f, w in zip(FEATURES, oracle.WEIGHTS)
    ]
    return f"""WITH places AS (SELECT customer_id, rank() OVER (ORDER BY score DESC) AS rank, count(*) OVER () AS customers FROM scored)
SELECT customer_id, tier, half_even(100.0::DOUBLE * score, 1) AS score_100, rank, customers, feature, label, value, percentile, weight, points
FROM ({' UNION ALL '.join(parts)}) JOIN places USING (customer_id)"""


@register("f12_explain", using("scored", _explain_sql()))
def f12(ws: Workspace):
    return tiering.explain(ws.scored())


def _explanation_sql() -> str:
    shown = "coalesce(regexp_replace(regexp_replace(format('{:,.2f}', value), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), 'too few orders')"
    return f"""WITH e AS ({_explain_sql()}), l AS (
  SELECT *, CASE WHEN weight > 0 THEN printf('- %-32s %14s, percentile %5.1f with weight %.2f: %5.1f points', label, {shown}, percentile, weight, points)
                 ELSE printf('- %-32s %14s, percentile %5.1f without weight', label, {shown}, percentile) END AS line,
         list_position([{', '.join(f"'{f}'" for f in FEATURES)}], feature) AS place FROM e)
SELECT customer_id, printf('Customer %d is in %s with %.1f of 100 points, place %s of %s', customer_id, any_value(tier), any_value(score_100),
                           format('{{:,}}', any_value(rank)), format('{{:,}}', any_value(customers)))
       || chr(10) || string_agg(line, chr(10) ORDER BY points DESC, place) AS text
FROM l GROUP BY customer_id"""


@register("f12_explanation_text", using("scored", _explanation_sql()))
def f12_text(ws: Workspace):
    return tiering.explanation_lines(tiering.explain(ws.scored()))


@register("f13_compare_features", using("features", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS compared, 0::BIGINT AS mismatches FROM features" for f in FEATURES)))
def f13(ws: Workspace):
    direct = tiering.features_at(ws.star("fact_sales"), ws.star("fact_cancellations"), CUTOFF)
    return tiering.compare_features(ws.features(), direct)


@register("f14_compare_tiers", using("scored faulty_scored", """
SELECT count(*) AS customers, count(*) FILTER (WHERE a.tier IS DISTINCT FROM b.tier) AS tier_mismatches,
       count(*) FILTER (WHERE a.score IS DISTINCT FROM b.score) AS score_mismatches,
       max(abs(a.score - b.score)) AS max_abs_difference
FROM scored a FULL JOIN faulty_scored b USING (customer_id)"""))
def f14(ws: Workspace):
    return tiering.compare_scores(ws.scored(), ws.faulty_scored())


# ---- validation -------------------------------------------------------------------------------------

HAND, MONEY, EQUAL = "Hand-weighted score", "Monetary only", "Equal weights"
_EQUAL = [1.0 if w > 0 else 0.0 for w in oracle.WEIGHTS]


def _methods_sql(scores: dict[str, str]) -> str:
    """Ranks, correlations and captures of methods given as {name: score expression}."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, customer_id, {s} AS score, future_revenue AS outcome FROM scored_outcome" for m, s in scores.items())
    return f"methods AS ({rows}),{_JUDGED}"


_JUDGED = """
placed AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, customer_id) AS place,
                  count(*) OVER (PARTITION BY method) AS n, sum(outcome) OVER (PARTITION BY method) AS total FROM methods),
corr AS (SELECT method, half_even(corr(x, y), 4) AS spearman
         FROM (SELECT method,
                      (rank() OVER (PARTITION BY method ORDER BY score))::DOUBLE + ((count(*) OVER (PARTITION BY method, score)) - 1)::DOUBLE / 2 AS x,
                      (rank() OVER (PARTITION BY method ORDER BY outcome))::DOUBLE + ((count(*) OVER (PARTITION BY method, outcome)) - 1)::DOUBLE / 2 AS y
               FROM methods) GROUP BY method),
caught AS (SELECT method,
                  half_even(100.0::DOUBLE * (sum(outcome) FILTER (WHERE place <= floor(0.1::DOUBLE * n + 1e-9)))::DOUBLE / any_value(total)::DOUBLE, 2) AS capture_top10_pct,
                  half_even(100.0::DOUBLE * (sum(outcome) FILTER (WHERE place <= floor(0.2::DOUBLE * n + 1e-9)))::DOUBLE / any_value(total)::DOUBLE, 2) AS capture_top20_pct,
                  half_even(100.0::DOUBLE * (sum(outcome) FILTER (WHERE place <= floor(0.3::DOUBLE * n + 1e-9)))::DOUBLE / any_value(total)::DOUBLE, 2) AS capture_top30_pct
           FROM placed GROUP BY method)"""
_METHODS = _methods_sql({HAND: "score", MONEY: "monetary", EQUAL: oracle.weighted(_EQUAL)})
_TOPS = {"capture_top10_pct": 0.10, "capture_top20_pct": 0.20, "capture_top30_pct": 0.30}


def _methods(ws: Workspace):
    """Hand score, monetary only and equal weights on the same customers, in long form."""
    scored = ws.scored_outcome()
    joined = scored.withColumn("equal", tiering.weighted_sum(validation.EQUAL_WEIGHTS))
    cells = F.array(
        F.struct(F.lit(HAND).alias("method"), F.col("score").alias("score")),
        F.struct(F.lit(MONEY).alias("method"), F.col("monetary").alias("score")),
        F.struct(F.lit(EQUAL).alias("method"), F.col("equal").alias("score")),
    )
    return joined.select("customer_id", F.col("future_revenue").alias("outcome"), F.inline(cells))


@register("v1_capture", using("scored_outcome", f"WITH {_METHODS} SELECT * FROM caught"))
def v1(ws: Workspace):
    return validation.captures(validation.rank_methods(_methods(ws)), _TOPS)


@register("v2_capture_curve", using("scored_outcome", f"""WITH {_METHODS},
points AS (SELECT method, any_value(n) AS n, any_value(total) AS total, unnest(range(0, 101)) AS point FROM placed GROUP BY method)
SELECT method, 100.0::DOUBLE * point / 100 AS pct_customers,
       100.0::DOUBLE * coalesce((SELECT sum(outcome) FROM placed p WHERE p.method = points.method
                                 AND p.place <= floor(point / 100.0::DOUBLE * points.n + 1e-9)), 0)::DOUBLE / total::DOUBLE AS pct_revenue
FROM points"""))
def v2(ws: Workspace):
    return validation.capture_curve(_methods(ws))


@register("v3_compare_methods", using("scored_outcome", f"WITH {_METHODS} SELECT * FROM corr JOIN caught USING (method)"))
def v3(ws: Workspace):
    return validation.compare_methods(_methods(ws))


_TIERS = """
tier_table AS (
  SELECT tier, count(*) AS customers, half_even(sum(future_revenue)::DOUBLE / count(*), 2) AS mean,
         half_even(quantile_cont(future_revenue::DOUBLE, 0.5), 2) AS median, half_even(sum(future_revenue)::DOUBLE, 2) AS total,
         half_even(100.0::DOUBLE * count(*) FILTER (WHERE future_revenue > 0) / count(*), 2) AS pct_active,
         half_even(100.0::DOUBLE * sum(future_revenue)::DOUBLE / (SELECT sum(future_revenue) FROM scored_outcome)::DOUBLE, 2) AS share_pct
  FROM scored_outcome GROUP BY tier)"""


def _tier_table(ws: Workspace):
    return validation.tier_outcomes(ws.scored_outcome().select("tier", F.col("future_revenue").alias("outcome")))


@register("v4_tier_outcomes", using("scored_outcome", f"WITH {_TIERS} SELECT * FROM tier_table"))
def v4(ws: Workspace):
    return _tier_table(ws)


@register("v5_monotonicity", using("scored_outcome", f"""WITH {_TIERS}
SELECT bool_and(coalesce(mean <= pm, true)) AS monotonic_mean, bool_and(coalesce(median <= pd, true)) AS monotonic_median
FROM (SELECT mean, median, lag(mean) OVER (ORDER BY tier) AS pm, lag(median) OVER (ORDER BY tier) AS pd FROM tier_table)"""))
def v5(ws: Workspace):
    return validation.monotonicity(_tier_table(ws))


@register("v6_top_quintile_label", using("scored_outcome", """
SELECT customer_id, CAST(future_revenue::DOUBLE >= (SELECT quantile_cont(future_revenue::DOUBLE, 0.8) FROM scored_outcome) AS INTEGER) AS label
FROM scored_outcome"""))
def v6(ws: Workspace):
    return validation.top_quintile_label(ws.scored_outcome()).select("customer_id", "label")


def _training(ws: Workspace):
    """Features one period earlier with the label they are trained on."""
    def build():
        future = tiering.future_revenue(ws.star("fact_sales"), TRAIN_CUTOFF, CUTOFF)
        ranked = tiering.percentile_ranks(ws.features(TRAIN_CUTOFF))
        return validation.top_quintile_label(tiering.with_outcome(ranked, future))

    return ws.written("training_set", build)


def _logistic(ws: Workspace):
    def fit():
        train = _training(ws)
        return validation.fit_logistic(train, train.count())

    return ws.fitted("logistic", fit)


LOGISTIC = "Logistic regression (learned)"
# Rounds and samples of the three boosted models; gains are reported for the last two.
BOOSTED = {
    "Boosted trees, all rows (learned)": {"trees": 200, "depth": 4},
    "Boosted trees, sampled (learned)": {"trees": 300, "depth": 4, "rows": 0.8, "features": 0.8},
    "Boosted trees, shallow and sampled (learned)": {"trees": 300, "depth": 3, "rows": 0.8, "features": 0.8},
}
WITH_GAINS = list(BOOSTED)[1:]


def _trees(ws: Workspace, method: str):
    """Boosted trees of one setting, fitted once and used by every query about them."""
    return ws.fitted(method, lambda: validation.fit_trees(validation.with_missing_flag(_training(ws)), **BOOSTED[method]))


def _fit_together(ws: Workspace, methods: list[str]) -> None:
    """Fits these learned models side by side: each is a long row of small jobs that leave most cores idle."""
    _training(ws)
    with ThreadPoolExecutor(max_workers=len(methods)) as jobs:
        list(jobs.map(lambda method: _logistic(ws) if method == LOGISTIC else _trees(ws, method), methods))


def _boosted_scores(ws: Workspace):
    data = validation.with_missing_flag(ws.scored_outcome().drop("score"))
    _fit_together(ws, list(BOOSTED))
    scores = None
    for method in BOOSTED:
        one = validation.predict(_trees(ws, method), data, method)
        scores = one if scores is None else scores.unionByName(one)
    return scores


def _logistic_scores(ws: Workspace):
    return validation.predict(_logistic(ws), ws.scored_outcome().drop("score"), LOGISTIC)


@register("v7_logistic_scores")
def v7(ws: Workspace):
    return _logistic_scores(ws)


@register("v8_boosted_tree_scores")
def v8(ws: Workspace):
    return _boosted_scores(ws)


@register("v9_gain_importance")
def v9(ws: Workspace):
    _fit_together(ws, WITH_GAINS)
    gains = None
    for method in WITH_GAINS:
        one = validation.importances(_trees(ws, method), _training(ws)).select(F.lit(method).alias("method"), "feature", "gain_share")
        gains = one if gains is None else gains.unionByName(one)
    return gains


# A logistic model and three trees that stand for learned ones, so that scoring can be checked in SQL.
FIXED_LOGISTIC, FIXED_INTERCEPT = dict(zip(FEATURES, [1.2, 0.8, 2.1, -0.3, 0.4, 0.6, -0.2, 0.1], strict=True)), -2.5
FIXED_TREES = [
    trees.Split("monetary", 200_000.0, True, trees.Split("regularity", 60.0, False, -0.4, 0.1), 0.7),
    trees.Split("regularity", 45.0, True, trees.Split("frequency", 4.0, True, -0.2, 0.5), trees.Split("recency", 90.0, False, 0.3, -0.6)),
    trees.Split("breadth", 12.0, True, -0.25, trees.Split("cancel_rate", 0.1, False, 0.35, 0.05)),
]
STUMPS = [trees.Split("monetary", 200_000.0, True, 0.0, 1.0), trees.Split("regularity", 45.0, True, 0.0, 1.0), trees.Split("regularity", 45.0, False, 0.0, 1.0), trees.Split("recency", 90.0, True, 1.0, 0.0)]


def _tree_sql(tree) -> str:
    if not isinstance(tree, trees.Split):
        return f"{tree!r}::DOUBLE"
    return f"CASE WHEN {_low_sql(tree)} THEN {_tree_sql(tree.low)} ELSE {_tree_sql(tree.high)} END"


def _low_sql(split) -> str:
    return f"coalesce({split.feature} <= {split.threshold!r}::DOUBLE, {str(split.nulls_low).lower()})"


_LINEAR = " + ".join(f"pct_{f} * {w!r}::DOUBLE" for f, w in FIXED_LOGISTIC.items())


@register("v7_fixed_logistic", using("scored_outcome", f"""
SELECT 'fixed' AS method, customer_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({FIXED_INTERCEPT!r}::DOUBLE + {_LINEAR}))), 9) AS score, future_revenue::DOUBLE AS outcome FROM scored_outcome"""))
def v7_fixed(ws: Workspace):
    scores = validation.logistic_scores(ws.scored_outcome().drop("score"), FIXED_LOGISTIC, FIXED_INTERCEPT, "fixed")
    return _in_double(scores.withColumn("score", F.round("score", 9)), "outcome")


@register("v8_fixed_trees", using("scored_outcome", f"""
SELECT 'fixed' AS method, customer_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({' + '.join(f'({_tree_sql(t)})' for t in FIXED_TREES)}))), 9) AS score, future_revenue::DOUBLE AS outcome FROM scored_outcome"""))
def v8_fixed(ws: Workspace):
    scores = validation.tree_scores(ws.scored_outcome().drop("score"), FIXED_TREES, "fixed")
    return _in_double(scores.withColumn("score", F.round("score", 9)), "outcome")


_STUMP_SUMS = " UNION ALL ".join(
    f"SELECT {i} AS i, '{s.feature}' AS feature, {s.threshold!r}::DOUBLE AS threshold, coalesce(sum(g) FILTER (WHERE {_low_sql(s)}), 0) AS gl, coalesce(sum(g) FILTER (WHERE NOT {_low_sql(s)}), 0) AS gh,"
    f" 0.25::DOUBLE * count(*) FILTER (WHERE {_low_sql(s)}) AS hl, 0.25::DOUBLE * count(*) FILTER (WHERE NOT {_low_sql(s)}) AS hh FROM labelled" for i, s in enumerate(STUMPS))


@register("v9_true_gains", using("scored_outcome", f"""
WITH labelled AS (SELECT *, 0.5::DOUBLE - (future_revenue::DOUBLE >= (SELECT quantile_cont(future_revenue::DOUBLE, 0.8) FROM scored_outcome))::INTEGER AS g FROM scored_outcome),
s AS ({_STUMP_SUMS})
SELECT feature, threshold, round(gl * gl / (hl + 1) + gh * gh / (hh + 1) - (gl + gh) * (gl + gh) / (hl + hh + 1), 6) AS gain FROM s"""))
def v9_gains(ws: Workspace):
    """True gains of given splits for the top fifth by later revenue, nulls on either side."""
    labelled = validation.top_quintile_label(ws.scored_outcome())
    return trees.split_gains(labelled, STUMPS).withColumn("gain", F.round("gain", 6))


@register("v8_null_aware_fit", using("scored_outcome", "SELECT count(*) AS customers, 10 AS trees, true AS better_than_rate, true AS gains_add_up FROM scored_outcome"))
def v8_null_aware(ws: Workspace):
    """Trees fitted with nulls as they are: their loss against that of the bare rate, and their gain shares."""
    labelled = validation.top_quintile_label(ws.scored_outcome().drop("score"))
    model = ws.fitted("null_aware_trees", lambda: trees.fit(labelled, FEATURES, trees=10, depth=3, rate=0.3))
    p, y = trees.probability(model), F.col("label")
    loss = lambda q: -F.sum(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))
    rate = F.sum(y) / F.count(F.lit(1))
    bare = -(F.sum(y) * F.log(rate) + (F.count(F.lit(1)) - F.sum(y)) * F.log(1 - rate))
    adds = abs(sum(trees.gain_shares(model).values()) - 1) < 1e-9
    return labelled.agg(F.count(F.lit(1)).alias("customers"), F.lit(len(model)).alias("trees"), (loss(p) < bare).alias("better_than_rate"), F.lit(adds).alias("gains_add_up"))


@register("v10_baselines", using("scored_outcome", f"""WITH {_METHODS}
SELECT method, customer_id, score, outcome::DOUBLE AS outcome FROM methods WHERE method <> '{HAND}'"""))
def v10(ws: Workspace):
    return _in_double(_methods(ws).filter(F.col("method") != HAND), "outcome")


_COEFFICIENTS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, coalesce(half_even(corr(pct_{f}, future_revenue::DOUBLE), 3), 0) AS coefficient FROM scored_outcome"
    for f in FEATURES
)


@register("v11_implied_weights", using("scored_outcome", f"""WITH c AS ({_COEFFICIENTS}),
i AS (SELECT feature, coefficient, half_even(greatest(coefficient, 0) / sum(greatest(coefficient, 0)) OVER (), 3) AS implied_weight FROM c),
s AS (SELECT *, round_even(implied_weight / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS stepped FROM i)
SELECT feature, coefficient, implied_weight, half_even(stepped / sum(stepped) OVER (), 3) AS rounded_weight FROM s"""))
def v11(ws: Workspace):
    outcome = F.col("future_revenue").cast("double")
    wide = ws.scored_outcome().agg(*[F.coalesce(F.round(F.corr(f"pct_{f}", outcome), 3), F.lit(0.0)).alias(f) for f in FEATURES])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("coefficient")) for f in FEATURES])
    return validation.implied_weights(wide.select(F.inline(cells)))


def _learned_weights(ws: Workspace):
    return validation.implied_weights(validation.coefficients(_logistic(ws), ws.scored()))


@register("v11_learned_weights")
def v11_learned(ws: Workspace):
    return _learned_weights(ws)


# Weights of the kind that rounding gives; with them the whole method can be checked in SQL.
ROUNDED = "Hand-weighted, learned weights rounded"
EXAMPLE_WEIGHTS = dict(zip(FEATURES, [0.2, 0.25, 0.3, 0.05, 0.05, 0.1, 0.0, 0.05], strict=True))
_EXAMPLE = oracle.weighted(list(EXAMPLE_WEIGHTS.values()))


def _rounded_method(ws: Workspace):
    """The learned weights, rounded, as a method of its own (eight weights reach the driver)."""
    weights = {r["feature"]: r["rounded_weight"] for r in _learned_weights(ws).collect()}
    return validation.weighted_method(ws.scored_outcome(), weights, ROUNDED)


@register("v11_weighted_method", using("scored_outcome", f"WITH {_methods_sql({ROUNDED: _EXAMPLE})} SELECT * FROM corr JOIN caught USING (method)"))
def v11_weighted(ws: Workspace):
    return validation.compare_methods(validation.weighted_method(ws.scored_outcome(), EXAMPLE_WEIGHTS, ROUNDED))


@register("v11_weighted_tiers", using("scored_outcome", f"""
WITH r AS (SELECT future_revenue AS outcome, row_number() OVER (ORDER BY {_EXAMPLE} DESC, customer_id) AS place, count(*) OVER () AS n FROM scored_outcome),
t AS (SELECT *, {oracle.tier('place', 'n')} AS tier FROM r)
SELECT tier, count(*) AS customers, half_even(sum(outcome)::DOUBLE / count(*), 2) AS mean, half_even(quantile_cont(outcome::DOUBLE, 0.5), 2) AS median,
       half_even(sum(outcome)::DOUBLE, 2) AS total, half_even(100.0::DOUBLE * count(*) FILTER (WHERE outcome > 0) / count(*), 2) AS pct_active,
       half_even(100.0::DOUBLE * sum(outcome)::DOUBLE / (SELECT sum(outcome) FROM t)::DOUBLE, 2) AS share_pct FROM t GROUP BY tier"""))
def v11_tiers(ws: Workspace):
    return validation.tier_outcomes(tiering.with_tiers(validation.weighted_method(ws.scored_outcome(), EXAMPLE_WEIGHTS, ROUNDED)))


@register("v11_rounded_method")
def v11_rounded(ws: Workspace):
    """Learned weights, rounded, judged beside the hand score."""
    return validation.compare_methods(_methods(ws).select("method", "customer_id", "score", "outcome").unionByName(_rounded_method(ws)))


def _sensitivity_sql() -> str:
    parts = []
    for feature, factor, weights in validation.weight_scenarios():
        listed = [weights[f] for f in FEATURES]
        parts.append(
            f"SELECT '{feature}' AS feature, {factor}::DOUBLE AS factor, {round(weights[feature] / sum(listed), 3)!r}::DOUBLE AS weight,"
            f" customer_id, tier AS base, future_revenue AS outcome, {oracle.weighted(listed)} AS s FROM scored_outcome"
        )
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY feature, factor ORDER BY s DESC, customer_id) AS place,
           count(*) OVER (PARTITION BY feature, factor) AS n FROM ({' UNION ALL '.join(parts)})),
t AS (SELECT *, {oracle.tier('place', 'n')} AS tier FROM r)
SELECT feature, factor, weight, count(*) FILTER (WHERE tier <> base) AS customers_changing_tier,
       half_even(100.0::DOUBLE * count(*) FILTER (WHERE tier <> base) / count(*), 2) AS pct_changing_tier,
       count(*) FILTER (WHERE (tier = 'Tier 1') <> (base = 'Tier 1')) AS tier1_changes,
       half_even(100.0::DOUBLE * (sum(outcome) FILTER (WHERE place <= floor(0.1::DOUBLE * n + 1e-9)))::DOUBLE / sum(outcome)::DOUBLE, 2) AS capture_top10_pct
FROM t GROUP BY feature, factor, weight"""


@register("v12_weight_sensitivity", using("scored_outcome", _sensitivity_sql()))
def v12(ws: Workspace):
    return validation.weight_sensitivity(ws.scored_outcome().withColumnRenamed("future_revenue", "outcome"))


@register("v13_worked_examples", using("scored", """
SELECT 'typical Tier 1' AS example, (SELECT customer_id FROM scored WHERE tier = 'Tier 1'
  ORDER BY abs(score - (SELECT quantile_cont(score, 0.5) FROM scored WHERE tier = 'Tier 1')), customer_id LIMIT 1) AS customer_id
UNION ALL
SELECT 'biggest spender in a low tier', (SELECT customer_id FROM scored WHERE tier IN ('Tier 3', 'Tier 4')
  ORDER BY monetary DESC, customer_id LIMIT 1)"""))
def v13(ws: Workspace):
    return validation.worked_examples(ws.scored())


@register("v14_coverage", using("scored_outcome future", """
SELECT (SELECT half_even(100.0::DOUBLE * count(*) FILTER (WHERE future_revenue > 0) / count(*), 2) FROM scored_outcome) AS pct_active,
       (SELECT half_even(100.0::DOUBLE * coalesce(sum(future_revenue) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM scored_outcome)), 0)::DOUBLE
               / sum(future_revenue)::DOUBLE, 2) FROM future) AS pct_revenue_from_unscored"""))
def v14(ws: Workspace):
    return validation.coverage(ws.scored_outcome(), ws.future())


@register("v15_method_verdict", using("scored_outcome", f"""WITH {_METHODS},
c AS (SELECT * FROM corr JOIN caught USING (method)),
j AS (SELECT method, spearman, capture_top10_pct, spearman > (SELECT spearman FROM c WHERE method = '{HAND}') AS beats_spearman,
             capture_top10_pct > (SELECT capture_top10_pct FROM c WHERE method = '{MONEY}') AS beats_capture
      FROM c WHERE method = '{EQUAL}')
SELECT *, (SELECT bool_or(beats_spearman OR beats_capture) FROM j) AS complex_beats_simple FROM j"""))
def v15(ws: Workspace):
    return validation.complex_model_verdict(validation.compare_methods(_methods(ws)), [EQUAL], HAND, MONEY)


@register("v15_learned_verdict")
def v15_learned(ws: Workspace):
    return validation.complex_model_verdict(all_methods(ws), [LOGISTIC, *BOOSTED], HAND, MONEY)


def all_methods(ws: Workspace):
    """Every method, learned ones included, compared on the same customers."""
    def build():
        simple = _methods(ws).select("method", "customer_id", "score", "outcome")
        _fit_together(ws, [LOGISTIC, *BOOSTED])
        # The scores are read by several jobs; written once, no model is applied twice.
        every = ws.written("method_scores", lambda: simple.unionByName(_rounded_method(ws)).unionByName(_logistic_scores(ws)).unionByName(_boosted_scores(ws)))
        return validation.compare_methods(every)

    return ws.written("tier_methods", build)

