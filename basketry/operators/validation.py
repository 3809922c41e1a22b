"""Does a score rank customers by what they later spend? Captures, curves, rank correlation, learned models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.single import beside
from basketry.operators.ranking import group_positions, quantiles, running_totals, with_tie_ranks
from basketry.operators.trees import probability
from basketry.operators.tiering import FEATURES, TIER_SHARES, WEIGHTS, tier_of, weighted_sum

HAND_FEATURES = [f for f, w in WEIGHTS.items() if w > 0]
EQUAL_WEIGHTS = {f: (1.0 if f in HAND_FEATURES else 0.0) for f in FEATURES}


def best_count(k: Column, n: Column) -> Column:
    """Customers in the best fraction k, counted as the tier cut-offs count them."""
    return F.floor(k * n + F.lit(1e-9))


def rank_methods(scores: DataFrame) -> DataFrame:
    """(method, customer_id, score, outcome) with each method's customers numbered best first."""
    return group_positions(scores, ["method"], [F.desc("score"), "customer_id"], "place")


def captures(ranked: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Per method, the share of the outcome earned by the best fraction of customers."""
    total = F.sum("outcome").cast("double")
    return ranked.groupBy("method").agg(*[
        F.bround(
            100.0 * F.coalesce(F.sum(F.when(F.col("place") <= best_count(F.lit(k), F.col("group_rows")), F.col("outcome"))), F.lit(0)).cast("double") / total,
            2,
        ).alias(name)
        for name, k in fractions.items()
    ])


def capture_curve(scores: DataFrame, points: int = 100) -> DataFrame:
    """Share captured at 0, 1, ... ``points`` hundredths, from one ordering of all methods."""
    order = ["method", F.desc("score"), "customer_id"]
    summed = running_totals(scores, order, {"upto": "outcome"}, "overall")
    sizes = summed.groupBy("method").agg(
        F.min("overall").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("total"),
        F.min(F.col("upto") - F.col("outcome")).alias("before_first"),
    )
    cuts = sizes.select(
        "method", "n", "total", "first", "before_first",
        F.explode(F.sequence(F.lit(0), F.lit(points))).alias("point"),
    ).withColumn("place", best_count(F.col("point") / F.lit(float(points)), F.col("n")))
    at = summed.select("method", "overall", "upto")
    joined = cuts.withColumn("overall", F.col("first") + F.col("place") - 1).join(at, ["method", "overall"], "left")
    earned = F.when(F.col("place") == 0, F.lit(0)).otherwise(F.col("upto") - F.col("before_first"))
    return joined.select(
        "method", (100.0 * F.col("point") / F.lit(points)).alias("pct_customers"),
        (100.0 * earned.cast("double") / F.col("total").cast("double")).alias("pct_revenue"),
    )


def spearman(scores: DataFrame) -> DataFrame:
    """Rank correlation of score and outcome per method. Ranks are doubled to stay whole numbers, so every
    sum is exact and the result does not depend on the order of addition."""
    def doubled(rows: DataFrame, column: str, name: str) -> DataFrame:
        rank = (2 * F.col("below") + F.col("ties") + 1).cast("decimal(19,0)")
        return with_tie_ranks(rows, column, ["method"]).withColumn(name, rank).drop("below", "ties", "size")

    pairs = scores.select("method", "score", "outcome").filter(F.col("score").isNotNull() & F.col("outcome").isNotNull())
    both = doubled(doubled(pairs, "score", "x"), "outcome", "y")
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("method").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(e).cast("double").alias(a) for e, a in ((x, "sx"), (y, "sy"), (x * x, "sxx"), (y * y, "syy"), (x * y, "sxy"))],
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt(n * F.col("sxx") - sx * sx) * F.sqrt(n * F.col("syy") - sy * sy)
    return sums.select("method", F.bround(F.try_divide(n * F.col("sxy") - sx * sy, spread), 4).alias("spearman"))


def compare_methods(scores: DataFrame) -> DataFrame:
    tops = {"capture_top10_pct": 0.10, "capture_top20_pct": 0.20, "capture_top30_pct": 0.30}
    return spearman(scores).join(captures(rank_methods(scores), tops), "method")


def tier_outcomes(tiered: DataFrame) -> DataFrame:
    """Per tier: customers, mean, median, total, share and % active later. Needs (tier, outcome)."""
    sizes = tiered.groupBy("tier").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("outcome").alias("total"),
        F.count_if(F.col("outcome") > 0).alias("active"),
    )
    medians = quantiles(tiered, "outcome", {"median": 0.5}, ["tier"])
    over_all = Window.partitionBy()  # one row per tier
    total = F.col("total").cast("double")
    return sizes.join(medians, "tier").select(
        "tier", "customers",
        F.bround(total / F.col("customers"), 2).alias("mean"),
        F.bround("median", 2).alias("median"),
        F.bround(total, 2).alias("total"),
        F.bround(100.0 * F.col("active") / F.col("customers"), 2).alias("pct_active"),
        F.bround(100.0 * total / F.sum("total").over(over_all).cast("double"), 2).alias("share_pct"),
    )


def monotonicity(tier_table: DataFrame) -> DataFrame:
    """Whether mean and median fall (or stay) from each tier to the next."""
    by_tier = Window.orderBy("tier")  # one row per tier
    steps = tier_table.select(
        (F.col("mean") <= F.lag("mean").over(by_tier)).alias("mean_ok"),
        (F.col("median") <= F.lag("median").over(by_tier)).alias("median_ok"),
    )
    return steps.agg(
        F.bool_and(F.coalesce("mean_ok", F.lit(True))).alias("monotonic_mean"),
        F.bool_and(F.coalesce("median_ok", F.lit(True))).alias("monotonic_median"),
    )


def top_quintile_label(data: DataFrame) -> DataFrame:
    """1 where the outcome reaches its own 80th percentile."""
    edge = quantiles(data, "future_revenue", {"edge": 0.8}).scalar()
    return data.withColumn("label", (F.col("future_revenue").cast("double") >= edge).cast("int"))


def weight_scenarios(factors: Sequence[float] = (0.5, 1.5)) -> list[tuple[str, float, dict[str, float]]]:
    return [(f, factor, {**WEIGHTS, f: WEIGHTS[f] * factor}) for f in HAND_FEATURES for factor in factors]


def weight_sensitivity(tiered: DataFrame) -> DataFrame:
    """Tier changes and top-10% capture when one weight is halved or raised by half.

    Every customer is scored under all scenarios by one generator; all scenarios are ranked in one ordering.
    Needs the percentile columns, ``tier``, ``outcome`` and ``customer_id``.
    """
    options = []
    for feature, factor, weights in weight_scenarios():
        total = sum(weights.values())
        options.append(F.struct(
            F.lit(feature).alias("feature"), F.lit(factor).alias("factor"),
            F.lit(round(weights[feature] / total, 3)).alias("weight"),
            weighted_sum(weights).alias("score"),
        ))
    rescored = tiered.select("customer_id", F.col("tier").alias("base_tier"), "outcome", F.inline(F.array(*options)))
    placed = group_positions(rescored, ["feature", "factor"], [F.desc("score"), "customer_id"], "place")
    tier = tier_of(F.col("place"), F.col("group_rows"))
    judged = placed.withColumn("tier", tier)
    top = F.col("place") <= best_count(F.lit(0.10), F.col("group_rows"))
    changed = F.count_if(F.col("tier") != F.col("base_tier"))
    first = list(TIER_SHARES)[0]
    return judged.groupBy("feature", "factor", "weight").agg(
        changed.alias("customers_changing_tier"),
        F.bround(100.0 * changed / F.count(F.lit(1)), 2).alias("pct_changing_tier"),
        F.count_if((F.col("tier") == first) != (F.col("base_tier") == first)).alias("tier1_changes"),
        F.bround(100.0 * F.sum(F.when(top, F.col("outcome"))).cast("double") / F.sum("outcome").cast("double"), 2).alias(
            "capture_top10_pct"
        ),
    )


def implied_weights(coefficients: DataFrame, step: float = 0.05) -> DataFrame:
    """(feature, coefficient) to weights: negatives clipped, shares rounded half-even to ``step``, renormalised."""
    over_all = Window.partitionBy()  # one row per feature
    clipped = coefficients.withColumn("positive", F.greatest("coefficient", F.lit(0.0)))
    implied = clipped.withColumn("implied_weight", F.bround(F.col("positive") / F.sum("positive").over(over_all), 3))
    stepped = implied.withColumn("stepped", F.bround(F.col("implied_weight") / F.lit(step), 0) * F.lit(step))
    return stepped.select(
        "feature", "coefficient", "implied_weight",
        F.bround(F.col("stepped") / F.sum("stepped").over(over_all), 3).alias("rounded_weight"),
    )


def weighted_method(scored_outcome: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """(method, customer_id, score, outcome) of a weighted sum of the percentiles."""
    return scored_outcome.select(
        F.lit(name).alias("method"), "customer_id", weighted_sum(weights).alias("score"), F.col("future_revenue").alias("outcome")
    )


def worked_examples(tiered: DataFrame) -> DataFrame:
    """A typical Tier 1 customer (score nearest the tier's median) and the biggest spender in Tier 3 or 4."""
    top = tiered.filter(F.col("tier") == "Tier 1")
    middle = quantiles(top, "score", {"median": 0.5}).scalar()
    typical = top.withColumn("off", F.abs(F.col("score") - middle)).agg(
        F.min_by("customer_id", F.struct("off", "customer_id")).alias("customer_id")
    )
    low = tiered.filter(F.col("tier").isin("Tier 3", "Tier 4")).agg(
        F.min_by("customer_id", F.struct((-F.col("monetary")).alias("minus"), "customer_id")).alias("customer_id")
    )
    return typical.select(F.lit("typical Tier 1").alias("example"), "customer_id").unionByName(
        low.select(F.lit("biggest spender in a low tier").alias("example"), "customer_id")
    )


def coverage(scored_outcome: DataFrame, future: DataFrame) -> DataFrame:
    """% of scored customers active later, and % of later revenue from customers who could not be scored."""
    known = scored_outcome.agg(
        F.bround(100.0 * F.count_if(F.col("future_revenue") > 0) / F.count(F.lit(1)), 2).alias("pct_active")
    )
    missed = future.join(scored_outcome.select("customer_id"), "customer_id", "left_anti").agg(
        F.coalesce(F.sum("future_revenue"), F.lit(0)).cast("double").alias("missed")
    )
    everyone = future.agg(F.sum("future_revenue").cast("double").alias("everyone"))
    share = F.bround(F.try_divide(100.0 * F.col("missed"), F.col("everyone")), 2).alias("pct_revenue_from_unscored")
    return beside(beside(known, missed), everyone).select("pct_active", share)


def complex_model_verdict(comparison: DataFrame, complex_methods: Sequence[str], hand: str, simple: str) -> DataFrame:
    """Do the complex methods beat the hand score's rank correlation or the simple method's top-10% capture?"""
    bar_corr = comparison.filter(F.col("method") == hand).agg(F.max("spearman").alias("v")).scalar()
    bar_capture = comparison.filter(F.col("method") == simple).agg(F.max("capture_top10_pct").alias("v")).scalar()
    judged = comparison.filter(F.col("method").isin(*complex_methods)).select(
        "method", "spearman", "capture_top10_pct",
        (F.col("spearman") > bar_corr).alias("beats_spearman"),
        (F.col("capture_top10_pct") > bar_capture).alias("beats_capture"),
    )
    any_better = judged.agg(F.bool_or(F.col("beats_spearman") | F.col("beats_capture")).alias("b")).scalar()
    return judged.withColumn("complex_beats_simple", any_better)


# ---- learned models ---------------------------------------------------------------------------------


def _probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def fit_logistic(labelled: DataFrame, rows: int) -> PipelineModel:
    """Logistic regression on standardised percentiles; L2 strength 1/n matches a unit penalty on the sum."""
    inputs = [f"pct_{f}" for f in FEATURES]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000, regParam=1.0 / rows, standardization=False),
    ]
    return Pipeline(stages=stages).fit(labelled)


def logistic_scores(data: DataFrame, weights: dict[str, float], intercept: float, method: str) -> DataFrame:
    """Probabilities of a logistic model over the percentiles with given coefficients."""
    z = F.lit(float(intercept))
    for f in FEATURES:
        z = z + F.col(f"pct_{f}") * float(weights.get(f, 0.0))
    return data.select(F.lit(method).alias("method"), "customer_id", (1.0 / (1.0 + F.exp(-z))).alias("score"), F.col("future_revenue").alias("outcome"))


def tree_scores(data: DataFrame, trees: Sequence, method: str) -> DataFrame:
    """Probabilities of boosted trees that send nulls to a side of their own choice."""
    return data.select(F.lit(method).alias("method"), "customer_id", probability(trees).alias("score"), F.col("future_revenue").alias("outcome"))


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    values = [float(v) for v in model.stages[-1].coefficients]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(round(v, 3)).alias("coefficient")) for f, v in zip(FEATURES, values, strict=True)])
    return df.sparkSession.range(1).select(F.inline(rows))


def fit_trees(labelled: DataFrame, trees: int = 200, depth: int = 4, rows: float = 1.0, features: float = 1.0, seed: int = 42) -> PipelineModel:
    """Boosted trees on the raw features, each on a share of rows and features; a missing regularity is imputed and
    flagged in its own column."""
    raw = [f for f in FEATURES if f != "regularity"]
    stages = [
        Imputer(inputCols=["regularity"], outputCols=["regularity_filled"], strategy="median"),
        VectorAssembler(inputCols=[*raw, "regularity_filled", "regularity_missing"], outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=rows, featureSubsetStrategy=str(features) if features < 1 else "all", seed=seed),
    ]
    return Pipeline(stages=stages).fit(labelled)


def with_missing_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("regularity_missing", F.col("regularity").isNull().cast("double"))


def predict(model: PipelineModel, df: DataFrame, method: str) -> DataFrame:
    return _probability(model.transform(df), "score").select(
        F.lit(method).alias("method"), "customer_id", "score", F.col("future_revenue").alias("outcome")
    )


def importances(model: PipelineModel, df: DataFrame, top: int = 5) -> DataFrame:
    """The features with the most gain, as a share of the model's total gain."""
    names = [*[f for f in FEATURES if f != "regularity"], "regularity", "regularity_missing"]
    gains = model.stages[-1].featureImportances.toArray().tolist()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(g)).alias("gain_share")) for f, g in zip(names, gains, strict=True)])
    ranked = df.sparkSession.range(1).select(F.inline(rows))
    return ranked.orderBy(F.desc("gain_share"), "feature").limit(top)
