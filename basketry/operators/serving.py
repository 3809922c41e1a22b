"""Pre-aggregated tables a service reads, and lookups over them in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.text import as_number, normalised
from basketry.operators.tiering import standard_ranks

SHOWN_ROWS = 20
_KNOWN_PER_BLOCK = 2_000


def customer_scores(scored_outcome: DataFrame, customers: DataFrame) -> DataFrame:
    """Scores and contributions with later revenue, standard rank and home country."""
    ranked = standard_ranks(scored_outcome).drop("size", "score_rank")
    return ranked.join(customers.select("customer_id", "country"), "customer_id", "left")


def thinned(curve: DataFrame, points: int = 200) -> DataFrame:
    """About ``points`` evenly spaced rows of a curve numbered by ``place``, and always its last row."""
    n = curve.agg(F.max("place")).scalar()
    counted = curve.withColumn("n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    return counted.filter(((F.col("place") - 1) % step == 0) | (F.col("place") == F.col("n"))).drop("n")


def key_values(one_row: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A one-row summary as (key, value, label) rows; values are text."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), F.lit(label).alias("label"))
        for k, label in labels.items()
    ])
    return one_row.select(F.inline(cells))


def rendered(columns: Column, rows: Column, abstained: Column, reason: Column, error: Column) -> Column:
    """A plain sentence for a result: a value, one row, a row count, nothing, an abstention or a failure."""
    def shown(value: Column) -> Column:
        number = as_number(value)
        return F.when(number.isNotNull() & value.contains("."), F.format_number(number, 2)).otherwise(
            F.coalesce(value, F.lit("None"))
        )

    def named(column: Column, value: Column) -> Column:
        return F.concat(F.replace(column, F.lit("_"), F.lit(" ")), F.lit(": "), shown(value))

    return (
        F.when(abstained, F.trim(F.concat(F.lit("No answer is possible here. "), F.coalesce(reason, F.lit("")))))
        .when(error.isNotNull(), "No answer: the query ended in an error.")
        .when(F.size(rows) == 0, "The result is empty.")
        .when(F.size(rows) == 1, F.array_join(F.zip_with(columns, F.get(rows, 0), named), "; "))
        .otherwise(F.concat(F.size(rows).cast("string"), F.lit(" rows, shown in the table.")))
    )


def graded_answers(answers: DataFrame, references: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First-run answers beside their reference and the judge's verdict, at most twenty rows of each result."""
    first = answers.filter(F.col("run") == 0)
    joined = first.join(references, "id", "left").join(verdicts, ["id", "run"], "left")
    return joined.withColumn("row_count", F.size("result")).withColumn(
        "rows", F.to_json(F.slice("result", 1, SHOWN_ROWS))
    ).withColumn("reference_rows", F.to_json(F.slice("reference", 1, SHOWN_ROWS))).drop("result", "reference")


def question_list(answers: DataFrame) -> DataFrame:
    return answers.select("id", "difficulty", "question").dropDuplicates(["id"])


def available(answers: DataFrame) -> DataFrame:
    """The (model, version) pairs with an answer, per question key."""
    return answers.select(normalised(F.col("question")).alias("question_key"), "model", "version").distinct()


def look_up(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Cached answers for (question, model, version) requests; ``found`` is false where there is none."""
    key = [normalised(F.col("question")).alias("question_key"), "model", "version"]
    cached = answers.select(*key, "answer", F.lit(True).alias("hit"))
    wanted = asked.select("question", *key)
    return wanted.join(cached, ["question_key", "model", "version"], "left").select(
        "question", "model", "version", "answer", F.coalesce("hit", F.lit(False)).alias("found")
    )


def _length_step(length: Column) -> Column:
    return F.floor(F.log2(length + 1)).cast("int")


def similar_texts(asked: DataFrame, known: DataFrame, n: int = 3, cutoff: float = 0.4) -> DataFrame:
    """Up to ``n`` known texts per asked text with a similarity of at least ``cutoff``, a share above 0.

    Similarity is 1 - edit distance / longer length, so lengths that differ by more than the cutoff allows rule a text
    out unread. Known texts lie in blocks of bounded size by steps of their length; an asked text meets the blocks of
    the steps in its reach, in one join for any number of either, keeps its best few of each, and pairs are never emitted.
    """
    listed = known.select("text").distinct().filter("text is not null").withColumn("step", _length_step(F.length("text")))
    sizes = {r["step"]: r["count"] for r in listed.groupBy("step").count().collect()}  # some thirty steps of length
    if not sizes:
        return asked.limit(0).select("text", F.lit("").alias("known"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    parts = F.create_map(*[F.lit(x) for step, size in sizes.items() for x in (step, -(-2 * size // _KNOWN_PER_BLOCK))])
    part = F.pmod(F.xxhash64("text"), parts[F.col("step")]).cast("int")
    blocks = listed.withColumn("part", part).groupBy("step", "part").agg(F.array_sort(F.collect_list("text")).alias("_known"))

    length = F.length("text")
    reach = F.sequence(_length_step(F.ceil(length * cutoff - 1e-9)), _length_step(F.floor(length / cutoff + 1e-9)))
    steps = asked.select("text").withColumn("step", F.explode(reach)).filter(parts[F.col("step")].isNotNull())
    meets = steps.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("step")] - 1))).join(blocks, ["step", "part"])

    def scored(other: Column) -> Column:
        longer = F.greatest(F.length("text"), F.length(other), F.lit(1))
        far = F.when(F.least(length, F.length(other)) >= longer * cutoff - 1e-9, F.levenshtein(F.col("text"), other) / longer - 1)
        return F.struct(far.alias("minus"), other.alias("known"))

    best = F.slice(F.array_sort(F.filter(F.transform("_known", scored), lambda s: -s["minus"] >= cutoff)), 1, n)
    every = meets.select("text", F.inline(best))
    order = Window.partitionBy("text").orderBy("minus", "known")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("text", "known", (-F.col("minus")).alias("similarity"), "rank")


def outcome_grid(records: DataFrame, versions: list[str]) -> DataFrame:
    """Question and model down, version across."""
    return records.groupBy("id", "model").pivot("version", versions).agg(F.min("outcome"))


def tier_members(scored: DataFrame, tier: str) -> DataFrame:
    """Customers of a tier, best first."""
    return scored.filter(F.col("tier") == tier).orderBy("score_rank")
