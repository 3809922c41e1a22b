from pyspark.sql import functions as F

from basketry.operators import digest_tree


def test_few_changed_rows_are_found_in_few_leaves(spark, tmp_path):
    good = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 100).alias("v"), F.lit("x").alias("w"))
    bad = good.filter("k <> 77").withColumn("v", F.when(F.col("k") == 500, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(99_999, 1, "new")], "k long, v long, w string"))
    bad = bad.withColumn("w", F.when(F.col("k") == 501, F.lit(None)).otherwise(F.col("w")))
    a, b = digest_tree.store(good, ["k"], str(tmp_path / "a")), digest_tree.store(bad, ["k"], str(tmp_path / "b"))
    assert {tuple(r) for r in digest_tree.changed_rows(a, b).collect()} == {(77, "missing", ""), (500, "changed", "v"), (501, "changed", "w"), (99_999, "added", "")}
    share = digest_tree.read_share(a, b).head()
    assert share.leaves == 256 and 1 <= share.leaves_read <= 4 and share.rows_read < 0.05 * share.rows
    assert digest_tree.differing_leaves(a, a) == [] and digest_tree.changed_rows(a, a).count() == 0


def test_repeated_and_null_keys_and_empty_tables(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (2, None)]
    schema = "k long, v string"
    a = digest_tree.store(spark.createDataFrame(rows, schema), ["k"], str(tmp_path / "a"))
    b = digest_tree.store(spark.createDataFrame([(1, "a"), (1, "b"), (None, "m"), (2, None)], schema), ["k"], str(tmp_path / "b"))
    empty = digest_tree.store(spark.createDataFrame([], schema), ["k"], str(tmp_path / "c"))
    found = {(r.k, r.change) for r in digest_tree.changed_rows(a, b).collect()}
    assert (None, "changed") in found and any(k == 1 for k, _ in found) and not any(k == 2 for k, _ in found)
    assert digest_tree.changed_rows(a, empty).count() == 5 and {r.change for r in digest_tree.changed_rows(empty, a).collect()} == {"added"}
    assert digest_tree.changed_rows(empty, empty).count() == 0
