import datetime
import hashlib

from pyspark.sql import functions as F

from basketry.operators import cleaning, parity, star


def test_tier_comparison(spark):
    left = spark.createDataFrame([(i, f"Tier {i}") for i in range(1, 5)], "customer_id int, tier string")
    right = spark.createDataFrame([(1, "Tier 1"), (2, "Tier 3"), (3, "Tier 3")], "customer_id int, tier string")
    moves = parity.tier_transitions(left, right)
    found = parity.tier_agreement(moves).first()
    assert (found.missing_in_right, found.extra_in_right, found.tier_changed, found.agreement_pct) == (1, 0, 1, 50.0)
    changed = {(r.left_tier, r.right_tier): r.customers for r in moves.filter("left_tier <> right_tier").collect()}
    assert changed == {("Tier 2", "Tier 3"): 1, ("Tier 4", "missing"): 1}
    assert not found.match


def test_clean_and_faulty_loads(raw):
    sales, cancelled = cleaning.clean(raw)
    good = star.build_star(sales, cancelled)
    clean = parity.parity(parity.warehouse_checks(good, star.build_star(sales, cancelled))).first()
    assert clean["pass"] and clean.checks_total == 45
    lost = star.build_star(cleaning.inject_fault(sales, "drop_country", "NATION_5"), cancelled)
    assert not parity.parity(parity.warehouse_checks(good, lost)).first()["pass"]
    found = parity.country_drilldown(good["fact_sales"], lost["fact_sales"]).collect()
    assert [(r.country, r.left_rows, r.right_rows) for r in found] == [("NATION_5", 1, 0)]


def test_one_changed_value_flags_its_column_only(raw):
    tables = star.build_star(*cleaning.clean(raw))
    edited = F.when(F.col("sales_line_id") == 1, 99).otherwise(F.col("quantity"))
    other = {**tables, "fact_sales": tables["fact_sales"].withColumn("quantity", edited.cast("int"))}
    off = [r.name for r in parity.column_checksums(tables, other).filter("not match").collect()]
    assert off == ["fact_sales.quantity"]


def test_column_digests_by_hand(spark):
    rows = [("a", None, datetime.datetime(2000, 1, 2, 3, 4, 5, 6)), ("é|1:", "x", None), (None, "", datetime.datetime(1999, 1, 1))] * 400
    table = spark.createDataFrame(rows, "stock_code string, description string, seen timestamp_ntz")

    def text(value):
        return "<null>" if value is None else value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")

    def number(*parts):
        return int(hashlib.md5("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()[:15], 16)

    wanted = {f"dim_product.{c}": str(sum(number(text(r[0]), text(r[i])) for r in rows)) for i, c in enumerate(table.columns)}
    found = parity.column_digests(table, "dim_product")
    assert {r.name: r.digest for r in found.collect()} == wanted
    assert {r.digest for r in parity.column_digests(table.limit(0), "dim_product").collect()} == {"0"}


def test_columns_share_one_digest_expression(spark):
    """However many columns a table has, its digests come from one short expression, added as whole numbers."""
    wide = spark.range(3).select(F.col("id").alias("sales_line_id"), *[F.col("id").alias(f"c{i}") for i in range(12)])
    plan = parity.column_digests(wide, "fact_sales")._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1
