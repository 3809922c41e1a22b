import datetime

from pyspark.sql import functions as F

from basketry.operators import cleaning, star


def test_star_of_the_small_case(raw):
    sales, cancelled = cleaning.clean(raw)
    tables = star.build_star(sales, cancelled)
    assert tables["dim_date"].count() == 77
    day = tables["dim_date"].filter("date_key = 19990302").first()
    assert (day.day_name, day.day_of_week, day.is_weekend, day.month_name) == ("Tuesday", 2, False, "March")
    people = {r.customer_id: r for r in tables["dim_customer"].collect()}
    assert people[11].country == "NATION_2" and people[12].country == "NATION_5"
    assert sorted(r.sales_line_id for r in tables["fact_sales"].collect()) == [1, 2]


def test_customers_who_only_cancelled_have_no_sale_dates(raw):
    sales, cancelled = cleaning.clean(raw)
    row = star.customers(sales.filter("customer_id = 12"), cancelled).filter("customer_id = 11").first()
    assert row.first_invoice_date is None and row.country == "NATION_2"


def test_mode_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a")], "k int, v string")
    assert {r.k: r.v for r in star.most_frequent(df, "k", "v").collect()} == {1: "a", 2: "z"}


def test_identical_lines_keep_their_own_ids(raw, monkeypatch):
    monkeypatch.setattr(star, "_COPIES_PER_TASK", 3)
    _, cancelled = cleaning.clean(raw)
    many = cancelled.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy")
    ids = sorted(r.cancellation_line_id for r in star.fact(many, "cancellation_line_id").collect())
    assert ids == list(range(1, 11))


def test_fingerprint_ignores_order_and_sees_every_value(raw):
    tables = star.build_star(*cleaning.clean(raw))
    same = {k: v.orderBy(F.rand(1)) for k, v in tables.items()}
    changed = {**tables, "dim_product": tables["dim_product"].withColumn("description", F.lit("x"))}
    first, again, other = (star.fingerprint(t).first().fingerprint for t in (tables, same, changed))
    assert first == again != other


def test_digests_see_microseconds_and_borders(spark):
    def digest(rows, schema):
        return star.table_digest(spark.createDataFrame(rows, schema), "t").first().digest

    moment = datetime.datetime(2000, 1, 2, 3, 4, 5, 6)
    assert digest([(moment,)], "t timestamp_ntz") != digest([(moment.replace(microsecond=7),)], "t timestamp_ntz")
    assert digest([("a|b", "c")], "x string, y string") != digest([("a", "b|c")], "x string, y string")
    assert digest([(None, "")], "x string, y string") != digest([("", None)], "x string, y string")


def test_a_fact_is_ordered_without_grouping_its_lines(raw, monkeypatch):
    """Whole lines are shuffled once, into their order; nothing keeps them in memory to count copies before."""
    handed = []
    monkeypatch.setattr(star, "row_positions", lambda df, order, name: handed.append(df) or df.withColumn(name, F.lit(1)))
    star.fact(cleaning.clean(raw)[1], "cancellation_line_id")
    assert "Aggregate" not in handed[0]._jdf.queryExecution().analyzed().toString()
