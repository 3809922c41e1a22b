from pyspark.sql import functions as F

from basketry.operators import cleaning
from tests.conftest import make_raw


def test_clean_keeps_sales_and_cancellations_apart(raw):
    sales, cancelled = cleaning.clean(raw)
    assert {r.stock_code for r in sales.collect()} == {"PART-7", "PART-9"}
    assert [r.invoice for r in cancelled.collect()] == ["C4003"]
    assert float(sales.agg(F.sum("revenue")).first()[0]) == 8.75
    assert float(cancelled.agg(F.sum("revenue")).first()[0]) == -4.5
    assert dict(sales.dtypes)["customer_id"] == "int"


def test_cleaning_log_counts_every_step(raw):
    log = {r.step: r for r in cleaning.cleaning_log(raw).collect()}
    assert [log[s].removed for s in cleaning.STEPS] == [1, 1, 3, 2, 3]
    ordered = [log[s] for s in cleaning.STEPS]
    assert ordered[0].rows_before == 12 and ordered[-1].rows_after == 2
    assert all(a.rows_after == b.rows_before for a, b in zip(ordered, ordered[1:]))


def test_cleaning_log_of_nothing(spark, raw):
    log = cleaning.cleaning_log(raw.limit(0)).collect()
    assert len(log) == 5 and all(r.removed == 0 and r.pct_removed == 0.0 for r in log)


def test_non_product_codes_match_whole_or_by_prefix(spark):
    codes = ["POST", "post", "POSTER1", "M", "M123", "ADJUST", "ADJUST2", "TEST001", "85123A", "BANK CHARGES", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    found = [r[0] for r in df.orderBy("i").select(cleaning.is_non_product(F.col("code"))).collect()]
    assert found == [True, True, False, True, False, True, True, True, False, True, False]


def test_dropped_codes(raw):
    assert {r.stock_code: r.rows_dropped for r in cleaning.dropped_codes(raw).collect()} == {
        "ADJUST": 1, "BANK CHARGES": 1, "TEST002": 1,
    }


def test_cancellation_rates(spark, raw):
    rates = cleaning.cancellation_rates(raw).first()
    assert rates.cancelled_invoices == 1 and rates.cancel_rate_by_invoices_pct == 11.11
    two = make_raw(spark, [
        ("1", "A", "x", 10, "2011-01-01", 1.0, 1, "UK"), ("C2", "A", "x", -2, "2011-01-02", 1.0, 1, "UK"),
    ])
    rates = cleaning.cancellation_rates(two).first()
    assert rates.cancel_rate_by_revenue_pct == 20.0 and rates.cancel_rate_by_invoices_pct == 50.0


def test_only_repeated_lines_are_grouped_whole(spark, monkeypatch):
    rows = [(i, None if i % 3 else "a", "b") for i in range(50)] + [(7, None, "b"), (9, "a", "b"), (9, "a", "b"), (None, "x", None), (None, None, "x"), (None, None, "x")]
    lines = spark.createDataFrame(rows, "i int, s string, t string")
    for limit in (cleaning.BROADCAST_HASHES, 0):
        monkeypatch.setattr(cleaning, "BROADCAST_HASHES", limit)
        found = cleaning.without_duplicates(lines)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(set(rows), key=str)
        assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString() and found.columns == lines.columns
