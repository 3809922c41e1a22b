import datetime

import pytest
from pyspark.sql import functions as F

from basketry.operators import cleaning, quality, star

FIRST = datetime.date(2010, 1, 1)


def months(spark, counts):
    rows = [(datetime.date(2010 + i // 12, i % 12 + 1, 1), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "month date, rows long")


@pytest.mark.parametrize("counts, flagged", [
    ([100, 104, 98, 101, 99, 103, 100, 400, 102], [7]),
    ([100, 104, 98, 101, 99, 103, 10], [6]),
    ([100, 100, 100, 100, 101], [4]),   # no spread before, so any change is an anomaly
    ([100, 400], []),                    # too little history
])
def test_volume_anomalies(spark, counts, flagged):
    found = quality.volume_anomalies(months(spark, counts)).orderBy("month").collect()
    assert [i for i, r in enumerate(found) if r.anomaly] == flagged


def test_partial_periods(spark):
    d = datetime.date
    rows = [
        (d(2010, 12, 1), d(2010, 12, 1), d(2010, 12, 23)), (d(2011, 6, 1), d(2011, 6, 1), d(2011, 6, 10)),
        (d(2011, 11, 1), d(2011, 11, 1), d(2011, 11, 30)), (d(2011, 12, 1), d(2011, 12, 1), d(2011, 12, 9)),
    ]
    found = quality.partial_periods(spark.createDataFrame(rows, "month date, first_day date, last_day date")).orderBy("month").collect()
    assert [r.partial for r in found] == [False, True, False, True]
    assert found[3].days_covered == 9 and found[3].coverage == 0.29


@pytest.fixture(scope="module")
def load(raw):
    sales, cancelled = cleaning.clean(raw)
    return raw, sales, cancelled, star.build_star(sales, cancelled)


def status(checks):
    return {r.check_name: r.status for r in checks.collect()}


def test_a_good_load_passes(load):
    raw, sales, cancelled, tables = load
    checks = quality.run_checks(raw, sales, cancelled, tables)
    found = status(checks)
    assert len(found) == 17 and "FAIL" not in found.values()
    quality.require_no_failure(checks)
    assert quality.verdict(checks).first().ok


def test_lost_rows_fail(load):
    raw, sales, cancelled, tables = load
    lossy = {**tables, "fact_sales": tables["fact_sales"].filter("sales_line_id > 1")}
    checks = quality.run_checks(raw, sales, cancelled, lossy)
    failed = {n for n, s in status(checks).items() if s == "FAIL"}
    assert failed == {"row_count_fact_sales", "revenue_reconciliation_fact_sales"}
    with pytest.raises(quality.QualityError):
        quality.require_no_failure(checks)


def test_negative_price_is_loud_and_a_dropped_country_is_silent(load):
    raw, sales, cancelled, tables = load
    flipped = cleaning.inject_fault(tables["fact_sales"], "negative_price", "1")
    assert status(quality.run_checks(raw, sales, cancelled, {**tables, "fact_sales": flipped}))["positive_quantity_price_sales"] == "FAIL"
    lost = cleaning.inject_fault(sales, "drop_country", "NATION_5")
    found = status(quality.run_checks(raw, lost, cancelled, star.build_star(lost, cancelled)))
    assert "FAIL" not in found.values()
    with pytest.raises(ValueError):
        cleaning.inject_fault(sales, "nonsense", "1")


def test_schema_drift(raw, load):
    drifted = raw.withColumnRenamed("price", "unit_price").withColumn("quantity", F.col("quantity").cast("string"))
    found = {r["column"]: r.problem for r in quality.contract_diff(drifted, quality.RAW_CONTRACT, families=True).collect()}
    assert found == {"price": "missing", "unit_price": "unexpected", "quantity": "retyped"}
    row = quality.raw_contract_check(drifted).first()
    assert row.status == "FAIL" and "missing price" in row.detail
    assert quality.warehouse_problems(load[3]).count() == 0


def test_orphans_and_repeated_keys(load):
    _, _, _, tables = load
    broken = {**tables, "dim_product": tables["dim_product"].filter("stock_code <> 'PART-7'"),
              "dim_customer": tables["dim_customer"].unionByName(tables["dim_customer"])}
    assert quality.referential_integrity_check(broken).first().status == "FAIL"
    assert quality.unique_keys_check(broken).first().status == "FAIL"
