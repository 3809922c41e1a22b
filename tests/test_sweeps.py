import datetime

from pyspark.sql import functions as F

from basketry.operators import sweeps, tiering

SALES = "customer_id long, invoice string, stock_code string, invoice_date timestamp_ntz, revenue decimal(18,3)"


def lines(spark, rows):
    typed = [(c, i, s, datetime.datetime.fromisoformat(t), __import__("decimal").Decimal(str(r))) for c, i, s, t, r in rows]
    return spark.createDataFrame(typed, SALES)


def facts(spark):
    sales = lines(spark, [
        (1, "a", "x", "2020-01-05 10:00:00", 5), (1, "a", "y", "2020-01-05 10:00:00", 2), (1, "b", "x", "2020-01-05 23:59:59", 1),
        (1, "c", "z", "2020-03-01 00:00:00", 9), (1, "d", "z", "2020-03-20 08:00:00", 4), (2, "e", "x", "2020-02-28 12:00:00", 3),
        (2, "e", "w", "2020-03-02 12:00:00", 8), (3, "f", "x", "2020-06-30 12:00:00", 7)])
    back = lines(spark, [(1, "C1", "x", "2020-01-01 10:00:00", -1), (1, "C1", "y", "2020-04-01 10:00:00", -1), (2, "C2", "x", "2020-03-10 10:00:00", -1), (9, "C3", "x", "2020-03-10 10:00:00", -1)])
    return sales, back


def test_active_series_against_counting_each_day(spark):
    sales, _ = facts(spark)
    for days in (1, 30, 90):
        rows = {r.day: (r.active, r.ever, r.churned) for r in sweeps.active_series(sales, days).collect()}
        ordered = {(r.customer_id, r.invoice_date.date()) for r in sales.collect()}
        assert min(rows) == min(d for _, d in ordered) and len(rows) == (max(d for _, d in ordered) - min(rows)).days + days + 1
        for day, (active, ever, churned) in rows.items():
            now = {c for c, d in ordered if day - datetime.timedelta(days - 1) <= d <= day}
            so_far = {c for c, d in ordered if d <= day}
            assert (active, ever, churned) == (len(now), len(so_far), len(so_far - now))
    assert sweeps.active_series(sales.limit(0)).count() == 0


def test_features_as_of_are_those_of_each_cutoff(spark):
    sales, back = facts(spark)
    cutoffs = ["2019-12-31", "2020-01-05", "2020-01-06", "2020-03-01", "2020-03-02", "2020-03-03", "2020-05-01", "2020-07-01"]
    got = sweeps.features_as_of(sales, back, cutoffs)
    columns = got.columns[1:]
    want = [(c, *r) for c in cutoffs for r in tiering.features_at(sales, back, c).select(*columns).collect()]
    assert sorted(map(str, ((str(r.cutoff_date), *[r[c] for c in columns]) for r in got.collect()))) == sorted(map(str, want))
    assert sweeps.features_as_of(sales.limit(0), back, cutoffs).count() == 0
    assert got.filter(F.col("customer_id") == 9).count() == 0
