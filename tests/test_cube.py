import datetime
import random
from collections import defaultdict
from decimal import Decimal

from basketry.operators import cube

SALES = "customer_id long, country string, stock_code string, invoice_date timestamp_ntz, revenue decimal(18,3)"


def sales(spark, n=3000):
    rng = random.Random(5)
    rows = [(rng.randrange(400), rng.choice(["FR", "FR", "DE", "UK"]), rng.choice("abcdef"), datetime.datetime(rng.choice([2019, 2020]), 5, 1), Decimal(rng.randrange(1, 10**6)) / 1000)
            for _ in range(n)]
    return spark.createDataFrame(rows, SALES)


def test_states_of_parts_are_states_of_the_whole(spark):
    rows = sales(spark)
    early, late = rows.filter("customer_id < 150"), rows.filter("customer_id >= 150")
    sums = [sorted(map(str, cube.revenue_cube(s).collect())) for s in (cube.sum_states(rows), cube.merged(cube.sum_states(early), cube.sum_states(late)))]
    assert sums[0] == sums[1]
    states = cube.merged(cube.sketch_states(early), cube.sketch_states(late))
    assert all(r.customers_close and r.median_close for r in cube.checked(rows, states).collect())


def test_cube_against_plain_sums(spark):
    rows = sales(spark, 500)
    want = defaultdict(lambda: [Decimal(0), 0])
    for r in rows.collect():
        cells = {"year": r.invoice_date.year, "country": r.country, "stock_code": r.stock_code}
        for level in cube.SUM_LEVELS:
            cell = want[tuple(cells[k] if k in level else None for k in cells)]
            cell[0] += r.revenue
            cell[1] += 1
    got = {(r.year, r.country, r.stock_code): [r.revenue, r.lines] for r in cube.revenue_cube(cube.sum_states(rows)).collect()}
    assert got == dict(want)
    judged = cube.checked(rows, cube.sketch_states(rows)).collect()
    assert len(judged) == 2 * 3 + 2 + 3 + 1 and all(r.customers_close and r.median_close for r in judged)
    assert cube.revenue_cube(cube.sum_states(rows.limit(0))).count() <= 1
