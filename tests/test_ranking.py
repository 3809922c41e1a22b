"""Global ranking against pandas, with a third of all rows on one value and more slices than values."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import ranking


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 3000
    value = np.where(rng.random(n) < 0.34, 7, rng.integers(0, 200, n)).astype(float)
    value[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n)), "v": value,
                        "w": rng.integers(1, 9, n)})
    rows = [(int(i), g, None if np.isnan(v) else float(v), int(w)) for i, g, v, w in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, g string, v double, w long").repartition(16), pdf


def test_row_positions(table):
    df, pdf = table
    got = ranking.row_positions(df.filter("v is not null"), [F.desc("v"), "id"]).toPandas().sort_values("position")
    want = pdf.dropna().sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["position"].tolist() == list(range(1, len(want) + 1))


def test_running_totals(table):
    df, pdf = table
    got = ranking.running_totals(df, ["w", "id"], {"total": "w"}, "place").toPandas().sort_values("place")
    want = pdf.sort_values(["w", "id"])
    assert got["total"].tolist() == want["w"].cumsum().tolist()
    assert got["place"].tolist() == list(range(1, len(pdf) + 1))


def test_group_positions(table):
    df, pdf = table
    got = ranking.group_positions(df, ["g"], [F.desc("w"), "id"]).toPandas().set_index("id")
    want = pdf.sort_values(["w", "id"], ascending=[False, True])
    want["p"] = want.groupby("g").cumcount() + 1
    assert (got["position"].loc[want["id"]].to_numpy() == want["p"].to_numpy()).all()
    assert got["group_rows"].loc[want["id"]].tolist() == want.groupby("g")["id"].transform("size").tolist()


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_tie_ranks_are_average_ranks(table, groups):
    df, pdf = table
    ranks = ranking.tie_ranks(df, "v", groups).toPandas()
    ranks["average"] = ranks["below"] + (ranks["ties"] + 1) / 2
    got = pdf.dropna().merge(ranks, on=[*groups, "v"])
    want = pdf.dropna().copy()
    want["r"] = want.groupby("g")["v"].rank() if groups else want["v"].rank()
    both = got.merge(want[["id", "r"]], on="id")
    assert len(both) == len(want) and (both["average"] == both["r"]).all()


def test_quantiles_interpolate_like_pandas(table):
    df, pdf = table
    got = ranking.quantiles(df, "v", {"q1": 0.2, "q2": 0.5, "q3": 0.95}, ["g"]).toPandas().set_index("g")
    for g, values in pdf.groupby("g")["v"]:
        assert got.loc[g].tolist() == pytest.approx(values.quantile([0.2, 0.5, 0.95]).tolist())


def test_quantiles_of_nothing(table):
    df, _ = table
    assert ranking.quantiles(df.filter("false"), "v", {"q": 0.5}).first().q is None


def test_rows_with_ranks_and_a_value_held_by_half(spark):
    rows = [(i, "ab"[i % 2], None if i % 50 == 0 else 0.0 if i % 2 else float(i // 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(8)
    got = ranking.with_tie_ranks(df, "v", ["g"])
    pdf = got.toPandas()
    assert len(pdf) == 4000 and pdf.loc[pdf.v.isna(), "ties"].isna().all()
    held = pdf.dropna(subset=["v"])
    assert ((held["below"] + (held["ties"] + 1) / 2) == held.groupby("g")["v"].rank()).all()
    assert (held["size"] == held.groupby("g")["v"].transform("size")).all()


def test_no_exchange_on_the_group_alone(spark):
    """Neither numbering nor ranking sends a whole group to one task."""
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 7 as v")
    for made in (ranking.group_positions(df, ["g"], ["v", "id"]), ranking.with_tie_ranks(df, "v", ["g"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
        assert not any("[g#" in line and "v#" not in line for line in joins), plan
