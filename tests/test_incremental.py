import pytest
from pyspark.sql import functions as F

from basketry.operators import cleaning, incremental, star
from basketry.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"


def test_three_loads_are_one_load(spark, tmp_path):
    raw = Workspace.of(spark, SF).raw()
    root = str(tmp_path / "w")
    cuts = ["1900-01-01", "1997-03-04", "1999-10-11", "2100-01-01"]
    for a, b in zip(cuts, cuts[1:]):
        part = raw.filter((F.col("invoice_date") >= F.lit(a).cast("timestamp_ntz")) & (F.col("invoice_date") < F.lit(b).cast("timestamp_ntz")))
        assert incremental.load(spark, part, root)
    whole = star.build_star(*cleaning.clean(raw))
    loaded = incremental.read(spark, root)
    assert star.fingerprint({n: loaded[n] for n in star.TABLES}).first() == star.fingerprint(whole).first()
    assert sorted(map(tuple, incremental.digests(spark, root).collect())) == sorted(map(tuple, star.table_digests(whole).collect()))
    with pytest.raises(incremental.LateLines, match="1 lines"):
        incremental.load(spark, raw.limit(1), root)
    assert incremental.load(spark, raw.limit(0), root) is None
    assert incremental.read(spark, root)["fact_sales"].count() == whole["fact_sales"].count()


def test_first_load_of_the_small_case(spark, raw, tmp_path):
    root = str(tmp_path / "w")
    incremental.load(spark, raw, root)
    loaded = incremental.read(spark, root)
    whole = star.build_star(*cleaning.clean(raw))
    for name in star.TABLES:
        assert sorted(map(str, loaded[name].select(*whole[name].columns).collect())) == sorted(map(str, whole[name].collect()))
