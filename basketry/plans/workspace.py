"""Tables shared by many products, written once per application and read back by each of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import cleaning, marts, star, tiering
from basketry.sources import retail
from basketry.session import shared_folder
from basketry.sources.versions import publish, read_live, write_tables

# Scoring dates on the supplied data: features before a date, outcome in the half year after it.
TRAIN_CUTOFF, CUTOFF, OUTCOME_END = "1999-12-01", "2000-06-01", "2000-12-01"
FAULTY_COUNTRY = "NATION_3"

_OPEN: dict[tuple[str, str], "Workspace"] = {}


class Workspace:
    """Source tables of one folder plus the derived tables written for this application."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self.root = f"{shared_folder(spark)}/basketry-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._models: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, str(sf_dir))
        if key not in _OPEN:
            _OPEN[key] = cls(spark, sf_dir)
        return _OPEN[key]

    def source(self, name: str) -> DataFrame:
        return retail.table(self.spark, self.sf_dir, name)

    def scratch(self, name: str) -> str:
        """A fresh folder for one write of one product."""
        return f"{self.root}/scratch/{name}-{uuid.uuid4().hex}"

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """``build()`` written to the shared folder on first use; later uses read the files."""
        if name not in self._tables:
            path = f"{self.root}/tables/{name}"
            build().write.mode("overwrite").parquet(path)
            self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]

    def fitted(self, name: str, fit: Callable):
        """A model fitted once for this application."""
        if name not in self._models:
            self._models[name] = fit()
        return self._models[name]

    def raw(self) -> DataFrame:
        return self.written("raw_lines", lambda: retail.raw_lines(self.spark, self.sf_dir))

    def _cleaned(self, name: str) -> DataFrame:
        if name not in self._tables:
            sales, cancellations = cleaning.clean(self.raw())
            both = {"sales": sales, "cancellations": cancellations}
            self._tables.update(write_tables(both, f"{self.root}/tables"))
        return self._tables[name]

    def sales(self) -> DataFrame:
        return self._cleaned("sales")

    def cancellations(self) -> DataFrame:
        return self._cleaned("cancellations")

    def star_folder(self) -> str:
        return f"{self.root}/star"

    def star(self, name: str) -> DataFrame:
        if name not in self._tables:
            publish(self.spark, star.build_star(self.sales(), self.cancellations()), self.star_folder())
            self._tables.update(read_live(self.spark, self.star_folder(), star.TABLES))
        return self._tables[name]

    def stars(self) -> dict[str, DataFrame]:
        return {name: self.star(name) for name in star.TABLES}

    def faulty_stars(self) -> dict[str, DataFrame]:
        """The star of a load that silently lost one country."""
        if "faulty.fact_sales" not in self._tables:
            lost = cleaning.inject_fault(self.sales(), "drop_country", FAULTY_COUNTRY)
            root = f"{self.root}/star-faulty"
            publish(self.spark, star.build_star(lost, self.cancellations()), root)
            for name, df in read_live(self.spark, root, star.TABLES).items():
                self._tables[f"faulty.{name}"] = df
        return {name: self._tables[f"faulty.{name}"] for name in star.TABLES}

    def second_stars(self) -> dict[str, DataFrame]:
        """The star of a second load, built from the source tables anew."""
        if "second.fact_sales" not in self._tables:
            raw = self.written("second_raw_lines", lambda: retail.raw_lines(self.spark, self.sf_dir))
            sales, cancellations = cleaning.clean(raw)
            both = write_tables({"second_sales": sales, "second_cancellations": cancellations}, f"{self.root}/tables")
            root = f"{self.root}/star-second"
            publish(self.spark, star.build_star(both["second_sales"], both["second_cancellations"]), root)
            for name, df in read_live(self.spark, root, star.TABLES).items():
                self._tables[f"second.{name}"] = df
        return {name: self._tables[f"second.{name}"] for name in star.TABLES}

    def second_scored(self) -> DataFrame:
        stars = self.second_stars()
        return self.written("second_customer_tiers", lambda: tiering.score_customers(
            tiering.features_at(stars["fact_sales"], stars["fact_cancellations"], CUTOFF)))

    def stg_sales(self) -> DataFrame:
        return marts.stg_sales(self.star("fact_sales"))

    def stg_cancellations(self) -> DataFrame:
        return marts.stg_cancellations(self.star("fact_cancellations"))

    def snapshots(self) -> DataFrame:
        return self.written(
            "mart_customer_features",
            lambda: tiering.feature_snapshots(self.stg_sales(), self.stg_cancellations(), [TRAIN_CUTOFF, CUTOFF]),
        )

    def features(self, cutoff: str = CUTOFF) -> DataFrame:
        return self.snapshots().filter(f"cutoff_date = DATE '{cutoff}'").drop("cutoff_date")

    def scored(self) -> DataFrame:
        return self.written("mart_customer_tiers", lambda: tiering.score_customers(self.features()))

    def faulty_scored(self) -> DataFrame:
        stars = self.faulty_stars()
        return self.written("faulty_customer_tiers", lambda: tiering.score_customers(
            tiering.features_at(stars["fact_sales"], stars["fact_cancellations"], CUTOFF)))

    def future(self) -> DataFrame:
        return tiering.future_revenue(self.star("fact_sales"), CUTOFF, OUTCOME_END)

    def scored_outcome(self) -> DataFrame:
        """Scored customers with what they spent in the outcome window."""
        return self.written("scored_outcome", lambda: tiering.with_outcome(self.scored(), self.future()))
