"""Loads that add to a warehouse: only new lines are cleaned, and per-key states stand for all earlier ones.

A load takes the raw lines after the last moment that is loaded. Its facts are cleaned, numbered behind the rows there are
(line ids go by time first, so they are those of one whole load) and written as one more part; nothing of earlier parts is
read. What dimensions are made from is kept as states that add up: lines per customer and country, first and last
sale, lines per product and description, the calendar's ends, and each fact's row count and digest, which is a sum over
rows. A load publishes the merged states and the list of parts as one version, so readers see a load whole or not
at all, and of two loads from the same version one fails.

Lines that are not later than what is loaded are refused, all of them counted. A load without new lines publishes
nothing. Rows without a moment belong to no load and are refused too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import cleaning, star
from basketry.sources import versions

_FACTS = {"fact_sales": "sales_line_id", "fact_cancellations": "cancellation_line_id"}
_DIMENSIONS = ["dim_date", "dim_customer", "dim_product"]
_COUNTED = {"homes": ["customer_id", "country"], "sold_as": ["stock_code", "description"], "returned_as": ["stock_code", "description"]}
_STATES = [*_COUNTED, "spans", "facts", "parts"]


class LateLines(ValueError):
    """Lines of a load that lie before the end of an earlier one."""


def _counted(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def states_of(sales: DataFrame, cancellations: DataFrame, facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The states of one load; ``facts`` are its numbered lines."""
    spans = sales.groupBy("customer_id").agg(F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last"))
    out = None
    for name, df in facts.items():
        ends = df.agg(F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last"))
        digest = star.table_digest(df, name).withColumn("digest", F.col("digest").cast("decimal(38,0)"))
        one = digest.join(ends)  # one row each
        out = one if out is None else out.unionByName(one)
    homes = sales.select("customer_id", "country").unionByName(cancellations.select("customer_id", "country"))
    return {
        "homes": _counted(homes, ["customer_id", "country"]), "sold_as": _counted(sales, ["stock_code", "description"]),
        "returned_as": _counted(cancellations, ["stock_code", "description"]), "spans": spans, "facts": out,
    }


def merged(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """States of both loads together."""
    out = {name: old[name].unionByName(new[name]).groupBy(*keys).agg(F.sum("n").alias("n")) for name, keys in _COUNTED.items()}
    ends = [F.min("first").alias("first"), F.max("last").alias("last")]
    out["spans"] = old["spans"].unionByName(new["spans"]).groupBy("customer_id").agg(*ends)
    out["facts"] = old["facts"].unionByName(new["facts"]).groupBy("table_name").agg(F.sum("row_count").alias("row_count"), F.sum("digest").alias("digest"), *ends)
    return out


def _commonest(counts: DataFrame, key: str, value: str) -> DataFrame:
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(value).alias("value"))))
    return counts.groupBy(key).agg(best.alias("best")).select(key, F.col("best.value").alias(value))


def dimensions(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    homes = _commonest(states["homes"], "customer_id", "country")
    people = homes.join(states["spans"], "customer_id", "left").select(
        "customer_id", "country", F.col("first").alias("first_invoice_date"), F.col("last").alias("last_invoice_date"))
    named = _commonest(states["sold_as"], "stock_code", "description").withColumn("sold", F.lit(True))
    returned = _commonest(states["returned_as"], "stock_code", "description").withColumnRenamed("description", "back")
    products = named.join(returned, "stock_code", "full_outer").select(
        "stock_code", F.coalesce("description", "back").alias("description"), (~cleaning.is_non_product(F.col("stock_code"))).alias("is_product"))
    ends = states["facts"].select(F.explode(F.array("first", "last")).alias("invoice_date")).filter("invoice_date is not null")
    return {"dim_date": star.calendar(ends, ends), "dim_customer": people, "dim_product": products}


def load(spark: SparkSession, raw: DataFrame, root: str) -> str | None:
    """Add the raw lines to the warehouse in ``root``; the name of the new version."""
    parent = versions.newest(spark, root)
    old = versions.read_version(spark, root, versions.live_version(spark, root), _STATES) if parent else None
    known = {r["table_name"]: r for r in old["facts"].collect()} if old else {}  # a row per fact
    ends = [r["last"] for r in known.values() if r["last"] is not None]
    late = F.col("invoice_date").isNull()
    if ends:
        late = late | (F.col("invoice_date") <= F.lit(max(ends)))
    n_late = raw.filter(late).count()
    if n_late:
        raise LateLines(f"{n_late} lines are not later than what is loaded")
    part = f"{root}/parts/{uuid.uuid4().hex}"
    sales, cancellations = cleaning.clean(raw)
    lines = versions.write_tables({"sales": sales, "cancellations": cancellations}, part)
    facts = {}
    for (name, line_id), kind in zip(_FACTS.items(), ("sales", "cancellations")):
        before = known[name]["row_count"] if name in known else 0
        facts[name] = star.fact(lines[kind], line_id).withColumn(line_id, F.col(line_id) + F.lit(before).cast("bigint"))
    facts = versions.write_tables(facts, part)
    new = states_of(lines["sales"], lines["cancellations"], facts)
    if not any(r["row_count"] for r in new["facts"].collect()):
        return None
    states = merged(old, new) if old else new
    listed = spark.createDataFrame([(parent + 1, part)], "load int, folder string")
    states["parts"] = old["parts"].unionByName(listed) if old else listed
    return versions.publish(spark, {**states, **dimensions(states)}, root, parent)


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The star as of the newest version."""
    version = versions.live_version(spark, root)
    out = versions.read_version(spark, root, version, _DIMENSIONS)
    parts = [r["folder"] for r in versions.read_version(spark, root, version, ["parts"])["parts"].orderBy("load").collect()]  # a row per load
    return {**out, **{name: spark.read.parquet(*[f"{p}/{name}" for p in parts]) for name in _FACTS}}


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, row_count, digest) of every table: facts from their states, without reading them; dimensions anew."""
    version = versions.live_version(spark, root)
    facts = versions.read_version(spark, root, version, ["facts"])["facts"].select("table_name", "row_count", F.col("digest").cast("string").alias("digest"))
    return facts.unionByName(star.table_digests(versions.read_version(spark, root, version, _DIMENSIONS)))
