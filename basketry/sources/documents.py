"""Documents with front matter: split the header from the body, type the fields and validate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The document types a knowledge base may hold.
DOC_TYPES = ["metric_definition", "methodology", "data_caveat", "table", "policy", "faq"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (file_stem, content), one row per file; the folder's own README is no document."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stems = files.select(
        F.regexp_extract(F.col("path"), r"([^/]+)\.md$", 1).alias("file_stem"), F.col("value").alias("content")
    )
    return stems.filter(F.lower("file_stem") != "readme")


def parse_front_matter(files: DataFrame) -> DataFrame:
    """(file_stem, content) to one typed row per document; a file without a header has null fields."""
    parts = F.split("content", "---\n", 3)
    headed = files.withColumn("has_header", F.col("content").startswith("---\n") & (F.size(parts) == 3))
    split = headed.withColumn("front", F.when(F.col("has_header"), parts[1])).withColumn(
        "body", F.when(F.col("has_header"), F.trim(F.regexp_replace(parts[2], r"^\s+|\s+$", "")))
    )

    def field(name: str):
        """A scalar: quoted text without its quotes, else the text itself; null, ~ and nothing are null."""
        found = F.trim(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*)$", 1))
        double = F.regexp_extract(found, r'^"((?:[^"\\]|\\.)*)"', 1)
        single = F.regexp_extract(found, "^'((?:[^']|'')*)'", 1)
        return (
            F.when(found.startswith('"'), F.regexp_replace(double, r"\\(.)", "$1"))
            .when(found.startswith("'"), F.replace(single, F.lit("''"), F.lit("'")))
            .when(~found.isin("", "~", "null", "Null", "NULL"), F.regexp_replace(found, r"\s+#.*$", ""))
        )

    return split.select(
        "file_stem",
        field("id").alias("doc_id"),
        field("title").alias("title"),
        field("doc_type").alias("doc_type"),
        field("owner").alias("owner"),
        F.try_to_timestamp(field("last_updated"), F.lit("yyyy-MM-dd")).cast("date").alias("last_updated"),
        (field("deprecated") == "true").alias("deprecated"),
        field("superseded_by").alias("superseded_by"),
        "body",
    )


def invalid_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, problem) for every document that breaks a rule."""
    problems = F.array_compact(F.array(
        F.when(F.col("doc_id").isNull(), "missing front matter"),
        F.when(F.col("doc_id") != F.col("file_stem"), "id does not match the file name"),
        F.when(~F.coalesce(F.col("doc_type").isin(DOC_TYPES), F.lit(False)), "unknown doc_type"),
    ))
    own = documents.select(F.coalesce("doc_id", "file_stem").alias("doc_id"), F.explode(problems).alias("problem"))
    known = documents.select(F.col("doc_id").alias("superseded_by"))
    dangling = documents.filter("deprecated").join(known, "superseded_by", "left_anti").select(
        "doc_id", F.lit("deprecated without an existing successor").alias("problem")
    )
    return own.unionByName(dangling)
