"""Registered sources, sinks, star schema, quality checks, marts and declarative tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import incremental, marts, quality, star
from basketry.operators.tiering import TIER_SHARES
from basketry.plans.oracle import using
from basketry.plans.registry import register
from basketry.plans.workspace import FAULTY_COUNTRY, Workspace
from basketry.sources import documents, files, retail, versions

_STAR = "dim_date dim_customer dim_product fact_sales fact_cancellations"
_TS = "'%Y-%m-%d %H:%M:%S'"
_TS_EXACT = "'%Y-%m-%d %H:%M:%S.%f'"


def _shown(df):
    """Timestamps as text and decimals as doubles, the form in which two engines are compared."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "smallint":
            column = column.cast("int")
        out.append(column.alias(name))
    return df.select(*out)


# ---- sources and sinks ------------------------------------------------------------------------------

_BY_YEAR = """
SELECT year(invoice_date) AS year, count(*) AS lines, count(customer_id) AS attributed, count(DISTINCT invoice) AS invoices,
       CAST(sum(quantity) AS BIGINT) AS units, sum(quantity * price)::DOUBLE AS value
FROM raw_lines GROUP BY 1"""


def _by_year(df):
    return df.groupBy(F.year("invoice_date").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("customer_id").alias("attributed"),
        F.count_distinct("invoice").alias("invoices"), F.sum("quantity").alias("units"),
        F.sum(F.col("quantity") * F.col("price")).cast("double").alias("value"),
    )


def _yearly_exports(ws: Workspace, name: str) -> list[str]:
    """The raw lines written as one CSV export per year."""
    folder = ws.scratch(name)
    out = ws.raw().withColumn("year", F.year("invoice_date")).withColumn(
        "invoice_date", F.date_format("invoice_date", "yyyy-MM-dd'T'HH:mm:ss")
    )
    out.write.mode("overwrite").partitionBy("year").option("header", True).option("escape", '"').csv(folder)
    years = [r["year"] for r in ws.star("dim_date").select("year").distinct().orderBy("year").collect()]
    return [f"{folder}/year={year}" for year in years]  # one path per calendar year


@register("s1_stack_yearly_exports", using("raw_lines", _BY_YEAR))
def s1(ws: Workspace):
    return _by_year(files.read_yearly_exports(ws.spark, _yearly_exports(ws, "exports")))


@register("s2_parse_once_cache", using("raw_lines", _BY_YEAR))
def s2(ws: Workspace):
    cache = ws.scratch("raw-cache")
    files.parse_once(ws.spark, cache, ws.raw)
    return _by_year(files.parse_once(ws.spark, cache, ws.raw))


@register("s3_table_profile", using("raw_lines", " UNION ALL ".join(
    f"SELECT count(*) AS rows, 8 AS columns, strftime(min(invoice_date), {_TS}) AS first_date,"
    f" strftime(max(invoice_date), {_TS}) AS last_date, '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS type,"
    f" count(*) - count({f.name}) AS nulls FROM raw_lines"
    for f in retail.RAW_SCHEMA.fields)))
def s3(ws: Workspace):
    return _shown(files.profile(ws.raw(), "invoice_date"))


@register("s4_stage_hand_off", using("raw_lines sales cancellations", """
SELECT 'raw' AS stage, count(*) AS rows FROM raw_lines UNION ALL SELECT 'sales', count(*) FROM sales
UNION ALL SELECT 'cancellations', count(*) FROM cancellations"""))
def s4(ws: Workspace):
    run = ws.scratch("run")
    files.hand_off({"raw": ws.raw(), "sales": ws.sales(), "cancellations": ws.cancellations()}, run)
    staged = files.pick_up(ws.spark, run, ["raw", "sales", "cancellations"])
    return star.table_counts(staged).withColumnsRenamed({"table_name": "stage", "row_count": "rows"})


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in star.TABLES)


@register("s5_versioned_publish", using(_STAR, _COUNTS))
def s5(ws: Workspace):
    root = ws.scratch("published")
    versions.publish(ws.spark, {t: df.limit(0) for t, df in ws.stars().items()}, root)  # an earlier, empty version
    versions.publish(ws.spark, ws.stars(), root)
    return star.table_counts(versions.read_live(ws.spark, root, star.TABLES))


def _digest_sql(table: str) -> str:
    columns = {
        "dim_date": ["date_key", "full_date", "year", "quarter", "month", "month_name", "month_start", "day_of_month",
                     "day_of_week", "day_name", "is_weekend"],
        "dim_customer": ["customer_id", "country", "first_invoice_date", "last_invoice_date"],
        "dim_product": ["stock_code", "description", "is_product"],
    }
    line = ["invoice", "invoice_date", "date_key", "customer_id", "stock_code", "country", "quantity", "price", "revenue"]
    columns["fact_sales"] = ["sales_line_id", *line]
    columns["fact_cancellations"] = ["cancellation_line_id", *line]
    texts = [
        f"coalesce({f'strftime({c}, {_TS_EXACT})' if 'invoice_date' in c else f'CAST({c} AS VARCHAR)'}, '<null>')"
        for c in columns[table]
    ]
    parts = " || ".join(f"length({t}) || ':' || {t}" for t in texts)
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count,
  CAST(coalesce(sum(('0x' || substr(md5({parts}), 1, 15))::BIGINT), 0) AS VARCHAR) AS digest FROM {table}"""


_DIGESTS = " UNION ALL ".join(_digest_sql(t) for t in star.TABLES)
_PRINT = f"(SELECT md5(string_agg(table_name || ':' || row_count || ':' || digest, '|' ORDER BY table_name || ':' || row_count || ':' || digest)) FROM ({_DIGESTS}))"


@register("s6_run_log_append", using(_STAR, f"""
SELECT unnest([1, 2])::BIGINT AS run_id, (SELECT count(*) FROM sales) AS sales_rows, (SELECT count(*) FROM cancellations) AS cancel_rows,
       (SELECT sum(revenue)::DOUBLE FROM sales) AS sales_revenue,
       (SELECT strftime(max(invoice_date), {_TS}) FROM sales) AS max_invoice_date, {_PRINT} AS fingerprint"""))
def s6(ws: Workspace):
    log = ws.scratch("run-log")
    for run_id in (1, 2):
        files.append_run(files.run_record(ws.stars(), run_id), log)
    return _shown(ws.spark.read.parquet(log).drop("finished_at"))


@register("s7_last_fingerprints", using(_STAR, f"SELECT unnest([3, 2])::BIGINT AS run_id, {_PRINT} AS fingerprint"))
def s7(ws: Workspace):
    log = ws.scratch("run-log")
    record = files.run_record(ws.stars(), 1)
    for run_id in (1, 2, 3):
        files.append_run(record.withColumn("run_id", F.lit(run_id).cast("bigint")), log)
    return files.last_runs(ws.spark.read.parquet(log), 2).select("run_id", "fingerprint")


@register("s8_csv_sink", using("scored", "SELECT customer_id, score, tier FROM scored"))
def s8(ws: Workspace):
    path = ws.scratch("customer-tiers")
    files.write_export(ws.scored().select("customer_id", "score", "tier"), path)
    return ws.spark.read.schema("customer_id INT, score DOUBLE, tier STRING").option("header", True).csv(path)


@register("s9_metrics_json", using("sales", """
SELECT country, sum(revenue)::DOUBLE AS revenue, count(DISTINCT invoice) AS orders FROM sales GROUP BY country"""))
def s9(ws: Workspace):
    path = ws.scratch("metrics")
    metrics = ws.star("fact_sales").groupBy("country").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.count_distinct("invoice").alias("orders")
    )
    files.write_json(metrics, path)
    return ws.spark.read.schema(metrics.schema).json(path)


def _faulty_checks(ws: Workspace):
    """Checks of a load whose first ten prices were negated and that lost a country on the way."""
    from basketry.operators.cleaning import inject_fault

    tables = dict(ws.stars())
    lost = inject_fault(tables["fact_sales"], "drop_country", FAULTY_COUNTRY)
    tables["fact_sales"] = inject_fault(lost, "negative_price", "10")
    return ws.written("faulty_checks", lambda: quality.run_checks(ws.raw(), ws.sales(), ws.cancellations(), tables))


_BROKEN = f"""
broken AS (SELECT * REPLACE (CASE WHEN sales_line_id <= 10 THEN -price ELSE price END AS price,
                             CASE WHEN sales_line_id <= 10 THEN -revenue ELSE revenue END AS revenue)
           FROM fact_sales WHERE country <> '{FAULTY_COUNTRY}')"""
_ALERTS = f"""
SELECT 'row_count_fact_sales' AS "check", 'loaded ' || (SELECT count(*) FROM broken) || ' vs ' || (SELECT count(*) FROM sales) AS message
UNION ALL
SELECT 'revenue_reconciliation_fact_sales', 'loaded ' || CAST((SELECT sum(revenue) FROM broken) AS DECIMAL(24,3))
       || ' vs cleaned ' || CAST((SELECT sum(revenue) FROM sales) AS DECIMAL(24,3))
UNION ALL
SELECT 'positive_quantity_price_sales', (SELECT count(*) FROM broken WHERE price <= 0) || ' lines with a quantity or price of 0 or less'"""


@register("s10_alert_records", using("fact_sales", f"WITH {_BROKEN} SELECT 'error' AS severity, 'quality' AS source, *, 'run-1' AS run_id FROM ({_ALERTS})"))
def s10(ws: Workspace):
    path = ws.scratch("alerts")
    records = quality.alerts(_faulty_checks(ws), "quality", "run-1")
    files.write_json(records, path, mode="append")
    return ws.spark.read.schema(records.schema).json(path).select("severity", "source", "check", "message", "run_id")


def _front_matter(ws: Workspace):
    """Documents as knowledge files: a typed header built from their columns in front of the text."""
    flags = ws.source("labels").select("doc_id", "toxic")
    docs = ws.source("documents").join(flags, "doc_id", "left")
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    lines = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), name), F.concat(F.lit('title: "Document '), F.col("doc_id"), F.lit('"')),
        F.concat(F.lit("doc_type: "), F.when(F.col("lang") == "en", "metric_definition").otherwise("faq")),
        F.concat(F.lit("owner: "), F.col("source")), F.lit("last_updated: 2011-06-20"),
        F.concat(F.lit("deprecated: "), F.when(toxic, "true").otherwise("false")),
        F.when(toxic, F.concat(F.lit("superseded_by: doc-"), F.col("doc_id") - 1)),
        F.lit("---"), F.col("text"),
    )
    return docs.select(name.alias("file_stem"), lines.alias("content"))


@register("s11_front_matter_documents", """
SELECT 'doc-' || doc_id AS doc_id, 'Document ' || doc_id AS title,
       CASE WHEN lang = 'en' THEN 'metric_definition' ELSE 'faq' END AS doc_type, source AS owner,
       DATE '2011-06-20' AS last_updated, coalesce(toxic, 0) = 1 AS deprecated,
       CASE WHEN toxic = 1 THEN 'doc-' || (doc_id - 1) END AS superseded_by,
       md5(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS body_md5
FROM documents LEFT JOIN labels USING (doc_id)""")
def s11(ws: Workspace):
    parsed = documents.parse_front_matter(_front_matter(ws))
    return parsed.select(
        "doc_id", "title", "doc_type", "owner", "last_updated", "deprecated", "superseded_by",
        F.md5("body").alias("body_md5"),
    )


@register("s11_document_validation", """
SELECT 'doc-' || doc_id AS doc_id, 'deprecated without an existing successor' AS problem
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id - 1 NOT IN (SELECT doc_id FROM documents)""")
def s11_validation(ws: Workspace):
    return documents.invalid_documents(documents.parse_front_matter(_front_matter(ws)))


@register("s11_document_validation_of_lost_successors", """
SELECT 'doc-' || doc_id AS doc_id, 'deprecated without an existing successor' AS problem FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def s11_faulty(ws: Workspace):
    """The same validation after a rename that left every successor behind."""
    renamed = _front_matter(ws).withColumn("content", F.regexp_replace("content", "(?m)^superseded_by: ", "superseded_by: former-"))
    return documents.invalid_documents(documents.parse_front_matter(renamed))


QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("difficulty", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("unit", T.StringType()),
    T.StructField("relevant", T.ArrayType(T.StringType())), T.StructField("traps", T.ArrayType(T.StringType())),
])


@register("s12_question_sets", """
SELECT 'q' || item_id AS id, CASE WHEN item_id % 4 = 0 THEN 'unanswerable' ELSE 'answerable' END AS difficulty,
       md5(text) AS question_md5, ['doc-' || item_id, 'doc-' || (item_id + 1)] AS relevant, len(text) AS letters
FROM benchmark""")
def s12(ws: Workspace):
    path = ws.scratch("questions")
    item = F.col("item_id")
    questions = ws.source("benchmark").select(
        F.concat(F.lit("q"), item).alias("id"),
        F.when(item % 4 == 0, "unanswerable").otherwise("answerable").alias("difficulty"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("unit"),
        F.array(F.concat(F.lit("doc-"), item), F.concat(F.lit("doc-"), item + 1)).alias("relevant"),
        F.array().cast("array<string>").alias("traps"),
    )
    files.write_json(questions, path)
    read = ws.spark.read.schema(QUESTION_SCHEMA).json(path)
    return read.select(
        "id", "difficulty", F.md5("question").alias("question_md5"), "relevant",
        F.length("question").cast("bigint").alias("letters"),
    )


@register("s13_label_csv", """
SELECT 'L' || doc_id AS label_id, quality AS faithful, toxic AS citation_correct, 'source, checked' AS notes FROM labels""")
def s13(ws: Workspace):
    path = ws.scratch("labels")
    filled = {
        "label_id": F.concat(F.lit("L"), F.col("doc_id")), "faithful": F.concat(F.lit(" "), F.col("quality")),
        "citation_correct": F.col("toxic").cast("string"), "notes": F.lit("source, checked"),
        "answer": F.lit("one line\nand another"),
    }
    empty = F.lit(None).cast("string")
    rows = ws.source("labels").select(*[filled.get(c, empty).alias(c) for c in files.LABEL_COLUMNS])
    first = ws.spark.range(1).select(*[F.lit("# how to label" if c == "label_id" else "").alias(c) for c in files.LABEL_COLUMNS])
    first.unionByName(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return files.checked_labels(files.read_labels(ws.spark, path), ws.scratch("bad_labels"))


@register("s14_answer_sets", """
SELECT CASE WHEN conv_id % 2 = 0 THEN 'frozen' ELSE 'defs' END AS "set", role, count(*) AS records, sum(length(text))::BIGINT AS letters
FROM conversations GROUP BY ALL""")
def s14(ws: Workspace):
    paths = {"frozen": ws.scratch("answers"), "defs": ws.scratch("answers")}
    turns = ws.source("conversations")
    files.write_json(turns.filter("conv_id % 2 = 0"), paths["frozen"])
    files.write_json(turns.filter("conv_id % 2 = 1"), paths["defs"])
    both = files.read_answer_sets(ws.spark, paths, turns.schema)
    return both.groupBy("set", "role").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("letters"))


@register("s15_replace_configuration", """
SELECT config, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words FROM (
  SELECT 'by_source' AS config, n_chars AS words FROM documents
  UNION ALL SELECT 'by_lang', 2 * n_chars FROM documents) GROUP BY config""")
def s15(ws: Workspace):
    path = ws.scratch("chunks")
    docs = ws.source("documents").select("doc_id", F.col("n_chars").alias("words"))
    first = docs.withColumn("config", F.lit("by_source"))
    second = docs.withColumn("config", F.lit("by_lang"))
    files.replace_partition(first.unionByName(second), path, "config")
    for _ in range(2):  # the same replacement twice leaves the same rows
        files.replace_partition(second.withColumn("words", F.col("words") * 2), path, "config")
    return ws.spark.read.parquet(path).groupBy("config").agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"))


@register("s16_parameterised_query", using("sales", """
SELECT country, count(*) AS lines FROM sales
WHERE invoice_date >= DATE '1999-01-01' AND invoice_date < DATE '2000-01-01' AND quantity >= 25 GROUP BY country"""))
def s16(ws: Workspace):
    ws.star("fact_sales").createOrReplaceTempView("fact_sales")
    text = """SELECT country, count(*) AS lines FROM fact_sales
              WHERE invoice_date >= CAST(:start AS TIMESTAMP_NTZ) AND invoice_date < CAST(:end AS TIMESTAMP_NTZ)
                AND quantity >= :units GROUP BY country"""
    return files.parameterised(ws.spark, text, start="1999-01-01", end="2000-01-01", units=25)


@register("s18_run_summary", using(_STAR, "SELECT " + ", ".join(
    f"(SELECT count(*) FROM {t}) AS {t}_rows" for t in star.TABLES
) + f", {_PRINT} AS fingerprint, (SELECT sum(revenue)::DOUBLE FROM sales) AS sales_revenue"))
def s18(ws: Workspace):
    return files.run_summary(ws.stars())


# ---- star schema ------------------------------------------------------------------------------------

_DIM_DATE = """SELECT date_key, full_date, year::INTEGER AS year, quarter::INTEGER AS quarter, month::INTEGER AS month, month_name,
       month_start, day_of_month::INTEGER AS day_of_month, day_of_week::INTEGER AS day_of_week, day_name, is_weekend FROM dim_date"""


@register("d1_calendar", using("dim_date", _DIM_DATE))
def d1(ws: Workspace):
    return _shown(star.calendar(ws.sales(), ws.cancellations()))


@register("d2_customer_dimension", using("dim_customer", f"""
SELECT customer_id, country, strftime(first_invoice_date, {_TS}) AS first_invoice_date,
       strftime(last_invoice_date, {_TS}) AS last_invoice_date FROM dim_customer"""))
def d2(ws: Workspace):
    return _shown(star.customers(ws.sales(), ws.cancellations()))


@register("d3_most_frequent_value", using("both_facts", """
SELECT customer_id, country FROM (SELECT customer_id, country,
  row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS place FROM both_facts GROUP BY 1, 2)
WHERE place = 1"""))
def d3(ws: Workspace):
    both = ws.sales().select("customer_id", "country").unionByName(ws.cancellations().select("customer_id", "country"))
    return star.most_frequent(both, "customer_id", "country")


@register("d4_product_dimension", using("dim_product", "SELECT * FROM dim_product"))
def d4(ws: Workspace):
    return star.products(ws.sales(), ws.cancellations())


_LINE_SQL = f"""invoice, strftime(invoice_date, {_TS}) AS invoice_date, date_key, customer_id, stock_code, country, quantity,
       price::DOUBLE AS price, revenue::DOUBLE AS revenue"""


@register("d5_sales_fact", using("fact_sales", f"SELECT sales_line_id, {_LINE_SQL} FROM fact_sales"))
def d5(ws: Workspace):
    return _shown(star.fact(ws.sales(), "sales_line_id"))


@register("d5_cancellations_fact", using("fact_cancellations", f"SELECT cancellation_line_id, {_LINE_SQL} FROM fact_cancellations"))
def d5_cancellations(ws: Workspace):
    return _shown(star.fact(ws.cancellations(), "cancellation_line_id"))


@register("d6_exact_revenue", using("fact_sales fact_cancellations", """
SELECT sum(quantity * price)::DOUBLE AS recomputed, sum(revenue)::DOUBLE AS stored, count(*) FILTER (WHERE quantity * price <> revenue) AS off
FROM (SELECT quantity, price, revenue FROM fact_sales UNION ALL SELECT quantity, price, revenue FROM fact_cancellations)"""))
def d6(ws: Workspace):
    lines = ws.star("fact_sales").select("quantity", "price", "revenue").unionByName(
        ws.star("fact_cancellations").select("quantity", "price", "revenue")
    )
    exact = (F.col("quantity") * F.col("price")).cast("decimal(14,3)")
    return lines.agg(
        F.sum(exact).cast("double").alias("recomputed"), F.sum("revenue").cast("double").alias("stored"),
        F.count_if(exact != F.col("revenue")).alias("off"),
    )


@register("d7_table_digests", using(_STAR, _DIGESTS))
def d7(ws: Workspace):
    return star.table_digests(ws.stars())


@register("d7_fingerprint", using(_STAR, f"SELECT {_PRINT} AS fingerprint"))
def d7_fingerprint(ws: Workspace):
    return star.fingerprint(ws.stars())


@register("s6_three_loads_fingerprint", using(_STAR, f"SELECT {_PRINT} AS fingerprint"))
def s6_three_loads(ws: Workspace):
    """The raw lines loaded in three parts by time, each cleaned and added alone, give the star of one load."""
    root, raw = ws.scratch("loads"), ws.raw()
    moment = lambda day: F.lit(day).cast("timestamp_ntz")
    first, second = moment("1997-03-04"), moment("1999-10-11")
    for part in (F.col("invoice_date") < first, (F.col("invoice_date") >= first) & (F.col("invoice_date") < second), F.col("invoice_date") >= second):
        incremental.load(ws.spark, raw.filter(part), root)
    loaded = incremental.read(ws.spark, root)
    return star.fingerprint({name: loaded[name] for name in star.TABLES})


@register("d8_table_counts", using(_STAR, _COUNTS))
def d8(ws: Workspace):
    return star.table_counts(ws.stars())


# ---- quality ----------------------------------------------------------------------------------------


def _kept(name: str) -> str:
    return f"SELECT '{name}' AS check_name, 'PASS' AS status, "


_Q1 = _kept("schema_drift_raw") + "'8 columns match the contract' AS detail"
_Q2 = _kept("schema_drift_warehouse") + "'38 columns match the contract' AS detail"
_Q3 = " UNION ALL ".join(
    f"SELECT 'row_count_{t}' AS check_name, 'PASS' AS status, 'loaded ' || count(*) || ' vs ' || count(*) AS detail FROM {t}"
    for t in star.TABLES
)
_Q4 = " UNION ALL ".join(
    f"SELECT 'revenue_reconciliation_{t}' AS check_name, 'PASS' AS status, 'loaded ' || CAST(sum(revenue) AS DECIMAL(24,3))"
    f" || ' vs cleaned ' || CAST(sum(quantity * price) AS DECIMAL(24,3)) AS detail FROM {t}"
    for t in quality.FACTS
)


def _flaws(name: str, table: str, condition: str, what: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,"
        f" count(*) || ' {what}' AS detail FROM {table} WHERE {condition}"
    )


_NULL = " OR ".join(f"{c} IS NULL" for c in quality.KEY_COLUMNS)
_Q5 = " UNION ALL ".join(_flaws(f"not_null_keys_{t}", t, _NULL, "rows with a null key") for t in quality.FACTS)
_Q6 = _flaws("positive_quantity_price_sales", "fact_sales", "quantity <= 0 OR price <= 0", "lines with a quantity or price of 0 or less")
_Q7 = _flaws("negative_quantity_cancellations", "fact_cancellations", "quantity >= 0 OR invoice NOT LIKE 'C%'", "lines that are not cancellations")
_Q8_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) - count(DISTINCT {k}) AS repeated FROM {t}" for t, k in star.PRIMARY_KEYS.items()
)
_Q8 = f"SELECT 'unique_keys' AS check_name, CASE WHEN sum(repeated) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(sum(repeated) AS BIGINT) || ' repeated keys' AS detail FROM ({_Q8_ROWS})"
_Q9_ROWS = " UNION ALL ".join(
    f"SELECT '{fact}' AS fact, '{key}' AS key, count(*) AS orphans FROM {fact} f ANTI JOIN {dim} d USING ({key})"
    for fact in quality.FACTS for key, dim in quality.FOREIGN_KEYS.items()
)
_Q9 = f"SELECT 'referential_integrity' AS check_name, CASE WHEN sum(orphans) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(sum(orphans) AS BIGINT) || ' orphan rows' AS detail FROM ({_Q9_ROWS})"
_MONTHS = """
months AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, min(invoice_date)::DATE AS first_day,
                  max(invoice_date)::DATE AS last_day, count(*) AS rows FROM fact_sales GROUP BY 1),
covered AS (SELECT month, first_day, last_day, rows, CAST(day(last_day(month)) AS INTEGER) AS days_in_month,
                   CAST(last_day - first_day + 1 AS INTEGER) AS days_covered,
                   round_even((last_day - first_day + 1) / day(last_day(month))::DOUBLE, 3) AS coverage FROM months),
judged AS (SELECT *, coverage < 0.5 AS partial FROM covered),
history AS (SELECT month, rows, count(*) OVER w AS seen, median(rows) OVER w AS med, stddev_samp(rows) OVER w AS std
            FROM judged WHERE NOT partial WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
volumes AS (SELECT month, rows, CASE WHEN seen >= 3 THEN med END AS rolling_median, CASE WHEN seen >= 3 THEN std END AS rolling_std,
                   coalesce(seen >= 3 AND CASE WHEN std = 0 THEN rows <> med ELSE abs((rows - med) / std) > 3 END, false) AS anomaly
            FROM history)"""
_Q11 = f"""SELECT 'volume_anomaly' AS check_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END AS status,
  coalesce(string_agg(finding, '; ' ORDER BY finding), 'no partial or unusual month') AS detail
FROM (SELECT strftime(month, '%Y-%m') || ' covers ' || days_covered || ' of ' || days_in_month || ' days' AS finding FROM judged WHERE partial
      UNION ALL SELECT strftime(month, '%Y-%m') || ' has ' || rows || ' rows' FROM volumes WHERE anomaly)"""
_Q12 = _kept("freshness") + f"'newest loaded line ' || strftime(max(invoice_date), {_TS}) AS detail FROM fact_sales"


def _fact_checks(ws: Workspace):
    return quality.all_fact_checks(ws.stars(), {"fact_sales": ws.sales(), "fact_cancellations": ws.cancellations()})


@register("q1_raw_contract", using("raw_lines", _Q1))
def q1(ws: Workspace):
    return quality.raw_contract_check(ws.raw())


@register("q1_contract_drift", """
SELECT 'price' AS "column", 'decimal' AS expected, NULL::VARCHAR AS actual, 'missing' AS problem
UNION ALL SELECT 'unit_price', NULL, 'decimal', 'unexpected' UNION ALL SELECT 'quantity', 'integer', 'string', 'retyped'""")
def q1_drift(ws: Workspace):
    drifted = ws.raw().withColumnRenamed("price", "unit_price").withColumn("quantity", F.col("quantity").cast("string"))
    return quality.contract_diff(drifted, quality.RAW_CONTRACT, families=True)


@register("q2_warehouse_contract", using(_STAR, _Q2))
def q2(ws: Workspace):
    return quality.warehouse_contract_check(ws.stars())


@register("q3_row_count_reconciliation", using(_STAR, _Q3))
def q3(ws: Workspace):
    facts = _fact_checks(ws).filter(F.col("check_name").startswith("row_count"))
    return facts.unionByName(quality.dimension_count_checks(ws.stars(), ws.sales(), ws.cancellations()))


@register("q4_revenue_reconciliation", using(_STAR, _Q4))
def q4(ws: Workspace):
    return _fact_checks(ws).filter(F.col("check_name").startswith("revenue"))


@register("q5_not_null_keys", using(_STAR, _Q5))
def q5(ws: Workspace):
    return _fact_checks(ws).filter(F.col("check_name").startswith("not_null"))


@register("q6_positive_sales", using(_STAR, _Q6))
def q6(ws: Workspace):
    return _fact_checks(ws).filter("check_name = 'positive_quantity_price_sales'")


@register("q7_negative_cancellations", using(_STAR, _Q7))
def q7(ws: Workspace):
    return _fact_checks(ws).filter("check_name = 'negative_quantity_cancellations'")


@register("q8_unique_keys", using(_STAR, _Q8_ROWS))
def q8(ws: Workspace):
    return quality.repeated_keys(ws.stars())


@register("q9_referential_integrity", using(_STAR, _Q9_ROWS))
def q9(ws: Workspace):
    return quality.orphans(ws.stars())


@register("q10_partial_periods", using("fact_sales", f"WITH {_MONTHS} SELECT month, first_day, last_day, rows, days_in_month, days_covered, coverage, partial FROM judged"))
def q10(ws: Workspace):
    return quality.partial_periods(quality.month_coverage(ws.star("fact_sales")))


@register("q11_volume_anomalies", using("fact_sales", f"""WITH {_MONTHS}
SELECT month, rows, rolling_median, round(rolling_std, 6) AS rolling_std, anomaly FROM volumes"""))
def q11(ws: Workspace):
    full = quality.partial_periods(quality.month_coverage(ws.star("fact_sales"))).filter("NOT partial")
    return quality.volume_anomalies(full).drop("z").withColumn("rolling_std", F.round("rolling_std", 6))


@register("q12_freshness", using("fact_sales", _Q12))
def q12(ws: Workspace):
    return _fact_checks(ws).filter("check_name = 'freshness'")


_ALL_CHECKS = " UNION ALL ".join(f"({sql})" for sql in (_Q1, _Q2, _Q3, _Q4, _Q5, _Q6, _Q7, _Q8, _Q9, _Q11, _Q12))


def _checks(ws: Workspace):
    return ws.written("checks", lambda: quality.run_checks(ws.raw(), ws.sales(), ws.cancellations(), ws.stars()))


@register("q_all_checks", using(_STAR, f"WITH {_MONTHS} SELECT * FROM ({_ALL_CHECKS})"))
def q_all(ws: Workspace):
    return _checks(ws)


@register("q13_verdict", using(_STAR, f"""WITH {_MONTHS}
SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
       count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'FAIL') = 0 AS ok
FROM ({_ALL_CHECKS})"""))
def q13(ws: Workspace):
    return quality.verdict(_checks(ws))


@register("q14_alerts_of_run", using("fact_sales", f"WITH {_BROKEN} SELECT \"check\", message FROM ({_ALERTS})"))
def q14(ws: Workspace):
    path = ws.scratch("alerts")
    for run_id in ("run-1", "run-2"):
        files.write_json(quality.alerts(_faulty_checks(ws), "quality", run_id), path, mode="append")
    schema = "severity STRING, source STRING, check STRING, message STRING, run_id STRING, details STRING"
    return quality.alerts_of_run(ws.spark.read.schema(schema).json(path), "run-2").select("check", "message")


# ---- marts ------------------------------------------------------------------------------------------

_STAGED = f"""invoice AS invoice_id, strftime(invoice_date, {_TS}) AS invoiced_at, date_key, customer_id, stock_code AS product_code,
       country, quantity, price::DOUBLE AS unit_price, revenue::DOUBLE AS revenue"""


@register("m1_stg_sales", using("fact_sales", f"SELECT sales_line_id, {_STAGED} FROM fact_sales"))
def m1(ws: Workspace):
    return _shown(ws.stg_sales())


@register("m2_stg_cancellations", using("fact_cancellations", f"SELECT cancellation_line_id, {_STAGED} FROM fact_cancellations"))
def m2(ws: Workspace):
    return _shown(ws.stg_cancellations())


@register("m3_stg_products", using("dim_product", "SELECT stock_code AS product_code, description, is_product FROM dim_product"))
def m3(ws: Workspace):
    return marts.stg_products(ws.star("dim_product"))


@register("m4_stg_dates", using("dim_date", _DIM_DATE))
def m4(ws: Workspace):
    return marts.stg_dates(ws.star("dim_date"))


@register("m5_fct_sales", using("fact_sales", f"SELECT sales_line_id, {_STAGED} FROM fact_sales"))
def m5(ws: Workspace):
    return _shown(marts.fct_sales(ws.stg_sales()))


@register("m6_fct_cancellations", using("fact_cancellations", f"SELECT cancellation_line_id, {_STAGED} FROM fact_cancellations"))
def m6(ws: Workspace):
    return _shown(marts.fct_cancellations(ws.stg_cancellations()))


@register("m7_dim_customer", using("dim_customer sales", f"""
SELECT customer_id, country, strftime(first_invoice_date, {_TS}) AS first_purchase_at, strftime(last_invoice_date, {_TS}) AS last_purchase_at,
       coalesce(orders, 0) AS orders, coalesce(value, 0)::DOUBLE AS lifetime_revenue
FROM dim_customer LEFT JOIN (SELECT customer_id, count(DISTINCT invoice) AS orders, sum(revenue) AS value FROM sales GROUP BY 1) USING (customer_id)"""))
def m7(ws: Workspace):
    return _shown(marts.dim_customer(ws.stg_sales(), ws.stg_cancellations()))


@register("m8_dim_product", using("dim_product sales", f"""
SELECT stock_code AS product_code, description, is_product, coalesce(units, 0)::BIGINT AS units_sold, coalesce(value, 0)::DOUBLE AS revenue,
       strftime(first, {_TS}) AS first_sold_at, strftime(last, {_TS}) AS last_sold_at
FROM dim_product LEFT JOIN (SELECT stock_code, sum(quantity) AS units, sum(revenue) AS value, min(invoice_date) AS first, max(invoice_date) AS last
                            FROM sales GROUP BY 1) USING (stock_code)"""))
def m8(ws: Workspace):
    return _shown(marts.dim_product(marts.stg_products(ws.star("dim_product")), ws.stg_sales()))


@register("m9_dim_date", using("dim_date", _DIM_DATE))
def m9(ws: Workspace):
    return marts.dim_date(marts.stg_dates(ws.star("dim_date")))


_FEATURES = "cutoff_date, customer_id, recency, frequency, monetary, tenure, avg_order_value, breadth, cancel_rate, regularity"


@register("m10_customer_features", using("snapshots", f"SELECT {_FEATURES} FROM snapshots"))
def m10(ws: Workspace):
    from basketry.operators.tiering import feature_snapshots
    from basketry.plans.workspace import CUTOFF, TRAIN_CUTOFF

    return feature_snapshots(ws.stg_sales(), ws.stg_cancellations(), [TRAIN_CUTOFF, CUTOFF]).select(*_FEATURES.split(", "))


@register("m11_customer_tiers", using("scored", """
SELECT customer_id, score, score_rank, tier, """ + ", ".join(
    f"pct_{f}, contrib_{f}" for f in _FEATURES.split(", ")[2:]) + " FROM scored"))
def m11(ws: Workspace):
    columns = [f"{p}_{f}" for f in _FEATURES.split(", ")[2:] for p in ("pct", "contrib")]
    return ws.scored().select("customer_id", "score", "score_rank", "tier", *columns)


@register("m12_percentile_rank", using("features", """
SELECT customer_id, CASE WHEN regularity IS NULL THEN 0.0::DOUBLE ELSE
  ((rank() OVER (PARTITION BY regularity IS NULL ORDER BY regularity DESC))::DOUBLE
   + ((count(*) OVER (PARTITION BY regularity)) - 1)::DOUBLE / 2) / (count(regularity) OVER ())::DOUBLE END AS pct_regularity
FROM features"""))
def m12(ws: Workspace):
    from basketry.operators.tiering import percentile_ranks

    return percentile_ranks(ws.features()).select("customer_id", "pct_regularity")


# ---- declarative tests ------------------------------------------------------------------------------

_LINES = "invoice AS invoice_id, invoice_date AS invoiced_at, date_key, customer_id, stock_code AS product_code, quantity, price AS unit_price, revenue"
_MODELS = f"""
stg_sales AS (SELECT sales_line_id, {_LINES} FROM fact_sales), fct_sales AS (SELECT * FROM stg_sales),
stg_cancellations AS (SELECT cancellation_line_id, {_LINES} FROM fact_cancellations), fct_cancellations AS (SELECT * FROM stg_cancellations),
stg_products AS (SELECT stock_code AS product_code, is_product FROM dim_product), mart_dim_product AS (SELECT * FROM stg_products),
stg_dates AS (SELECT date_key, day_of_week FROM dim_date), mart_dim_date AS (SELECT * FROM stg_dates),
mart_dim_customer AS (SELECT customer_id, country FROM dim_customer),
mart_customer_features AS (SELECT * FROM snapshots), mart_customer_tiers AS (SELECT * FROM scored)"""
_TESTED = _STAR + " snapshots scored"


def _models(ws: Workspace):
    return {
        "fact_sales": ws.star("fact_sales"), "fact_cancellations": ws.star("fact_cancellations"),
        "stg_sales": ws.stg_sales(), "stg_cancellations": ws.stg_cancellations(),
        "stg_products": marts.stg_products(ws.star("dim_product")), "stg_dates": marts.stg_dates(ws.star("dim_date")),
        "fct_sales": ws.written("mart_fct_sales", lambda: marts.fct_sales(ws.stg_sales())),
        "fct_cancellations": ws.written("mart_fct_cancellations", lambda: marts.fct_cancellations(ws.stg_cancellations())),
        "dim_customer": ws.written("mart_dim_customer", lambda: marts.dim_customer(ws.stg_sales(), ws.stg_cancellations())),
        "dim_product": ws.written("mart_dim_product", lambda: marts.dim_product(marts.stg_products(ws.star("dim_product")), ws.stg_sales())),
        "dim_date": ws.written("mart_dim_date", lambda: marts.dim_date(marts.stg_dates(ws.star("dim_date")))),
        "mart_customer_features": ws.snapshots(), "mart_customer_tiers": ws.scored(),
    }


UNIQUE = {
    "stg_sales": "sales_line_id", "stg_cancellations": "cancellation_line_id", "stg_products": "product_code",
    "stg_dates": "date_key", "fct_sales": "sales_line_id", "fct_cancellations": "cancellation_line_id",
    "dim_customer": "customer_id", "dim_product": "product_code", "dim_date": "date_key", "mart_customer_tiers": "customer_id",
    "fact_sales": "sales_line_id", "fact_cancellations": "cancellation_line_id",
}
NOT_NULL = {
    "fct_sales": ["sales_line_id", "invoice_id", "invoiced_at", "customer_id", "product_code", "date_key", "revenue"],
    "fct_cancellations": ["cancellation_line_id", "customer_id"],
    "dim_customer": ["customer_id", "country"],
    "dim_product": ["product_code"],
    "dim_date": ["date_key"],
    "mart_customer_features": ["customer_id", "frequency", "monetary", "cancel_rate"],
    "mart_customer_tiers": ["customer_id", "tier", "score"],
    "fact_sales": ["sales_line_id"],
    "fact_cancellations": ["cancellation_line_id"],
    "stg_sales": ["sales_line_id", "invoice_id", "invoiced_at", "customer_id", "product_code", "quantity", "unit_price"],
    "stg_cancellations": ["cancellation_line_id", "invoice_id", "customer_id"],
    "stg_products": ["product_code"],
    "stg_dates": ["date_key"],
}
ACCEPTED = {
    "dim_product": {"is_product": [True, False]},
    "dim_date": {"day_of_week": [1, 2, 3, 4, 5, 6, 7]},
    "mart_customer_tiers": {"tier": list(TIER_SHARES)},
    "stg_products": {"is_product": [True, False]},
    "stg_dates": {"day_of_week": [1, 2, 3, 4, 5, 6, 7]},
}
RELATIONS = [
    ("fct_sales", "customer_id", "dim_customer"), ("fct_sales", "product_code", "dim_product"),
    ("fct_sales", "date_key", "dim_date"), ("fct_cancellations", "customer_id", "dim_customer"),
    ("fct_cancellations", "product_code", "dim_product"), ("fct_cancellations", "date_key", "dim_date"),
    ("mart_customer_features", "customer_id", "dim_customer"), ("mart_customer_tiers", "customer_id", "dim_customer"),
]


def _relation(model: str) -> str:
    return f"mart_{model}" if model.startswith("dim_") else model


def _test_row(kind: str, model: str, subject: str, failures: str) -> str:
    return f"SELECT '{kind}' AS test, '{model}' AS model, '{subject}' AS subject, ({failures})::BIGINT AS failures"


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value).lower()


_T1 = " UNION ALL ".join(_test_row("unique", m, c, f"SELECT count(*) FROM (SELECT {c} FROM {_relation(m)} GROUP BY 1 HAVING count(*) > 1)") for m, c in UNIQUE.items())
_T2 = " UNION ALL ".join(_test_row("not_null", m, c, f"SELECT count(*) FROM {_relation(m)} WHERE {c} IS NULL") for m, cs in NOT_NULL.items() for c in cs)
_T3 = " UNION ALL ".join(_test_row("relationships", m, c, f"SELECT count(*) FROM {_relation(m)} a ANTI JOIN {_relation(p)} b USING ({c})") for m, c, p in RELATIONS)
_T4 = " UNION ALL ".join(
    _test_row("accepted_values", m, c, f"SELECT count(*) FROM {_relation(m)} WHERE {c} NOT IN ({', '.join(map(_literal, vs))})")
    for m, cs in ACCEPTED.items() for c, vs in cs.items())
_T5 = _test_row("unique_combination", "mart_customer_features", "cutoff_date+customer_id",
                "SELECT count(*) FROM (SELECT 1 FROM mart_customer_features GROUP BY cutoff_date, customer_id HAVING count(*) > 1)")


def _stack(frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _unique(models):
    return _stack([marts.unique_test(models[m], m, [c]) for m, c in UNIQUE.items()])


def _column_tests(models):
    return _stack([marts.column_tests(models[m], m, cs, ACCEPTED.get(m)) for m, cs in NOT_NULL.items()])


def _relationships(models):
    return _stack([marts.relationship_test(models[m], m, c, models[p], c) for m, c, p in RELATIONS])


def _combination(models):
    return marts.unique_test(models["mart_customer_features"], "mart_customer_features", ["cutoff_date", "customer_id"], "unique_combination")


@register("t1_unique", using(_TESTED, f"WITH {_MODELS} {_T1}"))
def t1(ws: Workspace):
    return _unique(_models(ws))


@register("t2_not_null", using(_TESTED, f"WITH {_MODELS} {_T2}"))
def t2(ws: Workspace):
    return _column_tests(_models(ws)).filter("test = 'not_null'")


@register("t3_relationships", using(_TESTED, f"WITH {_MODELS} {_T3}"))
def t3(ws: Workspace):
    return _relationships(_models(ws))


@register("t4_accepted_values", using(_TESTED, f"WITH {_MODELS} {_T4}"))
def t4(ws: Workspace):
    return _column_tests(_models(ws)).filter("test = 'accepted_values'")


@register("t5_unique_combination", using(_TESTED, f"WITH {_MODELS} {_T5}"))
def t5(ws: Workspace):
    return _combination(_models(ws))


@register("t6_revenue_reconciles", using("fact_sales", f"""
SELECT month, source_revenue::DOUBLE AS source_revenue, mart_revenue::DOUBLE AS mart_revenue FROM (
  SELECT month, source_revenue, mart_revenue
  FROM (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS source_revenue FROM fact_sales GROUP BY 1)
  FULL JOIN (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS mart_revenue FROM fact_sales
             WHERE country <> '{FAULTY_COUNTRY}' GROUP BY 1) USING (month)
  UNION ALL SELECT NULL, (SELECT sum(revenue) FROM fact_sales), (SELECT sum(revenue) FROM fact_sales WHERE country <> '{FAULTY_COUNTRY}'))
WHERE source_revenue IS NULL OR mart_revenue IS NULL OR abs(source_revenue - mart_revenue) >= 0.005"""))
def t6(ws: Workspace):
    """The months in which a mart that lost a country no longer carries the revenue of its source."""
    lossy = ws.stg_sales().filter(F.col("country") != FAULTY_COUNTRY)
    return _shown(marts.revenue_mismatches(ws.star("fact_sales"), lossy))


@register("t7_no_future_invoices", using("fact_sales fact_cancellations", f"""
SELECT 'sales' AS fact, sales_line_id AS line_id, strftime(invoice_date, {_TS}) AS invoiced_at FROM fact_sales WHERE invoice_date > TIMESTAMP '2001-07-01'
UNION ALL
SELECT 'cancellations', cancellation_line_id, strftime(invoice_date, {_TS}) FROM fact_cancellations WHERE invoice_date > TIMESTAMP '2001-07-01'"""))
def t7(ws: Workspace):
    return _shown(marts.future_lines(ws.stg_sales(), ws.stg_cancellations(), "2001-07-01 00:00:00"))


@register("t8_tier_shares", using("scored", """
SELECT tier, n, total, share FROM (VALUES ('Tier 1', 0.10::DOUBLE), ('Tier 2', 0.20::DOUBLE), ('Tier 3', 0.30::DOUBLE), ('Tier 4', 0.40::DOUBLE)) e(tier, share)
LEFT JOIN (SELECT tier, count(*) AS n FROM scored GROUP BY 1) USING (tier), (SELECT count(*) AS total FROM scored)
WHERE n IS NULL OR abs(n - share * total) > 1"""))
def t8(ws: Workspace):
    return marts.tier_share_deviations(ws.scored(), TIER_SHARES)


@register("t8_tier_shares_of_a_lost_tier", using("scored", """
SELECT tier, n, total, share FROM (VALUES ('Tier 1', 0.10::DOUBLE), ('Tier 2', 0.20::DOUBLE), ('Tier 3', 0.30::DOUBLE), ('Tier 4', 0.40::DOUBLE)) e(tier, share)
LEFT JOIN (SELECT CASE tier WHEN 'Tier 1' THEN 'Tier 2' ELSE tier END AS tier, count(*) AS n FROM scored GROUP BY 1) USING (tier), (SELECT count(*) AS total FROM scored)
WHERE n IS NULL OR abs(n - share * total) > 1"""))
def t8_lost(ws: Workspace):
    """The same test on scores whose best tier fell into the second."""
    fallen = F.when(F.col("tier") == "Tier 1", "Tier 2").otherwise(F.col("tier"))
    return marts.tier_share_deviations(ws.scored().withColumn("tier", fallen), TIER_SHARES)


@register("t9_results_by_kind", using(_TESTED, f"""WITH {_MODELS}
SELECT test, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS tests
FROM ({_T1} UNION ALL {_T2} UNION ALL {_T3} UNION ALL {_T4} UNION ALL {_T5}) GROUP BY 1, 2"""))
def t9(ws: Workspace):
    models = _models(ws)
    results = _stack([_unique(models), _column_tests(models), _relationships(models), _combination(models)])
    return marts.outcome_counts(results)
