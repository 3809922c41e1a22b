"""Registered serving tables and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.single import beside
from basketry.functions.text import normalised
from basketry.operators import cleaning, quality, serving, validation
from basketry.operators.star import table_counts
from basketry.operators.tiering import FEATURES
from basketry.plans import analysis
from basketry.plans.oracle import using
from basketry.plans.register_customers import HAND, _METHODS, _TIERS, _methods, _tier_table, all_methods
from basketry.plans.register_grading import _RECORDS, records, result_records, result_sets
from basketry.plans.registry import register
from basketry.plans.workspace import CUTOFF, Workspace
from basketry.sources import versions

_SCORE_COLUMNS = ["customer_id", *FEATURES, *[f"contrib_{f}" for f in FEATURES], "score", "tier", "rank", "country", "future_revenue"]


@register("l1_customer_scores", using("scored_outcome dim_customer", f"""
SELECT customer_id, {', '.join(f'{f}::DOUBLE AS {f}' for f in FEATURES)}, {', '.join(f'contrib_{f}' for f in FEATURES)}, score, tier,
       rank() OVER (ORDER BY score DESC) AS rank, country, future_revenue::DOUBLE AS future_revenue
FROM scored_outcome LEFT JOIN dim_customer USING (customer_id)"""))
def l1(ws: Workspace):
    found = serving.customer_scores(ws.scored_outcome(), ws.star("dim_customer"))
    return found.withColumn("future_revenue", F.col("future_revenue").cast("double")).select(*_SCORE_COLUMNS)


def _lorenz(ws: Workspace):
    return ws.written("lorenz", lambda: analysis.lorenz_curve(ws.star("fact_sales")))


@register("l2_thinned_lorenz", using("sales", """
SELECT place, 100.0::DOUBLE * place::DOUBLE / n AS customer_pct, 100.0::DOUBLE * so_far::DOUBLE / total::DOUBLE AS cum_revenue_pct
FROM (SELECT count(*) OVER () AS n, sum(revenue) OVER () AS total, row_number() OVER (ORDER BY revenue DESC, customer_id) AS place,
             sum(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) AS so_far
      FROM (SELECT customer_id, sum(revenue) AS revenue FROM sales GROUP BY 1))
WHERE (place - 1) % greatest(1, n // 200) = 0 OR place = n"""))
def l2(ws: Workspace):
    return serving.thinned(_lorenz(ws))


# The keys of the indicator table and their labels.
KPI_LABELS = {
    "raw_rows": "Raw rows",
    "clean_rows": "Sales lines after cleaning",
    "customers": "Customers",
    "revenue": "Revenue",
    "top10_share_pct": "Revenue from top 10% of customers (%)",
    "quality_pass": "Quality checks passing",
    "quality_warn": "Quality checks warning",
    "quality_fail": "Quality checks failing",
    "confidently_wrong": "Confidently wrong answers",
}


def _kpis(ws: Workspace):
    summary = cleaning.cleaning_summary(ws.raw(), ws.sales()).select(
        "raw_rows", "clean_rows", "customers", F.col("revenue").cast("decimal(24,2)").alias("revenue")
    )
    top = analysis.revenue_concentration(ws.star("fact_sales"), {"top10_share_pct": 0.1}).select("top10_share_pct")
    checks = ws.written("checks", lambda: quality.run_checks(ws.raw(), ws.sales(), ws.cancellations(), ws.stars()))
    judged = quality.verdict(checks).select(
        F.col("passed").alias("quality_pass"), F.col("warned").alias("quality_warn"), F.col("failed").alias("quality_fail")
    )
    wrong = records(ws).agg(F.concat_ws(
        "/", F.count_if(F.col("outcome").isin("wrong", "answered_unanswerable")).cast("string"), F.count(F.lit(1)).cast("string")
    ).alias("confidently_wrong"))
    return serving.key_values(beside(beside(beside(summary, top), judged), wrong), KPI_LABELS)


@register("l3_kpis", using("raw_lines sales", f"""
WITH {_RECORDS}, k AS (
SELECT (SELECT count(*) FROM raw_lines) AS raw_rows, count(*) AS clean_rows, count(DISTINCT customer_id) AS customers,
       CAST(round(sum(revenue), 2) AS DECIMAL(24,2)) AS revenue,
       (SELECT half_even(100.0::DOUBLE * (sum(r) FILTER (WHERE p <= ceil(0.1::DOUBLE * n)))::DOUBLE / sum(r)::DOUBLE, 2)
        FROM (SELECT r, row_number() OVER (ORDER BY r DESC, customer_id) AS p, count(*) OVER () AS n
              FROM (SELECT customer_id, sum(revenue) AS r FROM sales GROUP BY 1))) AS top10,
       (SELECT count(*) FILTER (WHERE outcome IN ('wrong', 'answered_unanswerable')) || '/' || count(*) FROM records) AS cw
FROM sales)
SELECT unnest(['raw_rows', 'clean_rows', 'customers', 'revenue', 'top10_share_pct', 'quality_pass', 'quality_warn', 'quality_fail', 'confidently_wrong']) AS key,
       unnest([raw_rows::VARCHAR, clean_rows::VARCHAR, customers::VARCHAR, revenue::VARCHAR, top10::VARCHAR, '16', '1', '0', cw]) AS value,
       unnest([{', '.join(f"'{v}'" for v in KPI_LABELS.values())}]) AS label
FROM k"""))
def l3(ws: Workspace):
    return _kpis(ws)




def _answers(ws: Workspace):
    """Recorded answers about orders, with the order's lines (twenty at a time) as the result."""
    sets = result_sets(ws).select("id", "order_key", F.transform("rows", lambda x: F.array(x["part"], x["units"].cast("string"))).alias("found"))
    key = F.col("o_orderkey")
    return ws.source("orders").join(sets, key == F.col("order_key"), "left").select(
        F.coalesce("id", F.concat(key, F.lit("-0"))).alias("id"), key.alias("order_key"), (key % 2).cast("int").alias("run"),
        F.concat(F.lit("What is on order #"), F.coalesce("id", F.concat(key, F.lit("-0"))), F.lit("?")).alias("question"),
        F.col("o_orderpriority").alias("difficulty"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
        F.concat(F.lit("v"), key % 5).alias("version"),
        (F.col("o_orderstatus") == "P").alias("abstained"), F.when(key % 11 == 0, "timeout").alias("error"),
        F.coalesce("found", F.array().cast("array<array<string>>")).alias("result"),
    )


_SETS = """(SELECT o.*, coalesce(s.id, o_orderkey || '-0') AS id, n, part, units
  FROM orders o LEFT JOIN (SELECT l_orderkey || '-' || at0 // 20 AS id, l_orderkey, count(*) AS n, any_value('P' || l_partkey) AS part, any_value(CAST(l_quantity AS INTEGER)) AS units
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'P' || l_partkey, CAST(l_quantity AS INTEGER), l_shipdate::DATE) - 1 AS at0 FROM lineitem)
    GROUP BY l_orderkey, at0 // 20) s ON l_orderkey = o_orderkey)"""


@register("l4_graded_answers", f"""
SELECT id, CAST(coalesce(n, 0) AS INTEGER) AS row_count, toxic AS faithful, coalesce(n, 0) AS shown, n AS reference_shown, cells AS reference_cells
FROM {_SETS} LEFT JOIN labels ON doc_id = o_orderkey
LEFT JOIN (SELECT l_orderkey || '-' || at0 // 20 AS set_id, md5(string_agg(part || ',' || units || ',' || day, ';' ORDER BY at0)) AS cells FROM (
  SELECT l_orderkey, 'P' || l_partkey AS part, CAST(l_quantity AS INTEGER) AS units, strftime(l_shipdate, '%Y-%m-%d') AS day,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'P' || l_partkey, CAST(l_quantity AS INTEGER), l_shipdate::DATE) - 1 AS at0 FROM lineitem)
  GROUP BY l_orderkey, at0 // 20) refs ON set_id = id
WHERE o_orderkey % 2 = 0""")
def l4(ws: Workspace):
    table = _graded(ws)
    rows = lambda c: F.from_json(c, "array<array<string>>")
    cells = F.md5(F.array_join(F.transform(rows("reference_rows"), lambda r: F.array_join(r, ",")), ";"))
    return table.select(
        "id", "row_count", "faithful", F.size(rows("rows")).cast("bigint").alias("shown"),
        F.when(F.col("reference_rows").isNotNull(), F.size(rows("reference_rows")).cast("bigint")).alias("reference_shown"), cells.alias("reference_cells"),
    )


def _graded(ws: Workspace):
    """First-run answers with the reference of their question and the judge's verdict."""
    answers = _answers(ws)
    references = result_records(ws).select("id", "reference")
    flags = ws.source("labels").select(F.col("doc_id").alias("order_key"), F.col("toxic").alias("faithful"))
    verdicts = answers.filter("run = 0").select("id", "run", "order_key").join(flags, "order_key").drop("order_key")
    return serving.graded_answers(answers, references, verdicts)


@register("l5_rendered_results", f"""
SELECT id, CASE WHEN o_orderstatus = 'P' THEN 'No answer is possible here. No such column.'
            WHEN o_orderkey % 11 = 0 THEN 'No answer: the query ended in an error.'
            WHEN n IS NULL THEN 'The result is empty.'
            WHEN n = 1 THEN 'part no: ' || part || '; units sold: ' || units ELSE n || ' rows, shown in the table.' END AS answer
FROM {_SETS}""")
def l5(ws: Workspace):
    columns = F.array(F.lit("part_no"), F.lit("units_sold"))
    said = serving.rendered(columns, F.col("result"), F.col("abstained"), F.lit("No such column."), F.col("error"))
    return _answers(ws).select("id", said.alias("answer"))


@register("l6_normalised_text", """
SELECT conv_id, turn, md5(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g')) AS digest FROM conversations""")
def l6(ws: Workspace):
    return ws.source("conversations").select("conv_id", "turn", F.md5(normalised(F.col("text"))).alias("digest"))


def _asked(ws: Workspace):
    """Requests for answers, typed with other capitals, blanks and punctuation, for one version of each order."""
    key = F.col("o_orderkey")
    return ws.source("orders").select(
        F.concat(F.lit("  what IS on   order "), key, F.lit("-0!!")).alias("question"),
        F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"), F.concat(F.lit("v"), key % 4).alias("version"),
    )


@register("l7_bulk_lookup", """
SELECT '  what IS on   order ' || o_orderkey || '-0!!' AS question, 'm' || (o_custkey % 3) AS model, 'v' || (o_orderkey % 4) AS version,
       CASE WHEN o_orderkey % 4 = o_orderkey % 5 THEN 'order ' || o_orderkey || '-0' END AS answer, o_orderkey % 4 = o_orderkey % 5 AS found
FROM orders""")
def l7(ws: Workspace):
    answers = _answers(ws).withColumn("answer", F.concat(F.lit("order "), F.col("id")))
    return serving.look_up(_asked(ws), answers)


@register("l8_similar_texts", """
WITH names AS (SELECT DISTINCT p_name AS text FROM part)
SELECT text, known, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.text, b.text AS known, -(levenshtein(a.text, b.text)::DOUBLE / greatest(len(a.text), len(b.text), 1) - 1) AS similarity,
         row_number() OVER (PARTITION BY a.text ORDER BY levenshtein(a.text, b.text)::DOUBLE / greatest(len(a.text), len(b.text), 1) - 1, b.text) AS rank
  FROM names a, names b WHERE levenshtein(a.text, b.text)::DOUBLE / greatest(len(a.text), len(b.text), 1) - 1 <= -0.4::DOUBLE)
WHERE rank <= 3""")
def l8(ws: Workspace):
    names = ws.source("part").select(F.col("p_name").alias("text")).distinct()
    return serving.similar_texts(names, names)


@register("l9_outcome_grid", f"""WITH {_RECORDS}
SELECT id, model, {', '.join(f"min(outcome) FILTER (WHERE version = 'v{i}') AS v{i}" for i in range(1, 6))} FROM records WHERE run = 0 GROUP BY 1, 2""")
def l9(ws: Workspace):
    return serving.outcome_grid(records(ws).filter("run = 0"), [f"v{i}" for i in range(1, 6)])


@register("l10_tier_series", using("scored_outcome", f"WITH {_TIERS} SELECT tier, mean, share_pct FROM tier_table"))
def l10(ws: Workspace):
    return _tier_table(ws).select("tier", "mean", "share_pct")


@register("l10_capture_series", using("scored_outcome", f"""WITH {_METHODS}
SELECT point::DOUBLE AS pct_customers, 100.0::DOUBLE * coalesce((SELECT sum(outcome) FROM placed p WHERE p.method = '{HAND}' AND p.place <= floor(point / 100.0::DOUBLE * n + 1e-9)), 0)::DOUBLE / total::DOUBLE AS pct_revenue
FROM (SELECT any_value(n) AS n, any_value(total) AS total, unnest(range(0, 101)) AS point FROM placed WHERE method = '{HAND}')"""))
def l10_capture(ws: Workspace):
    curve = validation.capture_curve(_methods(ws).filter(F.col("method") == HAND))
    return curve.select("pct_customers", "pct_revenue")


@register("l11_question_list", f"SELECT id, o_orderpriority AS difficulty, 'What is on order #' || id || '?' AS question FROM {_SETS}")
def l11(ws: Workspace):
    return serving.question_list(_answers(ws))


@register("l11_available_configurations", f"""
SELECT 'what is on order ' || replace(id, '-', '') AS question_key, 'm' || (o_custkey % 3) AS model, 'v' || (o_orderkey % 5) AS version FROM {_SETS}""")
def l11_available(ws: Workspace):
    return serving.available(_answers(ws))


@register("l12_tier_members", using("scored", "SELECT customer_id, score_rank, score FROM scored WHERE tier = 'Tier 1'"))
def l12(ws: Workspace):
    return serving.tier_members(ws.scored(), "Tier 1").select("customer_id", "score_rank", "score")


def serving_tables(ws: Workspace):
    """The eleven tables of the service, ready to be published together."""
    documents = ws.source("documents").select("doc_id", "source", "lang", "n_chars", "text")
    meta = ws.spark.range(1).select(F.lit(CUTOFF).alias("scoring_cutoff"), F.lit("pre-aggregated data, no raw lines").alias("note"))
    return {
        "monthly": analysis.monthly_revenue(ws.star("fact_sales")),
        "countries": analysis.top_countries(ws.star("fact_sales")),
        "lorenz": serving.thinned(_lorenz(ws)),
        "kpis": _kpis(ws),
        "customer_scores": serving.customer_scores(ws.scored_outcome(), ws.star("dim_customer")),
        "tier_summary": _tier_table(ws),
        "tier_methods": all_methods(ws),
        "quality_checks": ws.written("checks", lambda: quality.run_checks(ws.raw(), ws.sales(), ws.cancellations(), ws.stars())),
        "eval_answers": _graded(ws),
        "knowledge_docs": documents,
        "meta": meta,
    }


@register("s17_serving_export", using("sales scored_outcome", """
SELECT 'monthly' AS table_name, (SELECT count(DISTINCT date_trunc('month', invoice_date)) FROM sales) AS row_count
UNION ALL SELECT 'countries', 10 UNION ALL SELECT 'kpis', 9 UNION ALL SELECT 'tier_summary', 4 UNION ALL SELECT 'tier_methods', 8
UNION ALL SELECT 'quality_checks', 17 UNION ALL SELECT 'meta', 1 UNION ALL SELECT 'eval_answers', (SELECT count(*) FROM (SELECT DISTINCT o_orderkey, coalesce(l_linenumber_block, 0) FROM orders LEFT JOIN
    (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey) - 1) // 20 AS l_linenumber_block FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0))
UNION ALL SELECT 'knowledge_docs', (SELECT count(*) FROM documents) UNION ALL SELECT 'customer_scores', (SELECT count(*) FROM scored_outcome)
UNION ALL SELECT 'lorenz', (SELECT count(*) FROM (SELECT row_number() OVER () AS place, count(*) OVER () AS n FROM (SELECT DISTINCT customer_id FROM sales))
                            WHERE (place - 1) % greatest(1, n // 200) = 0 OR place = n)"""))
def s17(ws: Workspace):
    tables, root = serving_tables(ws), ws.scratch("serving")
    versions.publish(ws.spark, tables, root)
    return table_counts(versions.read_live(ws.spark, root, list(tables)))
