"""Registered grading of recorded answers.

Records come from the event log: ten consecutive events are the five versions x two runs of one question;
type and value stand for how the answer went. Result sets and prose come from the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import claims, grading, matching
from basketry.operators.ranking import group_positions
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace
from basketry.session import spread

# ---- records ----------------------------------------------------------------------------------------

_RECORDS = """
raw_records AS (
  SELECT 'q' || (event_id // 10) AS id, CAST(event_id // 5 % 2 AS INTEGER) AS run, 'v' || (event_id % 5 + 1) AS version,
         'm' || (user_id % 3) AS model,
         ['unanswerable', 'easy', 'medium', 'hard', 'definition'][CAST(event_id // 10 % 5 AS INTEGER) + 1] AS difficulty,
         event_type = 'signup' AS abstained, event_type = 'error' AS failed, value < 12.0 AS matched,
         CAST(1 + (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0)::INTEGER AS INTEGER) AS attempts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS latency_s, value / 10 AS narrate_s, event_type AS purpose
  FROM events),
records AS (
  SELECT *, CASE WHEN difficulty = 'definition' THEN 'defs' ELSE 'frozen' END AS "set",
         CASE WHEN abstained THEN CASE WHEN difficulty <> 'unanswerable' THEN 'abstained' ELSE 'refused' END
              WHEN failed THEN 'error' WHEN difficulty = 'unanswerable' THEN 'answered_unanswerable'
              WHEN matched THEN 'correct' ELSE 'wrong' END AS outcome
  FROM raw_records)"""


def records(ws: Workspace):
    event, levels = F.col("event_id"), ["unanswerable", "easy", "medium", "hard", "definition"]
    question = F.floor(event / 10)
    k = F.get_json_object("props", "$.k").cast("bigint")
    shaped = ws.source("events").select(
        F.concat(F.lit("q"), question).alias("id"),
        (F.floor(event / 5) % 2).cast("int").alias("run"),
        F.concat(F.lit("v"), event % 5 + 1).alias("version"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.element_at(F.array(*[F.lit(x) for x in levels]), (question % 5).cast("int") + 1).alias("difficulty"),
        (F.col("event_type") == "signup").alias("abstained"),
        (F.col("event_type") == "error").alias("failed"),
        (F.col("value") < 12.0).alias("matched"),
        (1 + (k % 3 == 0).cast("int")).alias("attempts"),
        k.alias("k"),
        F.col("value").alias("latency_s"),
        (F.col("value") / 10).alias("narrate_s"),
        F.col("event_type").alias("purpose"),
    )
    graded = grading.outcome(F.col("difficulty") != "unanswerable", F.col("abstained"), F.col("failed"), F.col("matched"))
    return shaped.withColumn("set", F.when(F.col("difficulty") == "definition", "defs").otherwise("frozen")).withColumn(
        "outcome", graded
    )


_ANSWERABLE = "difficulty <> 'unanswerable'"


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return f"half_even(100.0::DOUBLE * count(*) FILTER (WHERE {part}) / nullif(count(*) FILTER (WHERE {whole}), 0), {digits})"


_RATES = f"""count(*) AS questions,
  {_pct(f"{_ANSWERABLE} AND outcome = 'correct'", _ANSWERABLE)} AS execution_accuracy_pct,
  {_pct("difficulty = 'unanswerable' AND outcome = 'refused'", "difficulty = 'unanswerable'")} AS abstention_accuracy_pct,
  {_pct(f"{_ANSWERABLE} AND outcome = 'abstained'", _ANSWERABLE)} AS false_abstention_pct,
  {_pct("outcome IN ('correct', 'refused')", "true")} AS overall_accuracy_pct,
  {_pct("outcome IN ('wrong', 'answered_unanswerable')", "true")} AS confidently_wrong_pct,
  coalesce({_pct("outcome IN ('wrong', 'answered_unanswerable')", "outcome IN ('correct', 'wrong', 'answered_unanswerable')")}, 0.0) AS confidently_wrong_of_answered_pct,
  count(*) FILTER (WHERE attempts > 1) AS retried"""
_LATENCY = """half_even(quantile_cont(latency_s - narrate_s, 0.5), 2) AS latency_p50_s, half_even(quantile_cont(latency_s - narrate_s, 0.95), 2) AS latency_p95_s"""

# ---- result sets ------------------------------------------------------------------------------------

# The lines of an order, twenty at a time, are a reference result (part, quantity, ship date); the recorded
# answer is a variation of it chosen by the order key: 0 reordered columns and rounding noise, 1 an extra
# column, 2 a wrong number, 3 a missing row, 4 quantities paired with the wrong parts, 5 timestamps and
# padded numbers.
SET_SIZE = 20
SETS_PER_TASK = 50_000


def result_sets(ws: Workspace):
    """(id, order_key, rows): order lines in sets of at most twenty, however many lines an order has."""
    def build():
        lines = ws.source("lineitem").select(
            F.col("l_orderkey").alias("order_key"), "l_linenumber", F.concat(F.lit("P"), "l_partkey").alias("part"),
            F.col("l_quantity").cast("int").alias("units"), F.to_date("l_shipdate").alias("day"),
        )
        numbered = group_positions(lines, ["order_key"], ["l_linenumber", "part", "units", "day"], "i")
        sets = numbered.withColumn("block", F.floor((F.col("i") - 1) / SET_SIZE))
        return sets.groupBy("order_key", "block").agg(
            F.array_sort(F.collect_list(F.struct("i", "part", "units", "day"))).alias("rows")  # at most twenty
        ).select(F.concat_ws("-", "order_key", "block").alias("id"), "order_key", "rows")

    return ws.written("result_sets", build)


def result_records(ws: Workspace):
    whole = spread(result_sets(ws), SETS_PER_TASK)
    n, mode = F.size("rows"), F.col("order_key") % 6
    text_of = lambda c: c.cast("string")

    def noisy(row, i):
        return F.array(text_of(row["units"] * F.lit(1.0001)), text_of(row["day"]), row["part"])

    def extra(row, i):
        return F.array(text_of(i + 1), row["part"], text_of(row["units"]), text_of(row["day"]))

    def wrong(row, i):
        return F.array(row["part"], text_of(row["units"] * 2 + 1), text_of(row["day"]))

    def rotated(row, i):
        other = F.get(F.col("rows"), ((i + 1) % n).cast("int"))
        return F.array(row["part"], text_of(other["units"]), text_of(row["day"]))

    def padded(row, i):
        return F.array(row["part"], F.concat(F.lit(" "), text_of(row["units"]), F.lit(".0")), F.concat(text_of(row["day"]), F.lit("T00:00:00")))

    def plain(row, i):
        return F.array(row["part"], text_of(row["units"]), text_of(row["day"]))

    predicted = (
        F.when(mode == 0, F.transform("rows", noisy)).when(mode == 1, F.transform("rows", extra))
        .when(mode == 2, F.transform("rows", wrong))
        .when(mode == 3, F.transform(F.slice("rows", 2, SET_SIZE), plain))
        .when(mode == 4, F.transform("rows", rotated)).otherwise(F.transform("rows", padded))
    )
    return whole.select("id", "order_key", F.transform("rows", plain).alias("reference"), predicted.alias("result"))


_GROUPED = """
placed AS (SELECT l_orderkey AS order_key, 'P' || l_partkey AS part, CAST(l_quantity AS INTEGER) AS units, l_shipdate::DATE AS day,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'P' || l_partkey, CAST(l_quantity AS INTEGER), l_shipdate::DATE) - 1 AS at0
           FROM lineitem),
ordered AS (SELECT order_key || '-' || (at0 // 20) AS id, order_key, part, units, day, at0 % 20 + 1 AS i,
                   count(*) OVER (PARTITION BY order_key, at0 // 20) AS n FROM placed),
turned AS (SELECT a.*, b.units AS other FROM ordered a JOIN ordered b ON b.id = a.id AND b.i = a.i % a.n + 1),
sorted_sets AS (SELECT id, order_key, list_sort(list((part, units, day))) = list_sort(list((part, other, day))) AS still_pairs FROM turned GROUP BY ALL)"""


@register("e1_cell_normalisation", """
SELECT l_orderkey AS id, count(*) AS cells, CAST(sum(l_quantity) AS DOUBLE) AS number_sum,
       min(strftime(l_shipdate, '%Y-%m-%d')) AS first_day, max('p' || l_partkey) AS last_text
FROM lineitem GROUP BY 1""")
def e1(ws: Workspace):
    """Quantities as padded text, midnight timestamps and codes come out as numbers, dates and lower-case text."""
    padded = F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit(" "))
    cells = ws.source("lineitem").select(
        F.col("l_orderkey").alias("id"), matching.cell(padded).alias("units"),
        matching.cell(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("day"),
        matching.cell(F.concat(F.lit("P"), "l_partkey")).alias("part"),
    )
    return cells.groupBy("id").agg(
        F.count("units.number").alias("cells"), F.sum("units.number").alias("number_sum"),
        F.min("day.text").alias("first_day"), F.max("part.text").alias("last_text"),
    )


@register("e2_column_match", f"""WITH {_GROUPED}
SELECT id, CASE order_key % 6 WHEN 2 THEN list_sort(list(units)) = list_sort(list(units * 2 + 1)) WHEN 3 THEN false ELSE true END AS units_match
FROM ordered GROUP BY id, order_key""")
def e2(ws: Workspace):
    """Whether the quantity column of the answer holds the reference's quantities, in any order."""
    mode = F.col("order_key") % 6
    place = F.when(mode == 0, 0).when(mode == 1, 2).otherwise(1)
    wanted = F.transform("reference", lambda row: matching.cell(F.get(row, 1)))
    given = F.transform("result", lambda row: matching.cell(F.get(row, place)))
    return result_records(ws).select("id", matching.columns_match(wanted, given).alias("units_match"))


@register("e3_result_match", f"""WITH {_GROUPED}
SELECT id, CASE WHEN order_key % 6 IN (0, 1, 5) THEN true WHEN order_key % 6 = 4 THEN still_pairs ELSE false END AS matched FROM sorted_sets""")
def e3(ws: Workspace):
    return matching.with_match(result_records(ws), "reference", "result", F.lit(False)).select("id", "matched")


@register("e4_outcomes", f"WITH {_RECORDS} SELECT id, run, version, outcome FROM records")
def e4(ws: Workspace):
    return records(ws).select("id", "run", "version", "outcome")


@register("e5_summary_rates", f"WITH {_RECORDS} SELECT version, {_RATES} FROM records GROUP BY version")
def e5(ws: Workspace):
    return grading.summarise(records(ws), ["version"])


@register("e5_accuracy_by_difficulty", f"""WITH {_RECORDS}
SELECT version, difficulty, count(*) AS questions, {_pct("outcome IN ('correct', 'refused')", "true")} AS right_pct FROM records GROUP BY 1, 2""")
def e5_difficulty(ws: Workspace):
    return grading.accuracy_by(records(ws), ["version", "difficulty"])


@register("e5_outcome_counts", f"WITH {_RECORDS} SELECT version, outcome, count(*) AS n FROM records GROUP BY 1, 2")
def e5_outcomes(ws: Workspace):
    return grading.outcome_counts(records(ws), ["version"])


@register("e6_latency_percentiles", f"WITH {_RECORDS} SELECT version, {_LATENCY} FROM records GROUP BY version")
def e6(ws: Workspace):
    return grading.latency_percentiles(records(ws), ["version"])


@register("e7_failures", f"""WITH {_RECORDS}
SELECT version, id, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ('correct', 'wrong', 'answered_unanswerable', 'abstained', 'refused', 'error'))},
       arg_min(outcome, run) FILTER (WHERE outcome NOT IN ('correct', 'refused')) AS first_failure
FROM records GROUP BY 1, 2 HAVING bool_or(outcome NOT IN ('correct', 'refused'))""")
def e7(ws: Workspace):
    return grading.failures(records(ws), ["version"])


@register("e8_compare_configurations", f"""WITH {_RECORDS}
SELECT model, version, {_RATES}, (SELECT CAST(sum(('0x' || substr(md5(text), 1, 15))::BIGINT) AS VARCHAR) FROM benchmark) AS eval_set_sha
FROM records GROUP BY 1, 2""")
def e8(ws: Workspace):
    digest = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("decimal(20,0)")
    sha = ws.source("benchmark").agg(F.sum(digest).cast("string").alias("s")).scalar()
    return grading.comparable(grading.summarise(records(ws), ["model", "version"]).withColumn("eval_set_sha", sha))


_CONDITIONS = f"""
conditions AS (SELECT *, CASE version WHEN 'v3' THEN 'without_documents' ELSE 'with_documents' END AS condition, unnest(["set", 'all']) AS subset
               FROM records WHERE version IN ('v3', 'v4'))"""


@register("e9_ablation", f"WITH {_RECORDS}, {_CONDITIONS} SELECT condition, subset, run, {_RATES} FROM conditions GROUP BY 1, 2, 3")
def e9(ws: Workspace):
    named = {"v3": "without_documents", "v4": "with_documents"}
    return grading.summarise(grading.by_condition(records(ws), named), ["condition", "subset", "run"])


@register("e10_outcome_changes", f"""WITH {_RECORDS}
SELECT id, run, a.outcome AS outcome_before, b.outcome AS outcome_after
FROM (SELECT * FROM records WHERE version = 'v3') a JOIN (SELECT * FROM records WHERE version = 'v4') b USING (id, run) WHERE a.outcome <> b.outcome""")
def e10(ws: Workspace):
    return grading.outcome_changes(records(ws), "v3", "v4")


# Citations: an answer cites up to three of the four documents it was shown; the question's own is the gold one.
_CITED = f"""
cited AS (SELECT *, doc0 AS gold, CASE k % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [doc0] WHEN 2 THEN [doc0, doc1] ELSE [doc1, doc2, doc9] END AS citations,
                 [doc0 || '#0', doc1 || '#1', doc2 || '#0', doc0 || '#2'] AS retrieved
          FROM (SELECT *, 'd' || (k % 20) AS doc0, 'd' || ((k + 1) % 20) AS doc1, 'd' || ((k + 2) % 20) AS doc2, 'd' || ((k + 9) % 20) AS doc9
                FROM records WHERE version = 'v4')),
old AS (SELECT 'd' || doc_id AS doc_id FROM labels WHERE toxic = 1)"""


def _cited(ws: Workspace):
    doc = lambda shift: F.concat(F.lit("d"), (F.col("k") + shift) % 20)
    choice = F.col("k") % 4
    citations = (
        F.when(choice == 0, F.array().cast("array<string>")).when(choice == 1, F.array(doc(0)))
        .when(choice == 2, F.array(doc(0), doc(1))).otherwise(F.array(doc(1), doc(2), doc(9)))
    )
    shown = F.array(*[F.concat(doc(s), F.lit(f"#{i}")) for s, i in ((0, 0), (1, 1), (2, 0), (0, 2))])
    return records(ws).filter("version = 'v4'").select(
        "id", "run", "set", "outcome", doc(0).alias("gold"), citations.alias("citations"), shown.alias("retrieved")
    )


@register("e11_citation_statistics", f"""WITH {_RECORDS}, {_CITED}
SELECT {_pct("outcome IN ('correct', 'wrong') AND len(citations) > 0", "outcome IN ('correct', 'wrong')", 1)} AS answered_with_citation_pct,
       {_pct('''"set" = 'defs' AND outcome <> 'abstained' AND list_contains(citations, gold)''', '''"set" = 'defs' AND outcome <> 'abstained' ''', 1)} AS defs_cite_gold_doc_pct,
       count(*) FILTER (WHERE len(list_filter(citations, lambda c: NOT list_contains(list_transform(retrieved, lambda r: split_part(r, '#', 1)), c))) > 0) AS cites_unretrieved_doc,
       count(*) FILTER (WHERE list_has_any(citations, (SELECT coalesce(list(doc_id), []) FROM old))) AS cites_deprecated_doc
FROM cited""")
def e11(ws: Workspace):
    old = ws.source("labels").filter("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    return grading.citation_statistics(_cited(ws), old)


@register("e11_most_cited", f"""WITH {_RECORDS}, {_CITED}
SELECT doc_id, count(*) AS times FROM (SELECT unnest(citations) AS doc_id FROM cited) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def e11_cited(ws: Workspace):
    return grading.most_cited(_cited(ws))


PRICES, EXCHANGE = (0.25, 1.5), 1.37
_LEDGER = f"""
ledger AS (SELECT version || ':' || purpose AS purpose, k * 30 AS input_tokens, k * 3 AS output_tokens, k % 7 AS thought_tokens FROM records),
rolled AS (SELECT purpose, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens + thought_tokens) AS BIGINT) AS output_tokens,
                  half_even((sum(input_tokens)::DOUBLE * {PRICES[0]}::DOUBLE + sum(output_tokens + thought_tokens)::DOUBLE * {PRICES[1]}::DOUBLE) / 1e6 * {EXCHANGE}::DOUBLE, 6) AS cost_cad
           FROM ledger GROUP BY 1)"""


def _ledger(ws: Workspace):
    k = F.col("k")
    return records(ws).select(
        F.concat_ws(":", "version", "purpose").alias("purpose"), (k * 30).alias("input_tokens"),
        (k * 3).alias("output_tokens"), (k % 7).alias("thought_tokens"),
    )


@register("e12_usage_rollup", f"WITH {_RECORDS}, {_LEDGER} SELECT * FROM rolled")
def e12(ws: Workspace):
    return grading.usage_rollup(_ledger(ws), PRICES, EXCHANGE)


@register("e12_cost_per_question", f"""WITH {_RECORDS}, {_LEDGER}
SELECT half_even(sum(cost_cad) / (SELECT count(*) FROM records WHERE version = 'v4'), 5) AS cost_per_question_cad
FROM rolled WHERE purpose IN ('v4:view', 'v4:click')""")
def e12_cost(ws: Workspace):
    runs = records(ws).filter("version = 'v4'").agg(F.count(F.lit(1)).alias("n")).scalar()
    rolled = grading.usage_rollup(_ledger(ws), PRICES, EXCHANGE)
    return grading.cost_per_question(rolled, ["v4:view", "v4:click"], runs)


# The pattern of the number rule without a look-behind: the character in front is matched instead, and every
# blank is doubled so that the one in front of a number is never used up by the number before it.
_NUMBERS_SQL = r"""
  SELECT doc_id, list_transform(regexp_extract_all(spaced, '(?i)(?:^|[^\p{L}\p{N}_.])[-−]?[£$]?\s{0,2}(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}+)(?:\.\p{Nd}+)?'),
                                lambda m: CAST(regexp_replace(regexp_extract(m, '\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?'), ',', '', 'g') AS DOUBLE)) AS found
  FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?', ' ', 'g'),
                                                     '\b\d{1,2}:\d{2}(:\d{2})?\b', ' ', 'g'), '\s', '  ', 'g') AS spaced FROM documents)"""


@register("e13_numbers_in_prose")
def e13(ws: Workspace):
    found = text.numbers(F.col("text"))
    return spread(ws.source("documents").select("doc_id", "text")).select("doc_id", F.explode(found).alias("n")).select(
        "doc_id", "n.value", "n.decimals", "n.raw"
    )


@register("e13_number_counts", f"SELECT doc_id, len(found) AS numbers FROM ({_NUMBERS_SQL}) WHERE len(found) > 0")
def e13_counts(ws: Workspace):
    n = F.size(text.numbers(F.col("text"))).cast("bigint")
    return spread(ws.source("documents").select("doc_id", "text")).select("doc_id", n.alias("numbers")).filter("numbers > 0")


@register("e13_numbers_per_order", """
SELECT o_orderkey AS id, round(o_totalprice, 2) AS total, 2 AS decimals, year(o_orderdate)::DOUBLE AS year FROM orders""")
def e13_orders(ws: Workspace):
    """What the parser reads back from a sentence about every order."""
    said = F.concat(
        F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" order value was £"),
        F.format_number("o_totalprice", 2), F.lit(", in the year "), F.year("o_orderdate"), F.lit("."),
    )
    parsed = spread(ws.source("orders")).select(F.col("o_orderkey").alias("id"), text.numbers(said).alias("n"))
    return parsed.select("id", F.col("n")[0]["value"].alias("total"), F.col("n")[0]["decimals"].alias("decimals"), F.col("n")[1]["value"].alias("year"))


def prose_records(ws: Workspace):
    """One answer per order stating its total; some restate it in millions, some are made up."""
    total, key = F.col("o_totalprice"), F.col("o_orderkey")
    mode = key % 4
    said = (
        F.when(mode == 0, F.concat(F.lit("The order came to £"), F.format_number(total, 2), F.lit(".")))
        .when(mode == 1, F.concat(F.lit("The order came to £"), F.format_number(total / 1e6, 3), F.lit(" million on 3 March 2000.")))
        .when(mode == 2, F.concat(F.lit("The order came to £"), F.format_number(total + 5000, 2), F.lit(" from customer "), F.col("o_custkey"), F.lit(".")))
        .otherwise(F.lit("The order was large."))
    )
    return spread(ws.source("orders")).select(
        key.alias("id"), said.alias("answer"), F.lit("How much was the order?").alias("question"),
        F.lit("SELECT o_totalprice FROM orders WHERE o_orderdate >= '2000-01-01'").alias("sql"),
        F.array(F.array(total.cast("decimal(14,2)").cast("string"))).alias("result"),
        mode.alias("mode"),
    )


# Each stated number in SQL: its value and decimals are known, so only the matching rule is evaluated.
_STATED = """
stated AS (
  SELECT o_orderkey AS id, 1 AS no, round(o_totalprice, 2) AS v, 2 AS d, round(o_totalprice, 2) AS cell FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 1, round(o_totalprice / 1e6, 3) * 1e6, -3, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 1, round(o_totalprice + 5000, 2), 2, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT o_orderkey, 2, o_custkey::DOUBLE, 0, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 4 = 2),
forms AS (SELECT id, no, v, d, unnest([cell, -cell, cell * 100, cell / 100]) AS c FROM stated),
judged AS (SELECT id, no, v, d,
                  bool_or(abs(c - v) <= 0.5 * pow(10.0::DOUBLE, -d) + CASE WHEN d >= 0 THEN 1e-9 ELSE 0 END
                          OR abs(c - v) <= greatest(5e-4 * greatest(abs(c), abs(v)), 0.005)) AS held FROM forms GROUP BY ALL),
bad AS (SELECT id, count(*) AS n FROM judged
        WHERE NOT held AND NOT (d = 0 AND v BETWEEN 1 AND 10) AND NOT (v = floor(v) AND v BETWEEN 1900 AND 2100 AND d = 0) GROUP BY id)"""


@register("e14_unsupported_numbers", f"WITH {_STATED} SELECT o_orderkey AS id, coalesce(n, 0) AS unsupported FROM orders LEFT JOIN bad ON id = o_orderkey")
def e14(ws: Workspace):
    found = claims.with_unsupported(prose_records(ws))
    return found.select("id", F.size("unsupported").cast("bigint").alias("unsupported"))


# The one number of each answer that may restate the total: its text, value and decimals, and the answer around it.
_CORRUPTED = """
texts AS (SELECT o_orderkey AS id, o_orderkey % 4 AS mode, round(o_totalprice, 2) AS cell, o_custkey AS buyer,
                 format('{:,.2f}', round(o_totalprice, 2)) AS full_text, format('{:,.3f}', round(o_totalprice / 1e6, 3)) AS short_text,
                 format('{:,.2f}', round(o_totalprice + 5000, 2)) AS wrong_text FROM orders),
heads AS (SELECT *, CASE mode WHEN 0 THEN '£' || full_text WHEN 1 THEN '£' || short_text || ' million' WHEN 2 THEN buyer::VARCHAR END AS head,
                 CASE mode WHEN 0 THEN cell WHEN 1 THEN round(cell / 1e6, 3) * 1e6 WHEN 2 THEN buyer::DOUBLE END AS v,
                 CASE mode WHEN 0 THEN 2 WHEN 1 THEN -3 ELSE 0 END AS d,
                 CASE mode WHEN 0 THEN 'The order came to £' || full_text || '.' WHEN 1 THEN 'The order came to £' || short_text || ' million on 3 March 2000.'
                           WHEN 2 THEN 'The order came to £' || wrong_text || ' from customer ' || buyer || '.' ELSE 'The order was large.' END AS answer FROM texts),
kept AS (SELECT *, CASE WHEN NOT (v = floor(v) AND v BETWEEN 1900 AND 2100)
                         AND (abs(cell - v) <= 0.5 * pow(10.0::DOUBLE, -d) + CASE WHEN d >= 0 THEN 1e-9 ELSE 0 END OR abs(cell - v) <= greatest(5e-4 * greatest(abs(cell), abs(v)), 0.005))
                        THEN head END AS original FROM heads),
digits AS (SELECT *, CASE WHEN original[1] = '£' THEN 2 ELSE 1 END AS pos FROM kept),
changed AS (SELECT *, substr(original, 1, pos - 1) || (CAST(original[pos] AS INTEGER) % 9 + 1) || substr(original, pos + 1) AS other FROM digits),
corrupted AS (SELECT *, substr(answer, 1, strpos(answer, original) - 1) || other || substr(answer, strpos(answer, original) + length(original)) AS text,
                     TRY_CAST(replace(regexp_extract(other, '[0-9.,]+'), ',', '') AS DOUBLE) * CASE mode WHEN 1 THEN 1e6 ELSE 1 END AS now FROM changed)"""


@register("e15_corrupted_claims", f"WITH {_CORRUPTED} SELECT id, original, CASE WHEN original IS NOT NULL THEN text END AS corrupted FROM corrupted")
def e15(ws: Workspace):
    return claims.corrupt(prose_records(ws)).select("id", "original", "corrupted")


# A wrong price in the same answer is unsupported whatever happens to the customer's number (mode 2).
@register("e15_detection_rate", f"""WITH {_CORRUPTED},
forms AS (SELECT id, mode, now, d, unnest([cell, -cell, cell * 100, cell / 100]) AS c FROM corrupted WHERE original IS NOT NULL),
judged AS (SELECT id, mode, bool_or(abs(c - now) <= 0.5 * pow(10.0::DOUBLE, -d) + CASE WHEN d >= 0 THEN 1e-9 ELSE 0 END
                                    OR abs(c - now) <= greatest(5e-4 * greatest(abs(c), abs(now)), 0.005)) OR now = 1 OR now BETWEEN 1900 AND 2100 AND now = floor(now) AS held
           FROM forms GROUP BY id, mode, now),
totals AS (SELECT (SELECT count(*) FROM corrupted) AS every, count(*) AS n, count(*) FILTER (WHERE mode = 2 OR NOT held) AS hit FROM judged)
SELECT every AS distinct_answers, n AS corrupted, every - n AS skipped, hit AS detected, half_even(100.0::DOUBLE * hit / n, 1) AS detection_pct FROM totals""")
def e15_detection(ws: Workspace):
    return claims.detection(claims.corrupt(prose_records(ws)))


@register("e16_verdict_rollup", f"""WITH {_RECORDS},
judged AS (SELECT outcome, "set", k % 5 <> 0 AS faithful, k % 3 <> 0 AS citation_correct, k % 50 <> 0 AS parsed FROM records
           WHERE version = 'v4' AND outcome IN ('correct', 'wrong', 'answered_unanswerable'))
SELECT 'faithful_by_outcome' AS measure, outcome AS key, count(*) AS judged, {_pct('faithful', 'true', 1)} AS pct FROM judged GROUP BY outcome
UNION ALL SELECT 'citation_correct_by_set', "set", count(*), {_pct('citation_correct', 'true', 1)} FROM judged GROUP BY "set"
UNION ALL SELECT 'unparsed', 'all', count(*), {_pct('NOT parsed', 'true', 1)} FROM judged""")
def e16(ws: Workspace):
    k = F.col("k")
    verdicts = records(ws).filter("version = 'v4'").filter(F.col("outcome").isin(grading.ANSWERED)).select(
        "outcome", "set", (k % 5 != 0).alias("faithful"), (k % 3 != 0).alias("citation_correct"), (k % 50 != 0).alias("parsed")
    )
    return grading.verdict_rollup(verdicts)


_RATERS = "pairs AS (SELECT doc_id AS label_id, quality AS human, (n_chars > 1200)::INTEGER AS judge FROM labels JOIN documents USING (doc_id))"


def _raters(ws: Workspace):
    """The quality label against a rule on the length of the document."""
    return ws.source("labels").join(ws.source("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("label_id"), F.col("quality").alias("human"), (F.col("n_chars") > 1200).cast("int").alias("judge")
    )


@register("e17_rater_agreement", f"""WITH {_RATERS},
c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE human = judge)::DOUBLE AS same, sum(human)::DOUBLE AS h, sum(judge)::DOUBLE AS j FROM pairs),
k AS (SELECT *, CASE WHEN (h = 0 AND j = 0) OR (h = n AND j = n) THEN NULL
                     ELSE (same / n - (h * j + (n - h) * (n - j)) / (n * n)) / (1 - (h * j + (n - h) * (n - j)) / (n * n)) END AS kappa FROM c)
SELECT CAST(n AS BIGINT) AS n, half_even(100.0::DOUBLE * same / n, 1) AS accuracy_pct, half_even(kappa, 3) AS cohens_kappa,
       CASE WHEN kappa IS NULL THEN 'one label only' WHEN kappa < 0.4 THEN 'weak'
            WHEN kappa < 0.6 THEN 'fair' WHEN kappa < 0.8 THEN 'good' ELSE 'close' END AS reading,
       CAST(h AS BIGINT) AS human_positive, CAST(j AS BIGINT) AS judge_positive FROM k""")
def e17(ws: Workspace):
    return grading.agreement(_raters(ws))


@register("e17_confusion", f"WITH {_RATERS} SELECT human, judge, count(*) AS n FROM pairs GROUP BY 1, 2")
def e17_confusion(ws: Workspace):
    return grading.confusion(_raters(ws))


@register("e17_disagreements", f"WITH {_RATERS} SELECT label_id FROM pairs WHERE human <> judge")
def e17_disagreements(ws: Workspace):
    return grading.disagreements(_raters(ws))


@register("e18_blind_sample", f"""WITH {_RECORDS},
pool AS (SELECT *, CASE WHEN "set" = 'defs' AND run = 0 THEN 0 WHEN "set" = 'defs' THEN 1 WHEN outcome <> 'correct' THEN 2
                        WHEN k % 10 = 0 THEN 3 WHEN run = 0 THEN 4 END AS stratum
         FROM records WHERE version = 'v4' AND outcome IN ('correct', 'wrong', 'answered_unanswerable')),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stratum, run) AS p FROM pool WHERE stratum IS NOT NULL) WHERE p = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id, run) AS f FROM one),
moved AS (SELECT id, run, outcome, stratum FROM numbered WHERE stratum <> 3 OR f <= 8
          UNION ALL SELECT id, run, outcome, 4 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stratum, run) AS r FROM pool WHERE run = 0 AND stratum IS NOT NULL)
          WHERE r = 1 AND id IN (SELECT id FROM numbered WHERE stratum = 3 AND f > 8)),
capped AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN stratum = 4 THEN md5('7:' || id) ELSE id END, run, id) AS q FROM moved)
SELECT id, run, stratum, outcome FROM capped ORDER BY stratum, q LIMIT 30""")
def e18(ws: Workspace):
    pool = records(ws).filter("version = 'v4'").filter(F.col("outcome").isin(grading.ANSWERED))
    sample = grading.blind_sample(pool.select("id", "run", "set", "outcome", (F.col("k") % 10 == 0).alias("flagged")))
    return sample.select("id", "run", "stratum", "outcome")


_BLOCKS = {"frozen": ["frozen"], "all": ["frozen", "defs"]}


def _block_sql(block: str, sets: list[str]) -> str:
    listed = ", ".join(f"'{s}'" for s in sets)
    return f"""SELECT '{block}' AS block, version, count(*) AS question_runs,
  {_pct(f"{_ANSWERABLE} AND outcome = 'correct'", _ANSWERABLE)} AS execution_accuracy_pct,
  {_pct("difficulty = 'unanswerable' AND outcome = 'refused'", "difficulty = 'unanswerable'")} AS abstention_accuracy_pct,
  {_pct("outcome IN ('wrong', 'answered_unanswerable')", "true")} AS confidently_wrong_pct, count(DISTINCT run) AS runs,
  count(*) FILTER (WHERE outcome IN ('wrong', 'answered_unanswerable')) || '/' || count(*) AS confidently_wrong, {_LATENCY}
FROM records WHERE "set" IN ({listed}) GROUP BY version"""


@register("e19_version_table", f"""WITH {_RECORDS}, {_LEDGER},
costs AS (SELECT split_part(purpose, ':', 1) AS version, half_even(sum(cost_cad), 6) AS cost_cad FROM rolled GROUP BY 1)
SELECT * FROM ({' UNION ALL '.join(_block_sql(b, s) for b, s in _BLOCKS.items())}) LEFT JOIN costs USING (version)""")
def e19(ws: Workspace):
    rolled = grading.usage_rollup(_ledger(ws), PRICES, EXCHANGE)
    costs = rolled.groupBy(F.split("purpose", ":")[0].alias("version")).agg(F.round(F.sum("cost_cad"), 6).alias("cost_cad"))
    return grading.version_table(records(ws), costs, _BLOCKS)


@register("e20_mean_tokens", f"""WITH {_RECORDS}, {_LEDGER}
SELECT CAST(floor(sum(input_tokens) / count(*)) AS BIGINT) AS input_per_call, CAST(floor(sum(output_tokens + thought_tokens) / count(*)) AS BIGINT) AS output_per_call FROM ledger""")
def e20(ws: Workspace):
    return grading.mean_tokens(_ledger(ws))
