"""Registered parity checks: the good load against one that silently lost a country."""

from __future__ import annotations

import re

from basketry.operators import digest_tree, parity
from basketry.operators.star import PRIMARY_KEYS, TABLES
from basketry.plans.oracle import BLOCKS, using
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace

_TS = "'%Y-%m-%d %H:%M:%S.%f'"
_LINE = ["invoice", "invoice_date", "date_key", "customer_id", "stock_code", "country", "quantity", "price", "revenue"]
_COLUMNS = {
    "dim_date": ["date_key", "full_date", "year", "quarter", "month", "month_name", "month_start", "day_of_month",
                 "day_of_week", "day_name", "is_weekend"],
    "dim_customer": ["customer_id", "country", "first_invoice_date", "last_invoice_date"],
    "dim_product": ["stock_code", "description", "is_product"],
    "fact_sales": ["sales_line_id", *_LINE],
    "fact_cancellations": ["cancellation_line_id", *_LINE],
}


def _faulty_blocks() -> None:
    """The star of the lossy load: the same blocks over the lines that were left."""
    for name in ("both_facts", "dim_date", "dim_customer", "dim_product", "fact_sales"):
        needs, text = BLOCKS[name]
        for table in ("both_facts", "sales"):
            text = text.replace(f"FROM {table}", f"FROM faulty_{table}")
        renamed = [f"faulty_{n}" if n in ("both_facts", "sales") else n for n in needs]
        BLOCKS[f"faulty_{name}"] = (renamed, text)
    BLOCKS["faulty_fact_cancellations"] = (["fact_cancellations"], "SELECT * FROM fact_cancellations")


_faulty_blocks()
_BOTH = " ".join([*TABLES, *[f"faulty_{t}" for t in TABLES]])


def _text(column: str) -> str:
    value = f"strftime({column}, {_TS})" if "invoice_date" in column else f"CAST({column} AS VARCHAR)"
    return f"coalesce({value}, '<null>')"


def _digest(table: str, column: str, side: str) -> str:
    parts = " || ".join(f"length({p}) || ':' || {p}" for p in (_text(PRIMARY_KEYS[table]), _text(column)))
    return f"(SELECT CAST(coalesce(sum(('0x' || substr(md5({parts}), 1, 15))::BIGINT), 0) AS VARCHAR) FROM {side}{table})"


def _row(kind: str, name: str, left: str, right: str) -> str:
    return f"SELECT '{kind}' AS kind, '{name}' AS name, {left} AS left_value, {right} AS right_value"


_P1 = [_row("row_count", t, f"(SELECT count(*)::VARCHAR FROM {t})", f"(SELECT count(*)::VARCHAR FROM faulty_{t})") for t in TABLES]
_P2 = [
    _row("column_checksum", f"{t}.{c}", _digest(t, c, ""), _digest(t, c, "faulty_"))
    for t in TABLES for c in _COLUMNS[t]
]
_P3 = [
    _row("revenue_total", t, f"(SELECT CAST(CAST(sum(revenue) AS DECIMAL(24,3)) AS VARCHAR) FROM {t})",
         f"(SELECT CAST(CAST(sum(revenue) AS DECIMAL(24,3)) AS VARCHAR) FROM faulty_{t})")
    for t in ("fact_sales", "fact_cancellations")
]


def _checks_sql(rows: list[str]) -> str:
    return f"SELECT *, left_value IS NOT DISTINCT FROM right_value AS match FROM ({' UNION ALL '.join(rows)})"


@register("p1_row_counts", using(_BOTH, _checks_sql(_P1)))
def p1(ws: Workspace):
    return parity.row_counts(ws.stars(), ws.faulty_stars())


@register("p2_column_checksums", using(_BOTH, _checks_sql(_P2)))
def p2(ws: Workspace):
    return parity.column_checksums(ws.stars(), ws.faulty_stars())


@register("p3_revenue_totals", using(_BOTH, _checks_sql(_P3)))
def p3(ws: Workspace):
    return parity.revenue_totals(ws.stars(), ws.faulty_stars())


@register("p4_country_drilldown", using("sales faulty_sales", """
SELECT country, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows
FROM (SELECT country, count(*) AS n FROM sales GROUP BY 1) l FULL JOIN (SELECT country, count(*) AS n FROM faulty_sales GROUP BY 1) r
USING (country) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)"""))
def p4(ws: Workspace):
    return parity.country_drilldown(ws.star("fact_sales"), ws.faulty_stars()["fact_sales"])


def _customer_versions(ws: Workspace):
    """The customers of both loads, stored in leaves with their digests."""
    return ws.fitted("customer_versions", lambda: [
        digest_tree.store(side["dim_customer"], ["customer_id"], ws.scratch(name)) for name, side in (("good", ws.stars()), ("faulty", ws.faulty_stars()))])


_BOTH_CUSTOMERS = """SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, a.customer_id IS NULL AS added, b.customer_id IS NULL AS missing,
  array_to_string(list_filter(['country' , 'first_invoice_date', 'last_invoice_date'], lambda c: CASE c WHEN 'country' THEN a.country IS DISTINCT FROM b.country
    WHEN 'first_invoice_date' THEN a.first_invoice_date IS DISTINCT FROM b.first_invoice_date ELSE a.last_invoice_date IS DISTINCT FROM b.last_invoice_date END), ',') AS columns
  FROM dim_customer a FULL JOIN faulty_dim_customer b ON a.customer_id = b.customer_id"""


@register("p4_changed_customers", using("dim_customer faulty_dim_customer", f"""
SELECT customer_id, CASE WHEN missing THEN 'missing' WHEN added THEN 'added' ELSE 'changed' END AS change,
       CASE WHEN missing OR added THEN '' ELSE columns END AS columns FROM ({_BOTH_CUSTOMERS}) WHERE missing OR added OR columns <> ''"""))
def p4_changed(ws: Workspace):
    """Which customers the silent fault lost or changed, from the leaves whose digests differ."""
    return digest_tree.changed_rows(*_customer_versions(ws))


_MOVES = """SELECT coalesce(a.tier, 'missing') AS left_tier, coalesce(b.tier, 'missing') AS right_tier, count(*) AS customers
FROM scored a FULL JOIN faulty_scored b USING (customer_id) GROUP BY 1, 2"""
_AGREEMENT = f"""SELECT *, missing_in_right = 0 AND extra_in_right = 0 AND tier_changed = 0 AS match FROM (
  SELECT CAST(sum(customers) FILTER (WHERE left_tier <> 'missing') AS BIGINT) AS customers_left,
         CAST(sum(customers) FILTER (WHERE right_tier <> 'missing') AS BIGINT) AS customers_right,
         CAST(coalesce(sum(customers) FILTER (WHERE right_tier = 'missing'), 0) AS BIGINT) AS missing_in_right,
         CAST(coalesce(sum(customers) FILTER (WHERE left_tier = 'missing'), 0) AS BIGINT) AS extra_in_right,
         CAST(coalesce(sum(customers) FILTER (WHERE left_tier <> right_tier AND 'missing' NOT IN (left_tier, right_tier)), 0) AS BIGINT) AS tier_changed,
         half_even(100.0::DOUBLE * coalesce(sum(customers) FILTER (WHERE left_tier = right_tier), 0)::DOUBLE / sum(customers)::DOUBLE, 3) AS agreement_pct
  FROM ({_MOVES}))"""


@register("p5_tier_transitions", using("scored faulty_scored", _MOVES))
def p5(ws: Workspace):
    return parity.tier_transitions(ws.scored(), ws.faulty_scored())


@register("p5_tier_agreement", using("scored faulty_scored", _AGREEMENT))
def p5_agreement(ws: Workspace):
    return parity.tier_agreement(parity.tier_transitions(ws.scored(), ws.faulty_scored()))


def _parity_sql(rows: list[str]) -> str:
    return f"""SELECT count(*) AS checks_total, count(*) FILTER (WHERE match) AS checks_passed,
       half_even(100.0::DOUBLE * count(*) FILTER (WHERE match) / count(*), 2) AS parity_pct, bool_and(match) AS pass
FROM (SELECT match FROM ({_checks_sql(rows)}) UNION ALL SELECT match FROM ({_AGREEMENT}))"""


def _all_checks(ws: Workspace, right, right_scored):
    tiers = parity.tier_check(parity.tier_agreement(parity.tier_transitions(ws.scored(), right_scored)))
    return parity.warehouse_checks(ws.stars(), right).unionByName(tiers)


def _second_blocks() -> str:
    """A second load: every block that the star and the scores come from, once more, from the source tables."""
    closure, waiting = set(), [*TABLES, "scored"]
    while waiting:
        name = waiting.pop()
        if name in BLOCKS and name not in closure:
            closure.add(name)
            waiting += BLOCKS[name][0]
    for name in closure:
        needs, text = BLOCKS[name]
        for other in closure:
            text = re.sub(rf"\b(FROM|JOIN|,)(\s+){other}\b(?!\.)", rf"\1\2second_{other}", text)
        BLOCKS[f"second_{name}"] = ([f"second_{n}" if n in closure else n for n in needs], text)
    return " ".join([*TABLES, "scored", *[f"second_{n}" for n in (*TABLES, "scored")]])


@register("p6_parity_clean", using(_second_blocks(), _parity_sql(_P1 + _P2 + _P3).replace("faulty_", "second_")))
def p6(ws: Workspace):
    """Two loads of the same source tables, each with cleaning, star and scores of its own, agree on everything."""
    return parity.parity(_all_checks(ws, ws.second_stars(), ws.second_scored()))


@register("p7_parity_with_silent_fault", using(_BOTH + " scored faulty_scored", _parity_sql(_P1 + _P2 + _P3)))
def p7(ws: Workspace):
    return parity.parity(_all_checks(ws, ws.faulty_stars(), ws.faulty_scored()))


@register("p7_silent_fault_checks", using(_BOTH, _checks_sql(_P1 + _P2 + _P3)))
def p7_checks(ws: Workspace):
    return parity.warehouse_checks(ws.stars(), ws.faulty_stars())
