"""Building blocks of the checking SQL: the retail tables as common table expressions."""

from __future__ import annotations

_CODES = "'POST', 'DOT', 'M', 'D', 'C2', 'BANK CHARGES', 'AMAZONFEE', 'PADS', 'CRUK', 'S', 'B'"


def with_half_even(sql: str) -> str:
    """Spell out ``half_even(x, n)``: round half to even, on the decimal digits of x as the jobs do."""
    name = "half_even("
    while name in sql:
        start = sql.rindex(name)  # innermost calls first
        depth, comma, end = 1, 0, start + len(name)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        value, digits = sql[start + len(name):comma], sql[comma + 1:end - 1]
        sql = f"{sql[:start]}CAST(round_even(CAST({value} AS DECIMAL(30,15)),{digits}) AS DOUBLE){sql[end:]}"
    return sql


def non_product(code: str) -> str:
    return (
        f"(upper({code}) IN ({_CODES}) OR starts_with(upper({code}), 'ADJUST')"
        f" OR starts_with(upper({code}), 'TEST') OR starts_with(upper({code}), 'GIFT_'))"
    )


BLOCKS: dict[str, tuple[list[str], str]] = {
    "raw_lines": ([], """
        SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice,
               CASE WHEN l_partkey % 97 = 0 THEN 'POST'
                    WHEN l_partkey % 89 = 0 THEN 'ADJUST' || CAST(l_partkey AS VARCHAR)
                    ELSE 'P' || CAST(l_partkey AS VARCHAR) END AS stock_code,
               p_name AS description,
               CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity
                         WHEN (l_orderkey * 7 + l_linenumber) % 211 = 0 THEN 0
                         ELSE l_quantity END AS INTEGER) AS quantity,
               CAST(o_orderdate AS TIMESTAMP) AS invoice_date,
               CAST(p_retailprice AS DECIMAL(12,3)) AS price,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CASE WHEN l_orderkey % 13 = 0 THEN sn.n_name ELSE cn.n_name END AS country
        FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey
        JOIN nation cn ON cn.n_nationkey = c_nationkey
        JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation sn ON sn.n_nationkey = s_nationkey
        JOIN part ON p_partkey = l_partkey
        JOIN (VALUES (1), (2)) AS times(copy_no)
          ON copy_no = 1 OR (l_orderkey % 29 = 0 AND l_linenumber = 1)"""),
    "sales": (["raw_lines"], f"""
        SELECT DISTINCT invoice, stock_code, description, quantity, invoice_date, price,
               CAST(customer_id AS INTEGER) AS customer_id, country,
               CAST(quantity * price AS DECIMAL(14,3)) AS revenue
        FROM raw_lines
        WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C')
          AND quantity > 0 AND price > 0 AND NOT {non_product('stock_code')}"""),
    "cancellations": (["raw_lines"], """
        SELECT invoice, stock_code, description, quantity, invoice_date, price,
               CAST(customer_id AS INTEGER) AS customer_id, country,
               CAST(quantity * price AS DECIMAL(14,3)) AS revenue
        FROM raw_lines
        WHERE customer_id IS NOT NULL AND starts_with(invoice, 'C')"""),
    "fact_sales": (["sales"], """
        SELECT row_number() OVER (ORDER BY invoice_date, invoice, stock_code, customer_id, country, quantity, price)
                 AS sales_line_id,
               invoice, invoice_date, CAST(strftime(invoice_date, '%Y%m%d') AS INTEGER) AS date_key,
               customer_id, stock_code, country, quantity, price, revenue
        FROM sales"""),
    "fact_cancellations": (["cancellations"], """
        SELECT row_number() OVER (ORDER BY invoice_date, invoice, stock_code, customer_id, country, quantity, price)
                 AS cancellation_line_id,
               invoice, invoice_date, CAST(strftime(invoice_date, '%Y%m%d') AS INTEGER) AS date_key,
               customer_id, stock_code, country, quantity, price, revenue
        FROM cancellations"""),
    "both_facts": (["sales", "cancellations"], """
        SELECT * FROM sales UNION ALL SELECT * FROM cancellations"""),
    "dim_date": (["both_facts"], """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
               CAST(year(d) AS SMALLINT) AS year, CAST(quarter(d) AS SMALLINT) AS quarter,
               CAST(month(d) AS SMALLINT) AS month, strftime(d, '%B') AS month_name,
               CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(day(d) AS SMALLINT) AS day_of_month,
               CAST(isodow(d) AS SMALLINT) AS day_of_week, strftime(d, '%A') AS day_name,
               isodow(d) IN (6, 7) AS is_weekend
        FROM (SELECT unnest(generate_series(date_trunc('day', min(invoice_date)), date_trunc('day', max(invoice_date)),
                                            INTERVAL 1 DAY)) AS d
              FROM both_facts) days"""),
    "dim_customer": (["sales", "both_facts"], """
        SELECT customer_id, country, first_invoice_date, last_invoice_date
        FROM (SELECT customer_id, country,
                     row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS place
              FROM both_facts GROUP BY customer_id, country) homes
        LEFT JOIN (SELECT customer_id, min(invoice_date) AS first_invoice_date, max(invoice_date) AS last_invoice_date
                   FROM sales GROUP BY customer_id) spans USING (customer_id)
        WHERE place = 1"""),
    "dim_product": (["sales", "cancellations", "both_facts"], f"""
        SELECT stock_code, coalesce(s.description, c.description) AS description,
               NOT {non_product('stock_code')} AS is_product
        FROM (SELECT DISTINCT stock_code FROM both_facts) codes
        LEFT JOIN (SELECT stock_code, description FROM (
                     SELECT stock_code, description,
                            row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS place
                     FROM sales WHERE description IS NOT NULL GROUP BY stock_code, description) WHERE place = 1) s
               USING (stock_code)
        LEFT JOIN (SELECT stock_code, description FROM (
                     SELECT stock_code, description,
                            row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS place
                     FROM cancellations WHERE description IS NOT NULL GROUP BY stock_code, description)
                   WHERE place = 1) c
               USING (stock_code)"""),
}

FEATURES = ["recency", "frequency", "monetary", "tenure", "avg_order_value", "breadth", "cancel_rate", "regularity"]
LOWER = {"recency", "cancel_rate", "regularity"}
WEIGHTS = [0.25, 0.25, 0.30, 0.0, 0.0, 0.10, 0.10, 0.0]
TOTAL = sum(WEIGHTS)


def percentile(column: str) -> str:
    direction = "DESC" if column in LOWER else "ASC"
    return f"""CASE WHEN {column} IS NULL THEN 0.0::DOUBLE ELSE
      ((rank() OVER (PARTITION BY {column} IS NULL ORDER BY {column} {direction}))::DOUBLE
       + ((count(*) OVER (PARTITION BY {column})) - 1)::DOUBLE / 2.0::DOUBLE) / (count({column}) OVER ())::DOUBLE END"""


def weighted(weights: list[float]) -> str:
    total = sum(weights)
    return " + ".join(f"pct_{f} * {w / total!r}::DOUBLE" for f, w in zip(FEATURES, weights))


def tier(rank: str, n: str) -> str:
    return f"""CASE WHEN {rank}::DOUBLE / {n} <= 0.1::DOUBLE + 1e-12 THEN 'Tier 1'
     WHEN {rank}::DOUBLE / {n} <= 0.3::DOUBLE + 1e-12 THEN 'Tier 2'
     WHEN {rank}::DOUBLE / {n} <= 0.6::DOUBLE + 1e-12 THEN 'Tier 3' ELSE 'Tier 4' END"""


def features_sql(sales: str, cancellations: str, cutoffs: list[str]) -> str:
    dates = ", ".join(f"(DATE '{c}')" for c in cutoffs)
    return f"""
        WITH cutoffs(cutoff_date) AS (VALUES {dates}),
        bought AS (SELECT cutoff_date, customer_id, invoice, min(invoice_date) AS ts, sum(revenue) AS v
                   FROM {sales} JOIN cutoffs ON invoice_date < cutoff_date GROUP BY ALL),
        gaps AS (SELECT cutoff_date, customer_id, count(g) AS n, sum(g)::BIGINT AS s, sum(g * g)::BIGINT AS q
                 FROM (SELECT cutoff_date, customer_id,
                              date_diff('day', lag(ts) OVER (PARTITION BY cutoff_date, customer_id ORDER BY ts), ts) AS g
                       FROM bought) GROUP BY ALL),
        per AS (SELECT cutoff_date, customer_id, min(ts) AS first, max(ts) AS last, count(*) AS frequency, sum(v) AS total
                FROM bought GROUP BY ALL),
        wide AS (SELECT cutoff_date, customer_id, count(DISTINCT stock_code) AS breadth
                 FROM {sales} JOIN cutoffs ON invoice_date < cutoff_date GROUP BY ALL),
        back AS (SELECT cutoff_date, customer_id, count(DISTINCT invoice) AS lost
                 FROM {cancellations} JOIN cutoffs ON invoice_date < cutoff_date GROUP BY ALL)
        SELECT cutoff_date, customer_id, CAST(date_diff('day', last, cutoff_date) AS INTEGER) AS recency, frequency,
               total::DOUBLE AS monetary, CAST(date_diff('day', first, cutoff_date) AS INTEGER) AS tenure,
               total::DOUBLE / frequency AS avg_order_value, breadth,
               coalesce(lost, 0)::DOUBLE / (frequency + coalesce(lost, 0)) AS cancel_rate,
               CASE WHEN n >= 2 THEN sqrt((n * q - s * s)::DOUBLE / (n * (n - 1))::DOUBLE) END AS regularity
        FROM per JOIN gaps USING (cutoff_date, customer_id) JOIN wide USING (cutoff_date, customer_id)
        LEFT JOIN back USING (cutoff_date, customer_id)"""


def scored_sql(ranked: str, weights: list[float]) -> str:
    contribs = ", ".join(f"pct_{f} * {w / sum(weights)!r}::DOUBLE AS contrib_{f}" for f, w in zip(FEATURES, weights))
    return f"""
        SELECT *, {tier('score_rank', 'n')} AS tier
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, customer_id) AS score_rank, count(*) OVER () AS n
              FROM (SELECT *, {contribs}, {weighted(weights)} AS score FROM {ranked}))"""


_PCTS = ", ".join(f"{percentile(f)} AS pct_{f}" for f in FEATURES)
BLOCKS |= {
    "snapshots": (["sales", "cancellations"], features_sql("sales", "cancellations", ["1999-12-01", "2000-06-01"])),
    "features": (["snapshots"], "SELECT * EXCLUDE (cutoff_date) FROM snapshots WHERE cutoff_date = DATE '2000-06-01'"),
    "ranked_features": (["features"], f"SELECT *, {_PCTS} FROM features"),
    "scored": (["ranked_features"], scored_sql("ranked_features", WEIGHTS)),
    "future": (["sales"], """
        SELECT customer_id, sum(revenue) AS future_revenue FROM sales
        WHERE invoice_date >= DATE '2000-06-01' AND invoice_date < DATE '2000-12-01' GROUP BY customer_id"""),
    "scored_outcome": (["scored", "future"], """
        SELECT s.*, coalesce(future_revenue, 0) AS future_revenue FROM scored s LEFT JOIN future USING (customer_id)"""),
    "faulty_sales": (["sales"], "SELECT * FROM sales WHERE country <> 'NATION_3'"),
    "faulty_scored": (["faulty_sales", "cancellations"], scored_sql(
        f"(SELECT *, {_PCTS} FROM ({features_sql('faulty_sales', 'cancellations', ['2000-06-01'])}))", WEIGHTS)),
}


def _collect(name: str, seen: list[str]) -> None:
    for needed in BLOCKS[name][0]:
        _collect(needed, seen)
    if name not in seen:
        seen.append(name)


def using(names: str, body: str) -> str:
    """``body`` preceded by the named blocks and everything they need."""
    seen: list[str] = []
    for name in names.split():
        _collect(name, seen)
    blocks = ",\n".join(f"{name} AS ({BLOCKS[name][1]}\n)" for name in seen)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {blocks},\n{text[5:]}"
    return f"WITH {blocks}\n{text}"
