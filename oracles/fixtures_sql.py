"""DuckDB text of the analysis views (the oracle side of sources/fixtures.py).

Each function returns a CTE body; queries are built as
``WITH cf AS (<customer_features>) SELECT ...``.
"""

from __future__ import annotations

from churnspark.sources import fixtures as FX


def customer_features(horizon_days: int = FX.DEFAULT_HORIZON_DAYS) -> str:
    return f"""
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
       CAST(coalesce(h.n_orders, 0) AS BIGINT) AS n_orders,
       round(h.sum_spend, 2) AS total_spend,
       round(round(h.sum_spend, 2) / CASE WHEN coalesce(h.n_orders, 0) > 0
                                          THEN CAST(h.n_orders AS DOUBLE) END, 6) AS avg_spend,
       h.max_spend,
       CAST(coalesce(h.n_open, 0) AS BIGINT) AS n_open,
       CAST(coalesce(h.n_final, 0) AS BIGINT) AS n_final,
       CAST(coalesce(h.n_urgent, 0) AS BIGINT) AS n_urgent,
       CAST(date_diff('day', CAST(h.first_order AS DATE), CAST(k.t AS DATE)) AS INTEGER) AS tenure_days,
       CAST(coalesce(h.n_urgent, 0) > 0 AS INTEGER) AS has_urgent,
       CAST(coalesce(h.n_open, 0) > 0 AS INTEGER) AS has_open,
       CAST(coalesce(h.max_spend >= {FX.BIG_ORDER_PRICE}, false) AS INTEGER) AS has_big,
       CAST(coalesce(h.n_after, 0) = 0 AS INTEGER) AS label
FROM customer c
CROSS JOIN (SELECT max(o_orderdate) - INTERVAL {int(horizon_days)} DAY AS t FROM orders) k
LEFT JOIN (
  SELECT o.o_custkey,
         count(*) FILTER (WHERE o.o_orderdate <= k2.t) AS n_orders,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderdate <= k2.t) AS sum_spend,
         max(o.o_totalprice) FILTER (WHERE o.o_orderdate <= k2.t) AS max_spend,
         count(*) FILTER (WHERE o.o_orderdate <= k2.t AND o.o_orderstatus = 'O') AS n_open,
         count(*) FILTER (WHERE o.o_orderdate <= k2.t AND o.o_orderstatus = 'F') AS n_final,
         count(*) FILTER (WHERE o.o_orderdate <= k2.t AND o.o_orderpriority = '{FX.URGENT_PRIORITY}') AS n_urgent,
         min(o.o_orderdate) FILTER (WHERE o.o_orderdate <= k2.t) AS first_order,
         count(*) FILTER (WHERE o.o_orderdate > k2.t) AS n_after
  FROM orders o
  CROSS JOIN (SELECT max(o_orderdate) - INTERVAL {int(horizon_days)} DAY AS t FROM orders) k2
  GROUP BY o.o_custkey
) h ON c.c_custkey = h.o_custkey
"""


def hash_bucket(expr: str, salt: str = FX.HASH_SALT, buckets: int = 1000) -> str:
    return f"(CAST(('0x' || substr(md5('{salt}' || CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT) % {buckets})"


def scored() -> str:
    values = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, a, b, c in FX.SCORE_MODELS)
    return f"""
SELECT m.model, cf.c_custkey, cf.label,
       round(1.0 / (1.0 + exp(-(m.a + m.b * cf.n_orders + m.c * cf.c_acctbal / 10000.0))), 4) AS p,
       CAST({hash_bucket('cf.c_custkey')} % {FX.N_FOLDS} AS INTEGER) AS fold
FROM ({customer_features()}) cf
CROSS JOIN (VALUES {values}) m(model, a, b, c)
"""


def doc_features() -> str:
    return """
SELECT l.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic AS label
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def user_events() -> str:
    per_type = ",\n       ".join(
        f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in FX.EVENT_TYPES)
    return f"""
SELECT user_id, count(*) AS n_events,
       {per_type},
       round(sum(value), 2) AS sum_value, round(round(sum(value), 2) / count(*), 8) AS avg_value,
       max(value) AS max_value, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM events GROUP BY user_id
"""


def _flag_words(flag: str, key: str) -> str:
    return f"""CASE WHEN {flag} IS NULL THEN NULL
     WHEN ({key}) % 4 = 0 THEN CASE WHEN {flag} = 1 THEN 'Yes' ELSE 'No' END
     WHEN ({key}) % 4 = 1 THEN CASE WHEN {flag} = 1 THEN 'Y' ELSE 'N' END
     WHEN ({key}) % 4 = 2 THEN CASE WHEN {flag} = 1 THEN 't' ELSE 'f' END
     ELSE CASE WHEN {flag} = 1 THEN 'TRUE' ELSE 'false' END END"""


def customer_raw() -> str:
    md5 = "md5(CAST(c_custkey AS VARCHAR))"
    return f"""
SELECT c_custkey AS "Customer ID",
       CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS "Churn",
       CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE ' ' || format('{{:,.2f}}', total_spend) || ' ' END AS "Total Spend",
       n_orders AS "N-Orders",
       c_acctbal AS "Acct Bal",
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS "Segment",
       CAST(c_nationkey AS VARCHAR) AS nation,
       {_flag_words('has_urgent', 'c_custkey')} AS "Has Urgent",
       {_flag_words('has_open', 'c_custkey + 1')} AS has_open,
       'x' AS constant_col,
       CASE WHEN c_custkey % 100 = 0 THEN 'b' ELSE 'a' END AS nearly_constant,
       'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       {md5} AS row_hash,
       '+1 555-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone,
       substr({md5}, 1, 8) || '-' || substr({md5}, 9, 4) || '-' || substr({md5}, 13, 4) || '-'
         || substr({md5}, 17, 4) || '-' || substr({md5}, 21, 12) AS account_uuid,
       strftime(DATE '2000-01-01' + coalesce(tenure_days, 0), '%Y-%m-%d') AS signup_date,
       CASE WHEN label = 1 THEN '2001-06-30' END AS churn_date,
       CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE n_urgent END AS mostly_null
FROM ({customer_features()}) cf
"""
