"""DuckDB oracles for cleaning decisions and the column profile."""

from __future__ import annotations

from churnspark import config as C
from churnspark.functions.exprs import NUMBER_RE
from oracles import fixtures_sql as V
from oracles.text_sql import fill_sql

# Spark pattern -> strptime pattern, same order as the Spark list
DATE_FORMATS_SQL = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y"]
PATTERNS = [("email_share", C.EMAIL_RE), ("uuid_share", C.UUID_RE), ("hash_share", C.HASH_RE),
            ("phone_share", C.PHONE_RE)]

RAW_NAMES = f"""SELECT "Customer ID" AS customer_id, "Churn" AS churn, "Total Spend" AS total_spend,
  "N-Orders" AS n_orders, "Acct Bal" AS acct_bal, "Segment" AS segment, nation, "Has Urgent" AS has_urgent,
  has_open, constant_col, nearly_constant, email, row_hash, phone, account_uuid, signup_date, churn_date,
  mostly_null FROM ({V.customer_raw()}) raw"""
# column, kind, spark simpleString dtype
RAW_COLS = [("total_spend", "string", "string"), ("n_orders", "numeric", "bigint"),
            ("acct_bal", "numeric", "double"), ("segment", "string", "string"), ("nation", "string", "string"),
            ("has_urgent", "string", "string"), ("has_open", "string", "string"),
            ("constant_col", "string", "string"), ("nearly_constant", "string", "string"),
            ("email", "string", "string"), ("row_hash", "string", "string"), ("phone", "string", "string"),
            ("account_uuid", "string", "string"), ("signup_date", "string", "string"),
            ("churn_date", "string", "string"), ("mostly_null", "numeric", "bigint")]
RAW_STRINGS = ["churn"] + [c for c, k, _ in RAW_COLS if k == "string"]

CLEAN_COLS = [("c_nationkey", "numeric", "int"), ("c_acctbal", "numeric", "double"),
              ("c_mktsegment", "string", "string"), ("n_orders", "numeric", "bigint"),
              ("total_spend", "numeric", "double"), ("avg_spend", "numeric", "double"),
              ("max_spend", "numeric", "double"), ("n_open", "numeric", "bigint"), ("n_final", "numeric", "bigint"),
              ("n_urgent", "numeric", "bigint"), ("tenure_days", "numeric", "int"),
              ("has_urgent", "numeric", "int"), ("has_open", "numeric", "int"), ("has_big", "numeric", "int")]


def num_expr(c: str) -> str:
    s = f"replace(trim({c}), ',', '')"
    return (f"CASE WHEN regexp_full_match({s}, '{NUMBER_RE.strip('^$')}') THEN "
            f"CASE WHEN isinf(TRY_CAST({s} AS DOUBLE)) THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END END")


def bool_words_sql() -> str:
    return ", ".join(f"'{w}'" for w in C.BOOL_WORDS)


def bool_map_sql(c: str) -> str:
    return ("CASE " + " ".join(f"WHEN lower(trim({c})) = '{w}' THEN {v}" for w, v in C.BOOL_MAP.items())
            + " END")


def decisions(src: str, strings: list[str]) -> str:
    parts = []
    for c in strings:
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({num_expr(c)}) AS n_numeric,
  count({c}) AS n_nonnull, coalesce(bool_and(lower(trim({c})) IN ({bool_words_sql()})), false) AS bw FROM src""")
    body = "\nUNION ALL ".join(parts)
    return f"""WITH src AS ({src}), d AS ({body})
SELECT "column", n_rows, n_numeric, round(n_numeric / greatest(n_rows, 1), 6) AS numeric_share,
       n_numeric / greatest(n_rows, 1) > 0.8 AS to_numeric, n_nonnull, bw AS all_bool_words,
       NOT (n_numeric / greatest(n_rows, 1) > 0.8) AND n_nonnull > 0 AND bw AS to_bool FROM d"""


def _flags_sql() -> str:
    flags = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in ("is_email", "is_uuid", "is_hash", "is_phone",
                                                                  "is_id_like"))
    return f"coalesce(nullif(concat_ws(', ', {flags}), ''), '{C.DROP_IDENTIFIER_DEFAULT}')"


def profile(src: str, cols: list[tuple[str, str, str]]) -> str:
    stats = []
    vfs = []
    for pos, (c, kind, dtype) in enumerate(cols):
        if kind == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            extra = (f"avg({x}) AS mean, stddev_samp({x}) AS std, skewness({x}) AS skew, "
                     f"bool_and({x} IN (0.0, 1.0)) AS b01, NULL::BOOLEAN AS bw, "
                     + ", ".join(f"NULL::DOUBLE AS {n}" for n, _ in PATTERNS) + ", NULL::BOOLEAN AS dt")
            vnum = x
        else:
            pats = ", ".join(f"avg(CAST(regexp_full_match(trim({c}), '{p}') AS DOUBLE)) AS {n}" for n, p in PATTERNS)
            parsed = "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in DATE_FORMATS_SQL) + ")"
            extra = (f"NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS skew, NULL::BOOLEAN AS b01, "
                     f"bool_and(lower(trim({c})) IN ({bool_words_sql()})) AS bw, {pats}, "
                     f"bool_and(CASE WHEN {c} IS NOT NULL THEN {parsed} IS NOT NULL END) AS dt")
            vnum = "NULL::DOUBLE"
        stats.append(f"SELECT '{c}' AS \"column\", {pos} AS pos, '{dtype}' AS dtype, '{kind}' AS kind, "
                     f"count(*) AS n, count({c}) AS nn, {extra} FROM src")
        vfs.append(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {vnum} AS value_num FROM src "
                   f"WHERE {c} IS NOT NULL")
    leak = " OR ".join(f"instr(lower(\"column\"), '{h}') > 0" for h in C.LEAK_HINTS)
    return f"""WITH src AS ({src}),
st AS ({' UNION ALL '.join(stats)}),
vl AS ({' UNION ALL '.join(vfs)}),
vf AS (SELECT "column", value, any_value(value_num) AS value_num, count(*) AS cnt FROM vl GROUP BY "column", value),
tp AS (SELECT "column", count(*) OVER (PARTITION BY "column") AS n_unique, value AS top_value, cnt AS top_cnt,
              row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value_num ASC NULLS FIRST, value ASC) AS rn
       FROM vf),
j AS (SELECT st.*, coalesce(tp.n_unique, 0) AS nu, tp.top_value, tp.top_cnt
      FROM st LEFT JOIN (SELECT * FROM tp WHERE rn = 1) tp ON st."column" = tp."column"),
k AS (SELECT *,
        kind = 'string' AND coalesce(email_share, 0) > 0.8 AS is_email,
        kind = 'string' AND NOT coalesce(email_share, 0) > 0.8 AND coalesce(uuid_share, 0) > 0.8 AS is_uuid,
        kind = 'string' AND NOT coalesce(email_share, 0) > 0.8 AND NOT coalesce(uuid_share, 0) > 0.8
          AND coalesce(hash_share, 0) > 0.8 AS is_hash,
        kind = 'string' AND NOT coalesce(email_share, 0) > 0.8 AND NOT coalesce(uuid_share, 0) > 0.8
          AND NOT coalesce(hash_share, 0) > 0.8 AND coalesce(phone_share, 0) > 0.8 AS is_phone
      FROM j),
t AS (SELECT *,
        CASE WHEN nn = 0 THEN 'empty'
             WHEN kind = 'datetime' THEN 'datetime'
             WHEN kind = 'string' AND coalesce(dt, false) THEN 'datetime'
             WHEN kind = 'numeric' AND coalesce(b01, false) THEN 'boolean'
             WHEN kind = 'numeric' AND nu = n AND n >= 100 THEN 'identifier'
             WHEN kind = 'numeric' THEN 'numeric'
             WHEN coalesce(bw, false) THEN 'boolean'
             WHEN is_email OR is_uuid OR is_hash OR is_phone THEN 'identifier'
             WHEN nu = n THEN 'identifier'
             ELSE 'categorical' END AS detected_type,
        (n - nn) / greatest(n, 1) AS null_pct,
        CASE WHEN nn > 0 THEN top_cnt / nn END AS top_freq
      FROM k),
u AS (SELECT *, detected_type = 'identifier' AND NOT (is_email OR is_uuid OR is_hash OR is_phone) AS is_id_like,
             nu > {C.HIGH_CARDINALITY_LIMIT} OR nu / greatest(n, 1) > 0.5 AS high_card
      FROM t),
r AS (SELECT *,
  CASE WHEN null_pct > {C.NULL_THRESHOLD} THEN {fill_sql(C.DROP_NULLS, pct="CAST(round_even(null_pct * 100, 0) AS BIGINT)")}
       WHEN nu <= 1 AND detected_type <> 'empty' THEN '{C.DROP_CONSTANT}'
       WHEN coalesce(top_freq, 0) >= {C.NEAR_CONSTANT_THRESHOLD} THEN {fill_sql(C.DROP_NEAR_CONSTANT, pct="printf('%.1f', round_even(top_freq * 100, 1))")}
       WHEN detected_type = 'identifier' THEN {fill_sql(C.DROP_IDENTIFIER, flags=_flags_sql())}
       WHEN high_card AND detected_type = 'categorical' THEN {fill_sql(C.DROP_HIGH_CARD, n="nu")}
       WHEN detected_type = 'empty' THEN '{C.DROP_EMPTY}' END AS drop_reason
      FROM u)
SELECT "column", dtype, CAST(n - nn AS BIGINT) AS null_count, round(null_pct, 6) AS null_pct, CAST(nu AS BIGINT) AS n_unique,
  detected_type, top_value, round(top_freq, 6) AS top_freq,
  round(mean, 6) AS mean, round(std, 6) AS std,
  round(CASE WHEN nn > 2 AND NOT isnan(skew) THEN skew END, 6) AS skewness,
  drop_reason,
  CASE WHEN drop_reason IS NULL AND ({leak}) THEN {fill_sql(C.WARN_LEAK, column='"column"')} END AS leak_warning,
  CASE WHEN drop_reason IS NULL AND null_pct > 0.05 AND null_pct <= {C.NULL_THRESHOLD}
       THEN {fill_sql(C.WARN_MISSING, column='"column"', pct="printf('%.1f', round_even(null_pct * 100, 1))")} END
    AS missing_warning,
  nu <= 1 AS is_constant, coalesce(top_freq, 0) >= {C.NEAR_CONSTANT_THRESHOLD} AS is_near_constant,
  high_card, is_id_like, is_email, is_uuid, is_hash, is_phone
FROM r"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["cln1"] = f"SELECT * FROM ({RAW_NAMES}) x"
    q["cln2"] = decisions(RAW_NAMES, RAW_STRINGS)
    q["cln2_values"] = (f"WITH src AS ({RAW_NAMES}) SELECT customer_id, {num_expr('total_spend')} AS total_spend, "
                        f"{num_expr('nation')} AS nation FROM src")
    q["cln3"] = (f"WITH src AS ({RAW_NAMES}) SELECT customer_id, CAST({bool_map_sql('has_urgent')} AS INT) AS has_urgent, "
                 f"CAST({bool_map_sql('has_open')} AS INT) AS has_open, CAST({bool_map_sql('churn')} AS INT) AS churn "
                 f"FROM src")
    strict = "CASE " + " ".join(f"WHEN lower(trim(churn)) = '{w}' THEN {v}" for w, v in C.STRICT_TARGET_MAP.items()) + " END"
    q["cln4"] = f"WITH src AS ({RAW_NAMES}) SELECT customer_id, CAST({strict} AS INT) AS label FROM src"
    pos = ", ".join(f"'{w}'" for w in C.LENIENT_POSITIVE)
    q["cln5"] = (f"WITH src AS ({RAW_NAMES}) SELECT customer_id, CAST(lower(trim(churn)) IN ({pos}) AS INT) AS y "
                 f"FROM src WHERE churn IS NOT NULL")
    summ = ", ".join(f"'{w}'" for w in C.SUMMARY_POSITIVE)
    q["cln6"] = (f"WITH src AS ({RAW_NAMES}) SELECT count(*) AS n_rows, "
                 f"CAST(sum(CAST(coalesce(lower(trim(churn)) IN ({summ}), false) AS INT)) AS BIGINT) AS n_churn, "
                 f"round(CASE WHEN count(*) > 0 THEN sum(CAST(coalesce(lower(trim(churn)) IN ({summ}), false) AS INT)) "
                 f"/ count(*) ELSE 0.0 END, 6) AS pct_churn FROM src")
    prof_raw = profile(RAW_NAMES, RAW_COLS)
    prof_clean = profile(V.customer_features(), CLEAN_COLS)
    q["prf16"] = prof_raw
    q["prf16_clean"] = prof_clean
    sel = {
        "prf1": "column, null_count, null_pct", "prf2": "column, n_unique", "prf3": "column, top_value, top_freq",
        "prf4": "column, n_unique <= 1 AS is_constant, coalesce(top_freq, 0) >= 0.98 AS is_near_constant",
        "prf5": "column, mean, std, skewness", "prf6": "column, detected_type = 'datetime' AS is_datetime",
        "prf7": "column, detected_type", "prf8": "column, detected_type = 'boolean' AS is_boolean",
        "prf9": "column, detected_type, drop_reason", "prf10": "column, detected_type = 'identifier' AS is_identifier, is_id_like",
        "prf11": "column, n_unique, detected_type, high_card", "prf12": "column, drop_reason",
        "prf13": "column, leak_warning", "prf14": "column, missing_warning",
    }
    for k, cols in sel.items():
        base = prof_clean if k in ("prf5", "prf7") else prof_raw
        q[k] = f"WITH p AS ({base}) SELECT {cols.replace('column', '\"column\"', 1)} FROM p"
    q["prf15"] = f"""WITH p AS ({prof_raw})
SELECT CASE WHEN detected_type = 'datetime' THEN 'datetime' WHEN detected_type = 'boolean' THEN 'boolean'
            WHEN detected_type = 'numeric' THEN 'numeric' ELSE 'categorical' END AS role,
       list_sort(list("column")) AS columns
FROM p WHERE drop_reason IS NULL GROUP BY 1"""
    q["prf19"] = f"""WITH cf AS ({V.customer_features(540)})
SELECT count(*) AS n_rows, round(avg(CAST(label AS DOUBLE)), 6) AS churn_rate,
       count(*) > {C.VERY_LARGE_DATASET_ROWS} AS very_large,
       avg(CAST(label AS DOUBLE)) < {C.IMBALANCE_LOW} OR avg(CAST(label AS DOUBLE)) > {C.IMBALANCE_HIGH} AS imbalanced
FROM cf"""
    return q
