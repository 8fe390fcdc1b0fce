"""Oracle SQL (DuckDB) per registered query name."""

from __future__ import annotations

from churnspark import config as C
from oracles import fixtures_sql as V
from oracles.signal_sql import signal_ctes

SQL: dict[str, str] = {}

SQL["view_customer_features"] = V.customer_features()
SQL["view_customer_features_imb"] = V.customer_features(540)
SQL["view_customer_raw"] = V.customer_raw()
SQL["view_doc_features"] = V.doc_features()
SQL["view_user_events"] = V.user_events()
SQL["view_scored"] = V.scored()


def _round6(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


# --- signal inputs: cleaned column names, lenient target ---------------------------------
def _lenient_str(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in C.LENIENT_POSITIVE)
    return f"(CASE WHEN {c} IS NULL THEN NULL ELSE CAST(lower(trim(CAST({c} AS VARCHAR))) IN ({words}) AS INT) END)"


def _lenient_num(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN NULL ELSE CAST({c} <> 0 AS INT) END)"


RAW_SRC = f"""SELECT "Customer ID" AS customer_id, "Churn" AS churn, "Total Spend" AS total_spend,
  "N-Orders" AS n_orders, "Acct Bal" AS acct_bal, "Segment" AS segment, nation, "Has Urgent" AS has_urgent,
  has_open, constant_col, nearly_constant, email, row_hash, phone, account_uuid, signup_date, churn_date,
  mostly_null FROM ({V.customer_raw()}) raw"""
RAW_ORDER = ["total_spend", "n_orders", "acct_bal", "segment", "nation", "has_urgent", "has_open",
             "constant_col", "nearly_constant", "email", "row_hash", "phone", "account_uuid", "signup_date",
             "churn_date", "mostly_null"]
RAW_NUM = ["n_orders", "acct_bal", "mostly_null"]
RAW_SIG = signal_ctes(RAW_SRC, _lenient_str("churn"), RAW_NUM,
                      [c for c in RAW_ORDER if c not in RAW_NUM], RAW_ORDER)

CLEAN_ORDER = ["c_nationkey", "c_acctbal", "c_mktsegment", "n_orders", "total_spend", "avg_spend", "max_spend",
               "n_open", "n_final", "n_urgent", "tenure_days", "has_urgent", "has_open", "has_big"]
CLEAN_SIG = signal_ctes(V.customer_features(), _lenient_num("label"),
                        [c for c in CLEAN_ORDER if c != "c_mktsegment"], ["c_mktsegment"], CLEAN_ORDER)

DOCS_ORDER = ["n_chars", "lang", "source", "quality"]
DOCS_SIG = signal_ctes(V.doc_features(), _lenient_num("label"), ["n_chars", "quality"], ["lang", "source"],
                       DOCS_ORDER)

SIG_COLS = ["feature", "type", "signal", "tier", "mean_diff", "d", "r", "mi", "cramers_v", "chi2", "dof", "ig",
            "explanation"]
SIG_DOUBLES = {"signal", "mean_diff", "d", "r", "mi", "cramers_v", "chi2", "ig", "p_value"}

for suffix, ctes in (("", RAW_SIG), ("_clean", CLEAN_SIG), ("_docs", DOCS_SIG)):
    SQL[f"sig{suffix}"] = f"WITH {ctes} SELECT {_round6(SIG_COLS, SIG_DOUBLES)} FROM features"
    SQL[f"sig_summary{suffix}"] = f"WITH {ctes} SELECT * FROM summary"


def _sig(cols, kind=None):
    where = f" WHERE type = '{kind}'" if kind else ""
    return f"WITH {RAW_SIG} SELECT {_round6(cols, SIG_DOUBLES)} FROM features{where}"


SQL["sig1"] = f"""WITH cf AS ({V.customer_features()})
SELECT label, CAST(least(count(*), {C.SIGNAL_MAX_ROWS // 2}) AS BIGINT) AS n_rows FROM cf GROUP BY label"""
SQL["sig2"] = f"WITH {RAW_SIG} SELECT * FROM routing"
SQL["sig3"] = _sig(["feature", "d", "mean_diff"], "Numerical")
SQL["sig4"] = _sig(["feature", "r"], "Numerical")
SQL["sig5"] = _sig(["feature", "mi"], "Numerical")
SQL["sig6"] = f"WITH {RAW_SIG} SELECT * FROM contingency"
SQL["sig7"] = _sig(["feature", "cramers_v", "chi2", "dof"], "Categorical")
SQL["sig9"] = _sig(["feature", "ig"], "Categorical")
SQL["sig10"] = (f"WITH {RAW_SIG} SELECT feature, count(*) AS n_values, sum(n_neg + n_pos) AS n_rows "
                f"FROM contingency GROUP BY feature")
SQL["sig18"] = ("SELECT 0 AS overall_score, 'Unknown' AS potential_label, '" + C.SIG_ERR_ONE_CLASS.replace("'", "''") + "' AS error "
                "FROM customer LIMIT 1")
SQL["cln7_unique"] = f"SELECT count(*) AS n_rows, count(*) AS n_ids FROM ({V.customer_raw()}) raw"
SQL["prf18"] = f"SELECT 'Churn' AS target_column, count(*) AS n_rows FROM ({V.customer_raw()}) raw"
SQL["sig11"] = _sig(["feature", "signal"], "Numerical")
SQL["sig12"] = _sig(["feature", "signal"], "Categorical")
SQL["sig13"] = _sig(["feature", "tier"])
SQL["sig14"] = _sig(["feature", "explanation"])
SQL["sig15"] = f"WITH {RAW_SIG} SELECT overall_score, potential_label FROM summary"
SQL["sig16"] = (f"WITH {RAW_SIG} SELECT n_strong, n_medium, n_weak, n_total, top_features, weak_features "
                f"FROM summary")
SQL["sig17"] = f"WITH {RAW_SIG} SELECT explanation FROM summary"

from oracles.metrics_sql import build as _build_metrics  # noqa: E402

SQL.update(_build_metrics())

from oracles.profile_sql import build as _build_profile  # noqa: E402

SQL.update(_build_profile())

from oracles.features_sql import build as _build_features  # noqa: E402

SQL.update(_build_features())

from oracles.features_sql import CF as _CF  # noqa: E402

SQL["trn9"] = f"""WITH {_CF},
sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY
         (CAST(('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 65536),
         md5('42|' || CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR))
         <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM cf)
SELECT count(*) AS n_train, CASE WHEN count(*) > 100000 THEN greatest(10, {C.N_TRIALS // 3})
                                 WHEN count(*) > 50000 THEN greatest(15, {C.N_TRIALS // 2}) ELSE {C.N_TRIALS} END AS n_trials
FROM sp WHERE split = 'train'"""

# sources
_D = {",": "','", ";": "';'", "\t": "chr(9)", "|": "'|'"}
_line = "split_part(text, chr(10), 1)"
_cnt = {d: f"(length({_line}) - length(replace({_line}, {_D[d]}, '')))" for d in _D}
SQL["src2"] = f"""SELECT doc_id, CASE
  WHEN greatest({_cnt[',']}, {_cnt[';']}, {_cnt[chr(9)]}, {_cnt['|']}) = 0 THEN ','
  WHEN {_cnt[',']} >= greatest({_cnt[';']}, {_cnt[chr(9)]}, {_cnt['|']}) THEN ','
  WHEN {_cnt[';']} >= greatest({_cnt[chr(9)]}, {_cnt['|']}) THEN ';'
  WHEN {_cnt[chr(9)]} >= {_cnt['|']} THEN chr(9) ELSE '|' END AS delimiter FROM documents"""
SQL["src5"] = "SELECT count(*) AS n_rows, 5 AS n_cols FROM customer"

from oracles.features_sql import build_prep as _build_prep  # noqa: E402

SQL.update(_build_prep())

# PRF17: id candidates of the raw upload (names are metadata, uniqueness is data)
from oracles.profile_sql import V as _V  # noqa: E402

_RAW_COLS = [("Customer ID", False), ("Churn", True), ("Total Spend", True), ("N-Orders", False),
             ("Acct Bal", False), ("Segment", True), ("nation", True), ("Has Urgent", True), ("has_open", True),
             ("constant_col", True), ("nearly_constant", True), ("email", True), ("row_hash", True),
             ("phone", True), ("account_uuid", True), ("signup_date", True), ("churn_date", True),
             ("mostly_null", False)]


def _prf17() -> str:
    parts = []
    for i, (c, is_str) in enumerate(_RAW_COLS):
        norm = c.lower().replace(" ", "_")
        hint = C.ID_HINTS.index(norm) if norm in C.ID_HINTS else "NULL"
        frag = is_str and any(k in c.lower() for k in C.ID_NAME_FRAGMENTS)
        parts.append(f"""SELECT '{c}' AS "column", {i} AS pos, CAST({hint} AS INTEGER) AS hint_rank,
  count(DISTINCT "{c}") = count(*) AND {str(frag).lower()} AS fallback FROM raw""")
    return f"WITH raw AS ({_V.customer_raw()}) " + " UNION ALL ".join(parts)


SQL["prf17"] = _prf17()

from oracles.features_sql import build_selection as _build_selection  # noqa: E402

SQL.update(_build_selection())

from oracles.features_sql import build_replay as _build_replay  # noqa: E402

SQL.update(_build_replay())

# CLN8: the cleaned upload after dropping id, target and the profiled drops. The conversions
# (numeric strings, boolean words) and the drops are the ones cln2 / prf12 establish on the same data.
from oracles.profile_sql import RAW_NAMES as _RAW_NAMES, bool_map_sql as _bool_map_sql, num_expr as _num_expr  # noqa: E402

SQL["cln8"] = f"""WITH src AS ({_RAW_NAMES})
SELECT {_num_expr('total_spend')} AS total_spend, n_orders, acct_bal, segment, {_num_expr('nation')} AS nation,
       CAST({_bool_map_sql('has_urgent')} AS INT) AS has_urgent, CAST({_bool_map_sql('has_open')} AS INT) AS has_open,
       signup_date
FROM src"""

# --- sources, sinks and slots: the upload is written from a view that SQL knows -------------------
from churnspark.sources.io import MISSING_WORDS  # noqa: E402
from oracles.features_sql import BOOL as _BOOL  # noqa: E402
from oracles.features_sql import NUM as _NUM  # noqa: E402
from oracles.features_sql import _key  # noqa: E402

_MISSING = ", ".join("'" + w.replace("'", "''") + "'" for w in ["", *MISSING_WORDS])


def _field(c: str, kind: str | None = None) -> str:
    """A text field after the round trip through the file: trimmed, words for missing values as null."""
    x = f"CASE WHEN trim(\"{c}\") NOT IN ({_MISSING}) THEN trim(\"{c}\") END"
    return f'CAST({x} AS {kind}) AS "{c}"' if kind else f'{x} AS "{c}"'


SQL["src1"] = f"""SELECT "Customer ID", {_field('Churn')}, {_field('Total Spend')}, "N-Orders", "Acct Bal", {_field('Segment')}, {_field('nation', 'BIGINT')},
       {_field('Has Urgent')}, {_field('has_open')}, {_field('constant_col')}, {_field('nearly_constant')}, {_field('email')}, {_field('row_hash')},
       {_field('phone')}, {_field('account_uuid')}, {_field('signup_date', 'DATE')}, {_field('churn_date', 'DATE')}, "mostly_null"
FROM ({V.customer_raw()}) raw"""
SQL["src3"] = f"SELECT 'Zürich' AS city, count(*) AS n FROM ({V.customer_raw()}) raw"
SQL["src4"] = f"SELECT 'Customer ID' AS first_column, count(*) AS n_rows FROM ({V.customer_raw()}) raw"
SQL["snk1"] = f"""SELECT a.model, CAST(a.customer_id AS VARCHAR) AS customer_id, churn_prediction, CAST(churn_probability AS VARCHAR) AS churn_probability,
       risk_level FROM ({SQL['scr2']}) a JOIN ({SQL['scr3']}) b ON b.model = a.model AND b.customer_id = a.customer_id"""
_B, _H = _key("c_custkey", "42|")
SQL["pre5"] = f"""WITH {_CF},
sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_B}, {_H}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split FROM cf),
tr AS (SELECT * FROM sp WHERE split = 'train'),
md AS (SELECT c_mktsegment AS mode FROM tr WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ct AS (SELECT coalesce(c_mktsegment, (SELECT mode FROM md)) AS v, count(*) AS n FROM tr GROUP BY 1),
kp AS (SELECT v, n, n >= (SELECT sum(n) FROM ct) * {C.OHE_MIN_FREQUENCY} AS ok, row_number() OVER (ORDER BY n DESC, v) AS rk FROM ct),
sl AS (SELECT CASE WHEN bool_and(ok) AND count(*) <= {C.OHE_MAX_CATEGORIES} THEN count(*)
                   ELSE least(count(*) FILTER (WHERE ok), {C.OHE_MAX_CATEGORIES - 1}) + 1 END AS k FROM kp)
SELECT c_custkey, CAST({len(_NUM) + len(_BOOL)} + (SELECT k FROM sl) AS INT) AS n_slots FROM cf"""


def _json_list(c: str) -> str:
    return f"""CASE WHEN len({c}) > 0 THEN '["' || array_to_string({c}, '", "') || '"]' ELSE '[]' END"""


SQL["snk2"] = f"""SELECT '{{"error": ' || coalesce('"' || error || '"', 'null') || ', "explanation": "' || replace(explanation, '—', '\\u2014')
       || '", "n_medium": ' || n_medium || ', "n_strong": ' || n_strong || ', "n_total": ' || n_total || ', "n_weak": ' || n_weak
       || ', "overall_score": ' || overall_score || ', "potential_label": "' || potential_label || '", "top_features": ' || {_json_list('top_features')}
       || ', "weak_features": ' || {_json_list('weak_features')} || '}}' AS value FROM ({SQL['sig_summary_clean']}) summary"""
