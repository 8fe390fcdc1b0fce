"""DuckDB oracle for the signal assessment (written independently of the Spark plan:
plain GROUP BY / window SQL over a UNION ALL unpivot)."""

from __future__ import annotations

from churnspark import config as C
from churnspark.functions.chi2 import chi2_isf
from oracles.text_sql import fill_sql

MAX_DOF = 64


def _crit_values() -> str:
    rows = []
    for dof in range(1, MAX_DOF + 1):
        rows.append(f"({dof}, {chi2_isf(0.001, dof)!r}, {chi2_isf(0.01, dof)!r}, {chi2_isf(0.05, dof)!r})")
    return "VALUES " + ", ".join(rows)


def initcap_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def signal_ctes(source_sql: str, target: str, numeric: list[str], strings: list[str],
                order: list[str]) -> str:
    """CTE chain ending in ``features``, ``routing``, ``contingency`` and ``summary``.

    ``source_sql`` yields cleaned column names; ``target`` is a lenient-target SQL expression.
    ``order``: all feature columns in frame order (for positions).
    """
    pos = {c: i for i, c in enumerate(order)}
    num_union = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, {pos[c]} AS pos, CAST(\"{c}\" AS DOUBLE) AS x, y FROM base "
        f"WHERE \"{c}\" IS NOT NULL AND NOT isnan(CAST(\"{c}\" AS DOUBLE))" for c in numeric) or \
        "SELECT NULL::VARCHAR AS feature, NULL::INT AS pos, NULL::DOUBLE AS x, NULL::INT AS y WHERE false"
    cat_union = "\n  UNION ALL ".join(
        [f"SELECT '{c}' AS feature, {pos[c]} AS pos, CAST(\"{c}\" AS VARCHAR) AS value, y FROM base "
         f"WHERE \"{c}\" IS NOT NULL" for c in strings]
        + [f"SELECT '{c}' AS feature, {pos[c]} AS pos, CAST(\"{c}\" AS VARCHAR) AS value, y FROM base "
           f"WHERE \"{c}\" IS NOT NULL AND NOT isnan(CAST(\"{c}\" AS DOUBLE)) "
           f"AND '{c}' IN (SELECT feature FROM mom WHERE nd <= 2 AND n_valid >= {C.SIGNAL_MIN_VALID})"
           for c in numeric]) or \
        "SELECT NULL::VARCHAR AS feature, NULL::INT AS pos, NULL::VARCHAR AS value, NULL::INT AS y WHERE false"
    label = initcap_sql("trim(replace(feature, '_', ' '))")
    low = f"lower({label})"
    return f"""
src AS ({source_sql}),
base AS (SELECT *, {target} AS y FROM src WHERE {target} IS NOT NULL),
num_long AS ({num_union}),
mom AS (
  SELECT feature, pos, count(*) AS n_valid,
         count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
         avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1,
         var_samp(x) FILTER (WHERE y = 0) AS v0, var_samp(x) FILTER (WHERE y = 1) AS v1,
         corr(x, CAST(y AS DOUBLE)) AS cr, min(x) AS mn, max(x) AS mx, count(DISTINCT x) AS nd
  FROM num_long GROUP BY feature, pos),
nbins AS (
  SELECT l.feature,
         CAST(CASE WHEN m.mx > m.mn THEN least(floor((l.x - m.mn) / (m.mx - m.mn) * 16), 15) ELSE 0 END AS INT) AS bin,
         count(*) FILTER (WHERE l.y = 0) AS n_neg, count(*) FILTER (WHERE l.y = 1) AS n_pos
  FROM num_long l JOIN mom m ON l.feature = m.feature GROUP BY 1, 2),
nbt AS (SELECT feature, sum(n_neg) AS t0, sum(n_pos) AS t1, count(*) AS b_nonempty FROM nbins GROUP BY feature),
nmi AS (
  SELECT b.feature,
         sum(CASE WHEN b.n_neg > 0 THEN (b.n_neg / (t.t0 + t.t1)) * ln(b.n_neg * (t.t0 + t.t1) / ((b.n_neg + b.n_pos) * t.t0)) ELSE 0 END
           + CASE WHEN b.n_pos > 0 THEN (b.n_pos / (t.t0 + t.t1)) * ln(b.n_pos * (t.t0 + t.t1) / ((b.n_neg + b.n_pos) * t.t1)) ELSE 0 END) AS mi_raw
  FROM nbins b JOIN nbt t ON b.feature = t.feature GROUP BY b.feature),
num AS (
  SELECT m.feature, m.pos, m.n_valid, m.n0, m.n1, m.nd,
         CASE WHEN m.n1 < 2 OR m.n0 < 2 THEN 0.0
              WHEN ((m.n1 - 1) * m.v1 + (m.n0 - 1) * m.v0) / (m.n1 + m.n0 - 2) <= 0 THEN 0.0
              ELSE abs(m.m1 - m.m0) / sqrt(((m.n1 - 1) * m.v1 + (m.n0 - 1) * m.v0) / (m.n1 + m.n0 - 2)) END AS d,
         CASE WHEN m.cr IS NULL OR isnan(m.cr) THEN 0.0 ELSE abs(m.cr) END AS r,
         greatest(0.0, i.mi_raw - (t.b_nonempty - 1) * (CAST(t.t0 > 0 AS INT) + CAST(t.t1 > 0 AS INT) - 1)
                                  / (2.0 * m.n_valid)) AS mi,
         m.m1 - m.m0 AS mean_diff
  FROM mom m JOIN nmi i ON m.feature = i.feature JOIN nbt t ON m.feature = t.feature),
cat_long AS ({cat_union}),
vf AS (
  SELECT feature, pos, value, count(*) FILTER (WHERE y = 0) AS n_neg, count(*) FILTER (WHERE y = 1) AS n_pos,
         count(*) AS cnt
  FROM cat_long GROUP BY feature, pos, value),
vper AS (SELECT feature, count(*) AS n_distinct, sum(cnt) AS n_all FROM vf GROUP BY feature),
vranked AS (SELECT vf.*, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value ASC) AS rn FROM vf),
capped AS (
  SELECT r.*, p.n_distinct, p.n_all FROM vranked r JOIN vper p ON r.feature = p.feature
  WHERE p.n_distinct <= {C.SIGNAL_MAX_CATS} OR r.rn <= {C.SIGNAL_TOP_CATS}),
ctot AS (
  SELECT feature, pos, sum(n_neg) AS t0, sum(n_pos) AS t1, count(*) AS n_rows,
         any_value(n_distinct) AS n_distinct, any_value(n_all) AS n_all,
         sum(n_neg) + sum(n_pos) AS n,
         CAST(sum(n_neg) > 0 AS INT) + CAST(sum(n_pos) > 0 AS INT) AS k
  FROM capped GROUP BY feature, pos),
ccells AS (
  SELECT c.feature, c.n_neg, c.n_pos, c.cnt, t.t0, t.t1, t.n, (t.n_rows - 1) * (t.k - 1) AS dof,
         CAST(c.cnt AS DOUBLE) * t.t0 / t.n AS e0, CAST(c.cnt AS DOUBLE) * t.t1 / t.n AS e1
  FROM capped c JOIN ctot t ON c.feature = t.feature),
cchi AS (
  SELECT feature,
    sum(CASE WHEN t0 > 0 THEN power(CASE WHEN dof = 1 THEN abs(n_neg - e0) - least(0.5, abs(n_neg - e0))
                                         ELSE abs(n_neg - e0) END, 2) / e0 ELSE 0 END
      + CASE WHEN t1 > 0 THEN power(CASE WHEN dof = 1 THEN abs(n_pos - e1) - least(0.5, abs(n_pos - e1))
                                         ELSE abs(n_pos - e1) END, 2) / e1 ELSE 0 END) AS chi2_raw,
    sum(CASE WHEN n_neg > 0 THEN (n_neg / n) * ln(n_neg * n / (cnt * t0)) ELSE 0 END
      + CASE WHEN n_pos > 0 THEN (n_pos / n) * ln(n_pos * n / (cnt * t1)) ELSE 0 END) AS mi_nats
  FROM ccells GROUP BY feature),
crit(dof, c001, c01, c05) AS ({_crit_values()}),
cat0 AS (
  SELECT t.feature, t.pos, t.n_distinct, t.n_all, t.n_rows, t.t0, t.t1, t.n, t.k,
         CAST((t.n_rows - 1) * (t.k - 1) AS INT) AS dof,
         CASE WHEN (t.n_rows - 1) * (t.k - 1) > 0 THEN x.chi2_raw ELSE 0.0 END AS chi2, x.mi_nats
  FROM ctot t JOIN cchi x ON t.feature = x.feature),
cat1 AS (
  SELECT c.*,
    CASE WHEN least(c.k - (c.k - 1) * (c.k - 1) / (c.n - 1.0), c.n_rows - (c.n_rows - 1) * (c.n_rows - 1) / (c.n - 1.0)) - 1 > 0
         THEN sqrt(greatest(0.0, c.chi2 / c.n - (c.k - 1) * (c.n_rows - 1) / (c.n - 1.0))
                   / (least(c.k - (c.k - 1) * (c.k - 1) / (c.n - 1.0), c.n_rows - (c.n_rows - 1) * (c.n_rows - 1) / (c.n - 1.0)) - 1))
         ELSE 0.0 END AS cramers_v,
    c.mi_nats / (-(c.t1 / c.n) * log2(c.t1 / c.n + 1e-9) - (1 - c.t1 / c.n) * log2(1 - c.t1 / c.n + 1e-9) + 1e-9) AS ig,
    CASE WHEN c.dof = 0 THEN 0.0 WHEN c.chi2 > k.c001 THEN 1.0 WHEN c.chi2 > k.c01 THEN 0.7
         WHEN c.chi2 > k.c05 THEN 0.4 ELSE 0.0 END AS bonus
  FROM cat0 c LEFT JOIN crit k ON c.dof = k.dof),
frows AS (
  SELECT feature, pos, 'Numerical' AS type, CAST(n_valid AS BIGINT) AS n_valid, 0 AS n_categories,
         least(greatest(0.40 * least(d / 2.0, 1.0) + 0.35 * least(r, 1.0) + 0.25 * least(mi, 1.0), 0.0), 1.0) AS signal,
         mean_diff, d, r, mi, NULL::DOUBLE AS cramers_v, NULL::DOUBLE AS chi2, NULL::INT AS dof, NULL::DOUBLE AS ig
  FROM num WHERE n_valid >= {C.SIGNAL_MIN_VALID} AND nd > 2 AND n0 >= {C.SIGNAL_MIN_CLASS} AND n1 >= {C.SIGNAL_MIN_CLASS}
  UNION ALL
  SELECT feature, pos, 'Categorical', CAST(n_all AS BIGINT),
         CAST(CASE WHEN n_distinct > {C.SIGNAL_MAX_CATS} THEN {C.SIGNAL_TOP_CATS} ELSE n_distinct END AS INT),
         least(greatest(0.45 * least(cramers_v, 1.0) + 0.40 * least(ig, 1.0) + 0.15 * bonus, 0.0), 1.0),
         0.0, NULL, NULL, NULL, cramers_v, chi2, dof, ig
  FROM cat1 WHERE n_all >= {C.SIGNAL_MIN_VALID}),
ftier AS (
  SELECT *, CASE WHEN signal >= {C.SIGNAL_STRONG} THEN 'Strong' WHEN signal >= {C.SIGNAL_MEDIUM} THEN 'Medium'
                 ELSE 'Weak' END AS tier FROM frows),
features AS (
  SELECT *,
    CASE WHEN tier = 'Weak' THEN {fill_sql(C.SIG_WEAK, label=label)}
         WHEN type = 'Numerical' AND tier = 'Strong' AND mean_diff > 0 THEN {fill_sql(C.SIG_NUM_STRONG_UP, low=low)}
         WHEN type = 'Numerical' AND tier = 'Strong' THEN {fill_sql(C.SIG_NUM_STRONG_DOWN, low=low)}
         WHEN type = 'Numerical' AND mean_diff > 0 THEN {fill_sql(C.SIG_NUM_MEDIUM_UP, low=low)}
         WHEN type = 'Numerical' THEN {fill_sql(C.SIG_NUM_MEDIUM_DOWN, low=low)}
         WHEN tier = 'Strong' AND n_categories = 2 THEN {fill_sql(C.SIG_CAT_STRONG_TWO, low=low)}
         WHEN tier = 'Strong' THEN {fill_sql(C.SIG_CAT_STRONG, low=low)}
         WHEN n_categories = 2 THEN {fill_sql(C.SIG_CAT_MEDIUM_TWO, low=low)}
         ELSE {fill_sql(C.SIG_CAT_MEDIUM, low=low)} END
      AS explanation
  FROM ftier),
routing AS (
  SELECT feature, 'numeric' AS dtype_kind, CAST(n_valid AS BIGINT) AS n_valid, CAST(n0 AS BIGINT) AS n_neg,
         CAST(n1 AS BIGINT) AS n_pos,
         CASE WHEN n_valid < {C.SIGNAL_MIN_VALID} THEN 'skip: fewer than 30 values'
              WHEN nd <= 2 THEN 'categorical'
              WHEN n0 < {C.SIGNAL_MIN_CLASS} OR n1 < {C.SIGNAL_MIN_CLASS} THEN 'skip: a class has fewer than 5 rows'
              ELSE 'numeric' END AS route
  FROM mom
  UNION ALL
  SELECT feature, 'string', CAST(n_all AS BIGINT), CAST(t0 AS BIGINT), CAST(t1 AS BIGINT),
         CASE WHEN n_all < {C.SIGNAL_MIN_VALID} THEN 'skip: fewer than 30 values' ELSE 'categorical' END
  FROM ctot WHERE feature NOT IN (SELECT feature FROM mom)),
contingency AS (SELECT feature, value, n_neg, n_pos FROM capped),
franked AS (SELECT *, row_number() OVER (ORDER BY signal DESC, pos ASC) AS rnk FROM features),
sagg AS (
  SELECT count(*) AS n_total, count(*) FILTER (WHERE tier = 'Strong') AS n_strong,
         count(*) FILTER (WHERE tier = 'Medium') AS n_medium, count(*) FILTER (WHERE tier = 'Weak') AS n_weak,
         coalesce(list(feature ORDER BY rnk) FILTER (WHERE rnk <= 10), []) AS top_features,
         coalesce(list(feature ORDER BY rnk) FILTER (WHERE tier = 'Weak'), []) AS weak_features,
         any_value(feature) FILTER (WHERE rnk = 1) AS top_name
  FROM franked),
sraw AS (
  SELECT s.*, (SELECT avg(signal) FROM franked WHERE rnk <= greatest(1, floor(s.n_total * {C.SIGNAL_TOP_SHARE}))) AS raw
  FROM sagg s),
sscore AS (
  SELECT *, CAST(floor(least(greatest((raw + least(n_strong / greatest(n_total, 1) * 0.3, 0.3)) * 100, 0.0), 100.0)) AS INT)
            AS overall_score FROM sraw),
slabel AS (
  SELECT *, CASE WHEN overall_score >= {C.SIGNAL_HIGH} THEN 'High' WHEN overall_score >= {C.SIGNAL_MEDIUM_SCORE} THEN 'Medium'
                 ELSE 'Low' END AS potential_label,
         CAST(CAST(round_even(n_strong / greatest(n_total, 1) * 100.0, 0) AS BIGINT) AS VARCHAR) AS pct
  FROM sscore),
summary AS (
  SELECT overall_score, potential_label, n_strong, n_medium, n_weak, n_total, top_features, weak_features,
    CASE WHEN potential_label = 'High' THEN {fill_sql(C.SIG_HIGH_TEXT, n_strong='n_strong', n_total='n_total', pct='pct', top='top_name')}
         WHEN potential_label = 'Medium' THEN {fill_sql(C.SIG_MEDIUM_TEXT, n_strong='n_strong', n_medium='n_medium', n_weak='n_weak', top='top_name')}
         ELSE {fill_sql(C.SIG_LOW_TEXT, n_strong='n_strong', n_total='n_total', top='top_name')} END
    || CASE WHEN n_weak > n_total * 0.5 THEN {fill_sql(C.SIG_WEAK_NOTE, n_weak='n_weak')} ELSE '' END AS explanation,
    NULL::VARCHAR AS error
  FROM slabel)"""
