"""DuckDB oracles for feature engineering and the split family."""

from __future__ import annotations

from churnspark import config as C
from oracles import fixtures_sql as V
from oracles.neighbours_sql import neighbour_mi_sql

NUM = ["c_nationkey", "c_acctbal", "n_orders", "total_spend", "avg_spend", "max_spend", "n_open", "n_final",
       "n_urgent", "tenure_days"]
BOOL = ["has_urgent", "has_open", "has_big"]
CF = f"cf AS ({V.customer_features()})"


def _short(expr: str) -> str:
    return f"substr(replace(replace(replace(lower({expr}), ' ', ''), '-', ''), '_', ''), 1, {C.SHORT_NAME_LEN})"


LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{c}' AS col, {i} AS pos, CAST({c} AS DOUBLE) AS x FROM cf" for i, c in enumerate(NUM)) + ")"
STATS = """st AS (SELECT col, pos, count(x) AS n, min(x) AS mn, var_samp(x) AS v, skewness(x) AS sk FROM lg GROUP BY col, pos),
el AS (SELECT *, row_number() OVER (ORDER BY v DESC, pos) AS rk FROM st WHERE mn >= 0 AND sqrt(v) > 0)"""
PAIRS = f"""pairs AS (SELECT a.col AS ca, b.col AS cb,
                 'feat_ratio_' || {_short('a.col')} || '_' || {_short('b.col')} AS name
          FROM el a JOIN el b ON a.rk < b.rk WHERE a.rk <= {C.MAX_RATIO_COLS} AND b.rk <= {C.MAX_RATIO_COLS})"""
LOGS = f"""logs AS (SELECT col, 'feat_' || col || '_log' AS name FROM st
         WHERE n > 2 AND abs(sk) > {C.SKEW_LOG_LIMIT} AND mn >= 0)"""
RATIO_VALUES = """rv AS (SELECT a.c_custkey, p.name AS feature, coalesce(a.x / nullif(b.x, 0), 0.0) AS value
       FROM pairs p JOIN lg a ON a.col = p.ca JOIN lg b ON b.col = p.cb AND a.c_custkey = b.c_custkey)"""
LOG_VALUES = """lv AS (SELECT a.c_custkey, l.name AS feature, ln(1 + coalesce(a.x, 0.0)) AS value
       FROM logs l JOIN lg a ON a.col = l.col)"""
SERVICES = "sv AS (SELECT c_custkey, " + " + ".join(f"coalesce(CAST({b} AS DOUBLE), 0.0)" for b in BOOL) + \
    " AS feat_n_active_services FROM cf)"


def _key(expr: str, salt: str) -> tuple[str, str]:
    h = f"md5('{salt}' || CAST({expr} AS VARCHAR))"
    b = f"(CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) % 65536)"
    return b, h


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    base = f"WITH {CF}, {LONG}, {STATS}"
    q["fea1"] = (f"{base} SELECT st.col AS \"column\", round(st.v, 6) AS variance, round(st.mn, 6) AS min, "
                 f"coalesce(st.mn >= 0 AND sqrt(st.v) > 0, false) AS ratio_eligible, el.rk AS variance_rank "
                 f"FROM st LEFT JOIN el ON st.col = el.col")
    q["fea2"] = f"{base}, {PAIRS}, {RATIO_VALUES} SELECT c_custkey, feature, value FROM rv"
    q["fea3"] = f"{base}, {LOGS}, {LOG_VALUES} SELECT c_custkey, feature, round(value, 6) AS value FROM lv"
    q["fea4"] = f"WITH {CF}, {SERVICES} SELECT c_custkey, round(feat_n_active_services, 6) AS feat_n_active_services FROM sv"
    q["fea5"] = f"""{base}, {PAIRS}, {LOGS}, {RATIO_VALUES}, {LOG_VALUES}, {SERVICES},
allv AS (SELECT * FROM rv UNION ALL SELECT * FROM lv
         UNION ALL SELECT c_custkey, 'feat_n_active_services', feat_n_active_services FROM sv)
SELECT feature, min(value) < max(value) AS kept FROM allv GROUP BY feature"""
    b, h = _key("c_custkey", "42|")
    split = f"""sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split
       FROM cf)"""
    q["spl1"] = f"WITH {CF}, {split} SELECT c_custkey, label, split FROM sp"
    q["spl2"] = (f"WITH {CF} SELECT c_custkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, "
                 f"CAST(c_custkey AS VARCHAR)) - 1) % {C.CV_FOLDS} AS INT) AS fold FROM cf")
    b2, h2 = _key("c_custkey", "42|cal|")
    q["spl3"] = f"""WITH {CF}, {split}, tr AS (SELECT * FROM sp WHERE split = 'train')
SELECT c_custkey, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b2}, {h2}, CAST(c_custkey AS VARCHAR))
                               <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END
       AS cal_split FROM tr"""
    q["spl4"] = f"WITH {CF} SELECT c_custkey FROM cf ORDER BY {h}, CAST(c_custkey AS VARCHAR) LIMIT 300"
    q["set1"] = (f"WITH {CF}, {split} SELECT c_custkey, label FROM sp WHERE split = 'train' "
                 f"UNION ALL SELECT c_custkey, label FROM sp WHERE split = 'test'")
    q["set2"] = (f"WITH {CF} SELECT c_custkey, n_orders, c_acctbal, c_mktsegment, tenure_days, "
                 f"NULL::DOUBLE AS support_calls FROM cf")
    return q


def build_prep() -> dict[str, str]:
    q: dict[str, str] = {}
    b, h = _key("c_custkey", "42|")
    split = f"""sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split
       FROM cf), tr AS (SELECT * FROM sp WHERE split = 'train')"""
    cols = NUM + BOOL
    med = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", median(CAST({c} AS DOUBLE)) AS median FROM tr" for c in cols)
    q["pre1"] = f"WITH {CF}, {split}, m AS ({med}) SELECT \"column\", round(median, 6) AS median FROM m"
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS col, avg(coalesce(CAST({c} AS DOUBLE), md)) AS mu, stddev_pop(coalesce(CAST({c} AS DOUBLE), md)) AS sd, "
        f"any_value(md) AS md FROM tr, (SELECT median(CAST({c} AS DOUBLE)) AS md FROM tr) x" for c in cols)
    vals = " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM sp" for c in cols)
    q["pre2"] = f"""WITH {CF}, {split}, st AS ({stats}), v AS ({vals})
SELECT v.c_custkey, 'num__' || v.col AS feature,
       round((coalesce(v.x, st.md) - st.mu) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1.0 END, 6) AS value
FROM v JOIN st ON v.col = st.col"""
    mode = """md AS (SELECT c_mktsegment AS m FROM tr WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
                ORDER BY count(*) DESC, c_mktsegment ASC LIMIT 1)"""
    q["pre3"] = f"WITH {CF}, {split}, {mode} SELECT 'c_mktsegment' AS \"column\", m AS mode FROM md"
    q["pre4"] = f"""WITH {CF}, {split}, {mode},
cnt AS (SELECT coalesce(c_mktsegment, (SELECT m FROM md)) AS v, count(*) AS n FROM tr GROUP BY 1),
tot AS (SELECT sum(n) AS n FROM cnt),
fr AS (SELECT v, n >= (SELECT n FROM tot) * {C.OHE_MIN_FREQUENCY} AS freq,
              row_number() OVER (ORDER BY n DESC, v ASC) AS rk FROM cnt),
lim AS (SELECT CASE WHEN count(*) FILTER (WHERE freq) < count(*) OR count(*) FILTER (WHERE freq) > {C.OHE_MAX_CATEGORIES}
                    THEN {C.OHE_MAX_CATEGORIES - 1} ELSE {C.OHE_MAX_CATEGORIES} END AS k,
               count(*) FILTER (WHERE freq) < count(*) OR count(*) FILTER (WHERE freq) > {C.OHE_MAX_CATEGORIES} AS has_inf FROM fr),
kept AS (SELECT v FROM fr, lim WHERE freq AND rk <= k),
rare AS (SELECT v FROM fr WHERE v NOT IN (SELECT v FROM kept))
SELECT c_custkey, CASE WHEN coalesce(c_mktsegment, (SELECT m FROM md)) IN (SELECT v FROM kept)
                       THEN 'cat__c_mktsegment_' || coalesce(c_mktsegment, (SELECT m FROM md))
                       ELSE 'cat__c_mktsegment_infrequent_sklearn' END AS feature, 1.0 AS value
FROM sp WHERE coalesce(c_mktsegment, (SELECT m FROM md)) IN (SELECT v FROM kept)
   OR coalesce(c_mktsegment, (SELECT m FROM md)) IN (SELECT v FROM rare)"""
    q["pre6"] = f"""WITH {CF}, {split}, c AS (SELECT label, count(*) AS n_c FROM tr GROUP BY label)
SELECT label, n_c, round(sum(n_c) OVER () / (2.0 * n_c), 6) AS balanced_weight FROM c"""
    q["pre7"] = f"""WITH {CF}, {split}, c AS (SELECT label, count(*) AS n_c FROM tr GROUP BY label)
SELECT label, round(CASE WHEN sum(n_c) FILTER (WHERE label = 1) OVER () > 0
                    THEN round(sum(n_c) FILTER (WHERE label = 0) OVER () / sum(n_c) FILTER (WHERE label = 1) OVER (), 2)
                    ELSE 1.0 END, 6) AS scale_pos_weight FROM c"""
    return q


def build_selection() -> dict[str, str]:
    """FEA6 / FEA7 on the training part, candidates as in fea1-fea5."""
    q: dict[str, str] = {}
    b, h = _key("c_custkey", "42|")
    pairs_n = f"""pairs AS (SELECT a.col AS ca, b.col AS cb,
                 'feat_ratio_' || {_short('a.col')} || '_' || {_short('b.col')} AS name,
                 row_number() OVER (ORDER BY a.rk, b.rk) AS pn
          FROM el a JOIN el b ON a.rk < b.rk WHERE a.rk <= {C.MAX_RATIO_COLS} AND b.rk <= {C.MAX_RATIO_COLS})"""
    body = f"""WITH {CF}, {LONG}, {STATS}, {pairs_n}, {LOGS},
rv AS (SELECT a.c_custkey, p.name AS feature, p.pn AS ord, coalesce(a.x / nullif(b.x, 0), 0.0) AS value
       FROM pairs p JOIN lg a ON a.col = p.ca JOIN lg b ON b.col = p.cb AND a.c_custkey = b.c_custkey),
lv AS (SELECT a.c_custkey, l.name AS feature, 100 + s.pos AS ord, ln(1 + coalesce(a.x, 0.0)) AS value
       FROM logs l JOIN lg a ON a.col = l.col JOIN st s ON s.col = l.col),
{SERVICES},
allv AS (SELECT * FROM rv UNION ALL SELECT * FROM lv
         UNION ALL SELECT c_custkey, 'feat_n_active_services', 1000, feat_n_active_services FROM sv),
kept AS (SELECT feature FROM allv GROUP BY feature HAVING min(value) < max(value)),
sp AS (SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split,
              label FROM cf),
tv AS (SELECT allv.*, sp.label FROM allv JOIN sp ON allv.c_custkey = sp.c_custkey
       WHERE sp.split = 'train' AND allv.feature IN (SELECT feature FROM kept))"""
    q["fea6"] = f"""{body},
fo AS (SELECT feature, any_value(ord) AS ord, var_samp(value) AS v FROM tv GROUP BY feature),
pc AS (SELECT a.feature AS fa, b.feature AS fb, corr(a.value, b.value) AS r
       FROM tv a JOIN tv b ON a.c_custkey = b.c_custkey JOIN fo oa ON oa.feature = a.feature
       JOIN fo ob ON ob.feature = b.feature WHERE oa.ord < ob.ord GROUP BY 1, 2),
losers AS (SELECT CASE WHEN ob.v < oa.v THEN pc.fb ELSE pc.fa END AS loser
           FROM pc JOIN fo oa ON pc.fa = oa.feature JOIN fo ob ON pc.fb = ob.feature
           WHERE NOT isnan(pc.r) AND abs(pc.r) > {C.CORR_DEDUP_LIMIT})
SELECT feature, feature IN (SELECT loser FROM losers) AS dropped FROM fo"""
    q["fea7"] = f"""{body},
rg AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM tv GROUP BY feature),
cells AS (SELECT t.feature,
            CAST(CASE WHEN r.mx > r.mn THEN least(floor((t.value - r.mn) / (r.mx - r.mn) * 16), 15) ELSE 0 END AS INT) AS bin,
            count(*) FILTER (WHERE t.label = 0) AS c0, count(*) FILTER (WHERE t.label = 1) AS c1
          FROM tv t JOIN rg r ON t.feature = r.feature GROUP BY 1, 2),
tot AS (SELECT feature, sum(c0) AS t0, sum(c1) AS t1, count(*) AS nb FROM cells GROUP BY feature),
mi AS (SELECT c.feature,
         sum(CASE WHEN c.c0 > 0 THEN (c.c0 / (t.t0 + t.t1)) * ln(c.c0 * (t.t0 + t.t1) / ((c.c0 + c.c1) * t.t0)) ELSE 0 END
           + CASE WHEN c.c1 > 0 THEN (c.c1 / (t.t0 + t.t1)) * ln(c.c1 * (t.t0 + t.t1) / ((c.c0 + c.c1) * t.t1)) ELSE 0 END) AS raw,
         any_value(t.nb) AS nb, any_value(t.t0) AS t0, any_value(t.t1) AS t1
       FROM cells c JOIN tot t ON c.feature = t.feature GROUP BY c.feature)
SELECT feature, round(greatest(0.0, raw - (nb - 1) * (CAST(t0 > 0 AS INT) + CAST(t1 > 0 AS INT) - 1)
                                      / (2.0 * (t0 + t1))), 6) AS mi FROM mi"""
    q["fea7_neighbours"] = f"""{body},
nl AS (SELECT feature, CAST(c_custkey AS VARCHAR) AS key, CAST(label AS INT) AS y, coalesce(value, 0.0) AS x FROM tv),
{neighbour_mi_sql('nl')}
SELECT feature, round(mi, 6) AS mi FROM nmi"""
    q["sig5_neighbours"] = f"""WITH {CF}, {LONG},
nl AS (SELECT lg.col AS feature, CAST(lg.c_custkey AS VARCHAR) AS key, CAST(cf.label AS INT) AS y, x
       FROM lg JOIN cf ON cf.c_custkey = lg.c_custkey WHERE x IS NOT NULL AND NOT isnan(x)),
{neighbour_mi_sql('nl')}
SELECT feature, round(mi, 6) AS mi FROM nmi"""
    seg = "coalesce(c_mktsegment, (SELECT mode FROM md))"
    q["trn5_ordered"] = f"""WITH {CF},
sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split FROM cf),
tr AS (SELECT * FROM sp WHERE split = 'train'),
md AS (SELECT c_mktsegment AS mode FROM tr WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w AS (SELECT c_custkey, label, count(*) OVER o - 1 AS n, sum(label) OVER o - label AS s FROM tr
      WINDOW o AS (PARTITION BY {seg} ORDER BY {_key('c_custkey', '42|order|')[0]}, {_key('c_custkey', '42|order|')[1]}
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c_custkey, round((s + (SELECT avg(label) FROM tr)) / (n + 1.0), 6) AS te__c_mktsegment FROM w"""
    return q


def build_replay() -> dict[str, str]:
    """FEA8: candidates decided on the training part, replayed on the test part."""
    b, h = _key("c_custkey", "42|")
    split = f"""sp AS (SELECT cf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {b}, {h}, CAST(c_custkey AS VARCHAR))
                          <= floor(count(*) OVER (PARTITION BY label) * {C.TEST_SIZE} + 0.5) THEN 'test' ELSE 'train' END AS split
       FROM cf)"""
    lg_all = "lga AS (" + " UNION ALL ".join(
        f"SELECT c_custkey, split, '{c}' AS col, {i} AS pos, CAST({c} AS DOUBLE) AS x FROM sp"
        for i, c in enumerate(NUM)) + ")"
    stats = """st AS (SELECT col, pos, count(x) AS n, min(x) AS mn, var_samp(x) AS v, skewness(x) AS sk
                FROM lga WHERE split = 'train' GROUP BY col, pos),
el AS (SELECT *, row_number() OVER (ORDER BY v DESC, pos) AS rk FROM st WHERE mn >= 0 AND sqrt(v) > 0)"""
    services = "sva AS (SELECT c_custkey, split, " + " + ".join(
        f"coalesce(CAST({x} AS DOUBLE), 0.0)" for x in BOOL) + " AS value FROM sp)"
    return {"fea8": f"""WITH {CF}, {split}, {lg_all}, {stats}, {PAIRS}, {LOGS}, {services},
allv AS (SELECT a.c_custkey, a.split, p.name AS feature, coalesce(a.x / nullif(b2.x, 0), 0.0) AS value
         FROM pairs p JOIN lga a ON a.col = p.ca JOIN lga b2 ON b2.col = p.cb AND a.c_custkey = b2.c_custkey
         UNION ALL
         SELECT a.c_custkey, a.split, l.name, ln(1 + coalesce(a.x, 0.0)) FROM logs l JOIN lga a ON a.col = l.col
         UNION ALL
         SELECT c_custkey, split, 'feat_n_active_services', value FROM sva),
kept AS (SELECT feature FROM allv WHERE split = 'train' GROUP BY feature HAVING min(value) < max(value))
SELECT c_custkey, feature, CASE WHEN suffix(feature, '_log') THEN round(value, 6) ELSE value END AS value FROM allv
WHERE split = 'test' AND feature IN (SELECT feature FROM kept)"""}
