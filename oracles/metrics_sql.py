"""DuckDB oracles for evaluation and scoring, over the scored view.

Written the plain way: global windows, a cross join with the threshold grid.
"""

from __future__ import annotations

from churnspark import config as C
from oracles import fixtures_sql as V

S = f"s AS ({V.scored()})"
GRID = "grid(threshold) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in C.THRESHOLDS) + ")"


SCORE_TABLE = """
g AS (SELECT model, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
      FROM s GROUP BY model, p),
st AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
              sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
              sum(pos) OVER (PARTITION BY model) AS tot_pos, sum(neg) OVER (PARTITION BY model) AS tot_neg
       FROM g)"""

RANK = f"""{SCORE_TABLE},
rk AS (SELECT model,
         CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0
              THEN sum(pos * (CAST(tot_neg AS DOUBLE) - cum_neg + neg / 2.0)) / (CAST(max(tot_pos) AS DOUBLE) * max(tot_neg)) END AS roc_auc,
         CASE WHEN max(tot_pos) > 0 THEN sum((pos / CAST(tot_pos AS DOUBLE)) * cum_pos / (cum_pos + cum_neg)) END AS pr_auc
       FROM st GROUP BY model)"""

CM = """cm AS (SELECT model, count(*) FILTER (WHERE p > 0.5 AND label = 1) AS tp,
              count(*) FILTER (WHERE p > 0.5 AND label = 0) AS fp,
              count(*) FILTER (WHERE p <= 0.5 AND label = 0) AS tn,
              count(*) FILTER (WHERE p <= 0.5 AND label = 1) AS fn FROM s GROUP BY model)"""


def sd(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


RATES = f"""rates AS (SELECT model, tp, fp, tn, fn, {sd('tp', 'tp + fn')} AS recall, {sd('tp', 'tp + fp')} AS precision,
              {sd('2 * tp', '2 * tp + fp + fn')} AS f1, {sd('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
              ({sd('tp', 'tp + fn')} + {sd('tn', 'tn + fp')}) / 2.0 AS balanced_accuracy FROM cm)"""

CURVE = f"""{GRID},
cv0 AS (SELECT s.model, g.threshold,
          count(*) FILTER (WHERE s.p >= g.threshold AND s.label = 1) AS tp,
          count(*) FILTER (WHERE s.p >= g.threshold AND s.label = 0) AS fp,
          count(*) FILTER (WHERE s.label = 1) AS tot_pos
        FROM s CROSS JOIN grid g GROUP BY s.model, g.threshold),
curve AS (SELECT model, threshold, {sd('2 * tp', 'tp + fp + tot_pos')} AS f1, {sd('tp', 'tot_pos')} AS recall,
                 {sd('tp', 'tp + fp')} AS precision FROM cv0),
best AS (SELECT model, threshold AS best_threshold, f1 AS f1_at_threshold, recall AS recall_at_threshold,
                precision AS precision_at_threshold
         FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn FROM curve)
         WHERE rn = 1)"""

EVAL = f"""{RANK}, {CM}, {RATES}, {CURVE},
br AS (SELECT model, avg(power(p - label, 2)) AS brier FROM s GROUP BY model),
ev AS (SELECT rk.model, roc_auc, pr_auc, recall, precision, f1, accuracy, balanced_accuracy, brier, best_threshold,
              f1_at_threshold, recall_at_threshold, precision_at_threshold,
              {C.SCORE_WEIGHT_PR_AUC} * coalesce(pr_auc, 0) + {C.SCORE_WEIGHT_RECALL} * coalesce(recall, 0)
              + {C.SCORE_WEIGHT_ROC} * coalesce(roc_auc, 0) AS best_overall_score
       FROM rk JOIN rates USING (model) JOIN best USING (model) JOIN br USING (model))"""

EV_COLS = ("model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, "
           "round(precision, 6) AS precision, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, "
           "round(balanced_accuracy, 6) AS balanced_accuracy, round(brier, 6) AS brier, "
           "round(best_threshold, 6) AS best_threshold, round(f1_at_threshold, 6) AS f1_at_threshold, "
           "round(recall_at_threshold, 6) AS recall_at_threshold, "
           "round(precision_at_threshold, 6) AS precision_at_threshold, "
           "round(best_overall_score, 6) AS best_overall_score")


def _bands(x: str, bands, fallback: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN '{w}'" for b, w in bands) + f" ELSE '{fallback}' END"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["evl1"] = f"WITH {S}, {RANK} SELECT model, round(roc_auc, 6) AS roc_auc FROM rk"
    q["evl2"] = f"WITH {S}, {RANK} SELECT model, round(pr_auc, 6) AS pr_auc FROM rk"
    q["evl3"] = f"""WITH {S}, {CM}, {CURVE}
SELECT model, tp, fp, tn, fn, 'default' AS kind FROM cm
UNION ALL
SELECT s.model, count(*) FILTER (WHERE p >= best_threshold AND label = 1),
       count(*) FILTER (WHERE p >= best_threshold AND label = 0),
       count(*) FILTER (WHERE p < best_threshold AND label = 0),
       count(*) FILTER (WHERE p < best_threshold AND label = 1), 'optimal'
FROM s JOIN best b ON s.model = b.model GROUP BY s.model"""
    q["evl4"] = (f"WITH {S}, {CM}, {RATES} SELECT model, round(recall, 6) AS recall, round(precision, 6) AS precision, "
                 f"round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, "
                 f"round(balanced_accuracy, 6) AS balanced_accuracy FROM rates")
    p1, r1 = sd("tp", "tp + fp"), sd("tp", "tp + fn")
    p0, r0 = sd("tn", "tn + fn"), sd("tn", "tn + fp")

    def f1(p, r):
        return f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0.0)"
    q["evl5"] = f"""WITH {S}, {CM}
SELECT model, '0' AS class, round({p0}, 6) AS precision, round({r0}, 6) AS recall, round({f1(p0, r0)}, 6) AS f1,
       CAST(tn + fp AS BIGINT) AS support FROM cm
UNION ALL SELECT model, '1', round({p1}, 6), round({r1}, 6), round({f1(p1, r1)}, 6), CAST(tp + fn AS BIGINT) FROM cm
UNION ALL SELECT model, 'macro avg', round(({p0} + {p1}) / 2, 6), round(({r0} + {r1}) / 2, 6),
       round(({f1(p0, r0)} + {f1(p1, r1)}) / 2, 6), CAST(tp + fn + tn + fp AS BIGINT) FROM cm
UNION ALL SELECT model, 'weighted avg', round((({p0}) * (tn + fp) + ({p1}) * (tp + fn)) / (tp + fn + tn + fp), 6),
       round((({r0}) * (tn + fp) + ({r1}) * (tp + fn)) / (tp + fn + tn + fp), 6),
       round((({f1(p0, r0)}) * (tn + fp) + ({f1(p1, r1)}) * (tp + fn)) / (tp + fn + tn + fp), 6),
       CAST(tp + fn + tn + fp AS BIGINT) FROM cm"""
    q["evl6"] = (f"WITH {S}, {CURVE} SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1, "
                 f"round(recall, 6) AS recall, round(precision, 6) AS precision FROM curve")
    q["evl7"] = (f"WITH {S}, {CURVE} SELECT model, round(best_threshold, 6) AS best_threshold, "
                 f"round(f1_at_threshold, 6) AS f1_at_threshold, round(recall_at_threshold, 6) AS recall_at_threshold, "
                 f"round(precision_at_threshold, 6) AS precision_at_threshold FROM best")
    q["evl8"] = f"WITH {S}, {EVAL} SELECT model, round(best_overall_score, 6) AS best_overall_score FROM ev"
    q["evl9"] = f"WITH {S}, {EVAL} SELECT {EV_COLS} FROM ev"
    q["evl10"] = (f"WITH {S}, {EVAL} SELECT model, round(best_overall_score, 6) AS best_overall_score FROM ev "
                  f"ORDER BY best_overall_score DESC, model ASC LIMIT 1")
    # EVL11: per fold best threshold and metrics, then mean / population std
    q["evl11"] = f"""WITH {S}, {GRID},
fg AS (SELECT model, fold, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM s GROUP BY model, fold, p),
fst AS (SELECT *, sum(pos) OVER (PARTITION BY model, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
               sum(neg) OVER (PARTITION BY model, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
               sum(pos) OVER (PARTITION BY model, fold) AS tot_pos, sum(neg) OVER (PARTITION BY model, fold) AS tot_neg FROM fg),
frk AS (SELECT model, fold,
          sum(pos * (CAST(tot_neg AS DOUBLE) - cum_neg + neg / 2.0)) / (CAST(max(tot_pos) AS DOUBLE) * max(tot_neg)) AS roc_auc,
          sum((pos / CAST(tot_pos AS DOUBLE)) * cum_pos / (cum_pos + cum_neg)) AS pr_auc FROM fst GROUP BY model, fold),
fc0 AS (SELECT s.model, s.fold, g.threshold,
          count(*) FILTER (WHERE s.p >= g.threshold AND s.label = 1) AS tp,
          count(*) FILTER (WHERE s.p >= g.threshold AND s.label = 0) AS fp,
          count(*) FILTER (WHERE s.label = 1) AS tot_pos
        FROM s CROSS JOIN grid g GROUP BY s.model, s.fold, g.threshold),
fbest AS (SELECT model, fold, threshold AS bt, {sd('tp', 'tot_pos')} AS recall FROM (
            SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY {sd('2 * tp', 'tp + fp + tot_pos')} DESC,
                                         threshold ASC) AS rn FROM fc0) WHERE rn = 1),
per AS (SELECT * FROM frk JOIN fbest USING (model, fold))
SELECT model, round(avg(pr_auc), 6) AS cv_pr_auc, round(avg(recall), 6) AS cv_recall, round(avg(roc_auc), 6) AS cv_roc_auc,
       round(stddev_pop(pr_auc), 6) AS cv_pr_auc_std, round(stddev_pop(recall), 6) AS cv_recall_std,
       round(stddev_pop(roc_auc), 6) AS cv_roc_auc_std, round(avg(bt), 6) AS cv_avg_threshold,
       count(*) AS cv_folds,
       round({C.SCORE_WEIGHT_PR_AUC} * avg(pr_auc) + {C.SCORE_WEIGHT_RECALL} * avg(recall)
             + {C.SCORE_WEIGHT_ROC} * avg(roc_auc), 6) AS cv_best_overall_score
FROM per GROUP BY model"""

    def auc_of(where: str, name: str) -> str:
        return f"""{name}_g AS (SELECT model, p, count(*) FILTER (WHERE label = 1) AS pos,
                         count(*) FILTER (WHERE label = 0) AS neg FROM s WHERE {where} GROUP BY model, p),
{name}_st AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
                 sum(pos) OVER (PARTITION BY model) AS tot_pos, sum(neg) OVER (PARTITION BY model) AS tot_neg FROM {name}_g),
{name} AS (SELECT model, sum(pos * (CAST(tot_neg AS DOUBLE) - cum_neg + neg / 2.0)) / (CAST(max(tot_pos) AS DOUBLE) * max(tot_neg))
             AS auc FROM {name}_st GROUP BY model)"""
    q["evl12"] = f"""WITH {S}, {auc_of('fold <> 0', 'tr')}, {auc_of('fold = 0', 'te')},
  {", ".join(auc_of(f'fold = {f}', f'f{f}') for f in range(C.CV_FOLDS))},
  cv AS (SELECT model, avg(auc) AS auc FROM ({" UNION ALL ".join(f"SELECT * FROM f{f}" for f in range(C.CV_FOLDS))}) GROUP BY model)
SELECT tr.model, round(tr.auc, 6) AS train_roc_auc, round(cv.auc, 6) AS cv_roc_auc, round(te.auc, 6) AS test_roc_auc, round(tr.auc - te.auc, 6) AS gap,
       CASE WHEN tr.auc - te.auc IS NULL THEN '-' {' '.join(f"WHEN tr.auc - te.auc < {b} THEN '{w}'" for b, w in C.OVERFIT_BANDS)}
            ELSE '{C.OVERFIT_FALLBACK}' END AS status
FROM tr JOIN te ON tr.model = te.model LEFT JOIN cv ON cv.model = tr.model"""
    q["evl13"] = f"WITH {S} SELECT model, round(avg(power(p - label, 2)), 6) AS brier FROM s GROUP BY model"
    q["evl17"] = (f"WITH {S}, {EVAL} SELECT model, 'ok' AS status, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, "
                  f"round(roc_auc, 6) AS roc_auc, round(best_overall_score, 6) AS best_overall_score, "
                  f"row_number() OVER (ORDER BY best_overall_score DESC, model ASC) AS rank FROM ev")
    q["evl18"] = (f"WITH {S}, {SCORE_TABLE} SELECT model, round(p, 6) AS threshold, round({sd('cum_neg', 'tot_neg')}, 6) AS fpr, "
                  f"round({sd('cum_pos', 'tot_pos')}, 6) AS tpr FROM st")
    q["evl19"] = (f"WITH {S}, {SCORE_TABLE} SELECT model, round(p, 6) AS threshold, round({sd('cum_pos', 'tot_pos')}, 6) AS recall, "
                  f"round({sd('cum_pos', 'cum_pos + cum_neg')}, 6) AS precision FROM st")
    q["evl20"] = f"""WITH {S}, {EVAL}
SELECT model, {_bands('roc_auc', C.AUC_BANDS, C.AUC_FALLBACK)} AS roc_auc_band,
       {_bands('recall', C.RECALL_BANDS, C.RECALL_FALLBACK)} AS recall_band,
       {_bands('pr_auc', C.AP_BANDS, C.AP_FALLBACK)} AS pr_auc_band,
       {_bands('f1', C.F1_BANDS, C.F1_FALLBACK)} AS f1_band FROM ev"""

    risk = (f"CASE WHEN p >= {C.RISK_HIGH} THEN 'High' WHEN p >= {C.RISK_MEDIUM} THEN 'Medium' ELSE 'Low' END")
    q["scr2"] = (f"WITH {S} SELECT model, c_custkey AS customer_id, CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END "
                 f"AS churn_prediction, round(p, 4) AS churn_probability FROM s")
    q["scr3"] = f"WITH {S} SELECT model, c_custkey AS customer_id, {risk} AS risk_level FROM s"
    q["scr4"] = (f"WITH {S} SELECT model, count(*) AS total, count(*) FILTER (WHERE p >= 0.5) AS churning, "
                 f"count(*) - count(*) FILTER (WHERE p >= 0.5) AS staying, "
                 f"round(count(*) FILTER (WHERE p >= 0.5) / greatest(count(*), 1), 6) AS pct_churn FROM s GROUP BY model")
    q["scr5"] = f"""WITH {S}, a AS (SELECT model, avg(CAST(label AS DOUBLE)) AS h,
                      count(*) FILTER (WHERE p >= 0.5) / count(*) AS q FROM s GROUP BY model)
SELECT model, round(h, 6) AS historical_rate, round(q, 6) AS predicted_rate, round((q - h) * 100.0, 6) AS diff_pp,
       abs((q - h) * 100.0) > {C.MONITOR_SHIFT_PP} AS shift FROM a"""
    q["scr6"] = f"""WITH {S}, {CURVE}
SELECT model, round(threshold, 6) AS nearest_threshold, round(recall, 6) AS expected_recall,
       round(precision, 6) AS expected_precision
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(abs(threshold - 0.5), 9), threshold) AS rn
      FROM curve) WHERE rn = 1"""
    q["scr7"] = f"""WITH {S}, {CURVE}
SELECT model, best_threshold, CASE WHEN best_threshold <= {C.SENSITIVITY_RECALL_MAX} THEN 'High Recall'
       WHEN best_threshold <= {C.SENSITIVITY_BALANCED_MAX} THEN 'Balanced' ELSE 'High Precision' END AS mode FROM best"""
    q["scr8"] = f"""WITH {S}, t(threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE))
SELECT s.model, count(*) AS total_all, t.threshold, count(*) FILTER (WHERE s.p >= t.threshold) AS churning
FROM s CROSS JOIN t GROUP BY s.model, t.threshold"""
    q["scr8"] = f"""WITH {S}, t(threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)),
x AS (SELECT s.model, t.threshold, count(*) AS total, count(*) FILTER (WHERE s.p >= t.threshold) AS churning
      FROM s CROSS JOIN t GROUP BY s.model, t.threshold)
SELECT model, total, threshold, churning FROM x"""
    q["scr9"] = (f"WITH {S} SELECT model, label, CAST(least(greatest(floor(p * 30), 0), 29) AS INT) AS bin, "
                 f"count(*) AS n FROM s GROUP BY ALL")
    q["scr10"] = f"WITH {S} SELECT model, {risk} AS risk_level, count(*) AS n FROM s GROUP BY ALL"
    q["scr11"] = (f"WITH cf AS ({V.customer_features()}) SELECT label, count(*) AS n, "
                  f"round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cf GROUP BY label")
    return q
