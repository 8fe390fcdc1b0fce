"""Evaluation of scored frames (EVL1-EVL20) without any ML import.

Input: a predictions frame with a 0/1 ``label``, a probability ``p`` and the
grouping keys (``model``, optionally ``fold``). Every metric is computed for
all groups at once, so stacking the predictions of all models and folds is
one job, never a loop of jobs.

Ranking metrics without a global sort
-------------------------------------
ROC-AUC and average precision need, per distinct score s (descending), the
cumulative positives/negatives at or above s. Scores are first grouped to
(keys, p) (one row per distinct score). A 16-bit score bucket gives a small
per-group histogram whose prefix sum is a window over <= 65,536 rows; the
running sum inside each (keys, bucket) partition finishes the job. No window
ever spans all rows, and the group-by collapses hot scores map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark import config as C

#: Buckets per unit of log odds; scores beyond 40 either way share the last bucket.
SCORE_BUCKETS, MAX_LOG_ODDS = 1024, 40


def _keys(keys) -> list[str]:
    return list(keys) if keys else []


def score_table(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """(keys, p, pos, neg, cum_pos, cum_neg, tot_pos, tot_neg): cumulative counts from the top score down."""
    ks = _keys(keys)
    g = pred.groupBy(*ks, F.col(p).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    )
    # log odds spread the scores of rare events, which a linear scale would put into one bucket
    q = F.col("p")
    odds = F.when(q <= 0, F.lit(-float(MAX_LOG_ODDS))).when(q >= 1, F.lit(float(MAX_LOG_ODDS))).otherwise(F.log(q / (1 - q)))
    odds = F.least(F.greatest(odds, F.lit(-float(MAX_LOG_ODDS))), F.lit(float(MAX_LOG_ODDS)))
    g = g.withColumn("bk", F.floor(odds * SCORE_BUCKETS).cast("int"))
    bt = g.groupBy(*ks, "bk").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    wb = (Window.partitionBy(*ks).orderBy(F.col("bk").desc())
          .rowsBetween(Window.unboundedPreceding, Window.currentRow)) if ks else \
        Window.orderBy(F.col("bk").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
    bt = bt.select(*ks, "bk",
                   (F.sum("bpos").over(wb) - F.col("bpos")).alias("off_pos"),
                   (F.sum("bneg").over(wb) - F.col("bneg")).alias("off_neg"),
                   F.sum("bpos").over(wt).alias("tot_pos"), F.sum("bneg").over(wt).alias("tot_neg"))
    j = g.join(bt, ks + ["bk"])
    wi = (Window.partitionBy(*ks, "bk").orderBy(F.col("p").desc())
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return j.select(*ks, "p", "pos", "neg", "tot_pos", "tot_neg",
                    (F.col("off_pos") + F.sum("pos").over(wi)).alias("cum_pos"),
                    (F.col("off_neg") + F.sum("neg").over(wi)).alias("cum_neg"))


def ranking_metrics(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL1 ROC-AUC (ties count half) and EVL2 average precision (step sum), per group."""
    ks = _keys(keys)
    st = score_table(pred, ks, label, p)
    P = F.col("tot_pos").cast("double")
    N = F.col("tot_neg").cast("double")
    auc_term = F.col("pos") * (N - F.col("cum_neg") + F.col("neg") / 2.0)
    ap_term = (F.col("pos") / P) * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = st.groupBy(*ks).agg(F.sum(auc_term).alias("auc_num"), F.sum(ap_term).alias("ap_sum"),
                              F.first("tot_pos").alias("tot_pos"), F.first("tot_neg").alias("tot_neg"))
    valid = (F.col("tot_pos") > 0) & (F.col("tot_neg") > 0)
    return agg.select(*ks,
                      F.when(valid, F.col("auc_num") / (F.col("tot_pos").cast("double") * F.col("tot_neg"))).alias("roc_auc"),
                      F.when(F.col("tot_pos") > 0, F.col("ap_sum")).alias("pr_auc"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pred: DataFrame, keys=("model",), threshold: float | Column = 0.5, strict: bool = True,
              label: str = "label", p: str = "p") -> DataFrame:
    """EVL3: tp, fp, tn, fn per group.

    ``strict``: predicted churn when p > t (what a classifier's predict does at
    0.5); otherwise p >= t (threshold sweep rule).
    """
    ks = _keys(keys)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = (F.col(p) > t) if strict else (F.col(p) >= t)
    y1 = F.col(label) == 1
    return pred.groupBy(*ks).agg(
        F.count_if(hit & y1).alias("tp"), F.count_if(hit & ~y1).alias("fp"),
        F.count_if(~hit & ~y1).alias("tn"), F.count_if(~hit & y1).alias("fn"))


def rates(cm: DataFrame, keys=("model",)) -> DataFrame:
    """EVL4 from a confusion frame: recall, precision, f1, accuracy, balanced accuracy."""
    ks = _keys(keys)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall = _safe_div(tp, tp + fn)
    spec = _safe_div(tn, tn + fp)
    return cm.select(*ks, "tp", "fp", "tn", "fn",
                     recall.alias("recall"),
                     _safe_div(tp, tp + fp).alias("precision"),
                     _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     _safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                     ((recall + spec) / 2.0).alias("balanced_accuracy"))


def classification_report(pred: DataFrame, keys=("model",), threshold: float = 0.5) -> DataFrame:
    """EVL5: per class precision/recall/f1/support, plus macro and weighted averages."""
    ks = _keys(keys)
    cm = confusion(pred, ks, threshold)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    # class 1 is as usual; class 0 swaps roles
    c1 = (_safe_div(tp, tp + fp), _safe_div(tp, tp + fn), tp + fn)
    c0 = (_safe_div(tn, tn + fn), _safe_div(tn, tn + fp), tn + fp)

    def f1(prec, rec):
        return F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))

    rows = F.array(
        F.struct(F.lit("0").alias("class"), c0[0].alias("precision"), c0[1].alias("recall"),
                 f1(c0[0], c0[1]).alias("f1"), c0[2].cast("long").alias("support")),
        F.struct(F.lit("1").alias("class"), c1[0].alias("precision"), c1[1].alias("recall"),
                 f1(c1[0], c1[1]).alias("f1"), c1[2].cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((c0[0] + c1[0]) / 2).alias("precision"),
                 ((c0[1] + c1[1]) / 2).alias("recall"),
                 ((f1(c0[0], c0[1]) + f1(c1[0], c1[1])) / 2).alias("f1"),
                 (c0[2] + c1[2]).cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 ((c0[0] * c0[2] + c1[0] * c1[2]) / (c0[2] + c1[2])).alias("precision"),
                 ((c0[1] * c0[2] + c1[1] * c1[2]) / (c0[2] + c1[2])).alias("recall"),
                 ((f1(c0[0], c0[1]) * c0[2] + f1(c1[0], c1[1]) * c1[2]) / (c0[2] + c1[2])).alias("f1"),
                 (c0[2] + c1[2]).cast("long").alias("support")),
    )
    return cm.select(*ks, F.explode(rows).alias("r")).select(*ks, "r.*")


def _sweep_aggs(label: str, p: str) -> list[Column]:
    y1 = F.col(label) == 1
    aggs = [F.count_if(y1).alias("tot_pos"), F.count_if(~y1).alias("tot_neg")]
    for i, t in enumerate(C.THRESHOLDS):
        aggs.append(F.count_if((F.col(p) >= F.lit(t)) & y1).alias(f"tp{i}"))
        aggs.append(F.count_if((F.col(p) >= F.lit(t)) & ~y1).alias(f"fp{i}"))
    return aggs


def _curve_from_wide(wide: DataFrame, ks: list[str]) -> DataFrame:
    points = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(C.THRESHOLDS)
    ])
    long = wide.select(*ks, "tot_pos", "tot_neg", F.explode(points).alias("pt")).select(
        *ks, "tot_pos", "tot_neg", "pt.threshold", "pt.tp", "pt.fp")
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("tot_pos")
    return long.select(*ks, "threshold",
                       _safe_div(2 * tp, tp + fp + P).alias("f1"),
                       _safe_div(tp, P).alias("recall"),
                       _safe_div(tp, tp + fp).alias("precision"))


def threshold_curve(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL6: f1/recall/precision at the 26 grid thresholds (p >= t), one hash aggregate.

    26 x 2 conditional counts per group, then the grid is exploded from an
    array (a generator, not a join).
    """
    ks = _keys(keys)
    return _curve_from_wide(pred.groupBy(*ks).agg(*_sweep_aggs(label, p)), ks)


def best_threshold(curve: DataFrame, keys=("model",)) -> DataFrame:
    """EVL7: the threshold with the highest F1; the lowest threshold wins ties."""
    ks = _keys(keys)
    w = Window.partitionBy(*ks).orderBy(F.col("f1").desc(), F.col("threshold").asc())
    return curve.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        *ks, F.col("threshold").alias("best_threshold"), F.col("f1").alias("f1_at_threshold"),
        F.col("recall").alias("recall_at_threshold"), F.col("precision").alias("precision_at_threshold"))


def overall_score(pr_auc: Column, recall: Column, roc_auc: Column) -> Column:
    """EVL8: 0.45 AP + 0.35 recall + 0.20 AUC (missing parts count 0)."""
    return (C.SCORE_WEIGHT_PR_AUC * F.coalesce(pr_auc, F.lit(0.0))
            + C.SCORE_WEIGHT_RECALL * F.coalesce(recall, F.lit(0.0))
            + C.SCORE_WEIGHT_ROC * F.coalesce(roc_auc, F.lit(0.0)))


def brier(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL13: mean squared error of the probability."""
    ks = _keys(keys)
    return pred.groupBy(*ks).agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))


def evaluate(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL9: all metrics of all groups (one row per group) in two scans of the predictions.

    Scan 1: one hash aggregate holds the confusion counts at 0.5, the Brier
    sum and the 26-threshold sweep. Scan 2: the ranking metrics.
    """
    ks = _keys(keys)
    y1 = F.col(label) == 1
    hit = F.col(p) > 0.5
    wide = pred.groupBy(*ks).agg(
        *_sweep_aggs(label, p),
        F.count_if(hit & y1).alias("tp"), F.count_if(hit & ~y1).alias("fp"),
        F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    wide = wide.withColumn("fn", F.col("tot_pos") - F.col("tp")).withColumn("tn", F.col("tot_neg") - F.col("fp"))
    r = rates(wide.select(*ks, "tp", "fp", "tn", "fn"), ks)
    bt = best_threshold(_curve_from_wide(wide, ks), ks)
    rank = ranking_metrics(pred, ks, label, p)
    out = rank.join(r, ks).join(bt, ks).join(wide.select(*ks, "brier"), ks)
    return out.select(
        *ks, "roc_auc", "pr_auc", "recall", "precision", "f1", "accuracy", "balanced_accuracy", "brier",
        "best_threshold", "f1_at_threshold", "recall_at_threshold", "precision_at_threshold",
        overall_score(F.col("pr_auc"), F.col("recall"), F.col("roc_auc")).alias("best_overall_score"))


def pick_best(metrics: DataFrame, score: str = "best_overall_score") -> DataFrame:
    """EVL10: the model with the highest score (name breaks ties)."""
    return metrics.orderBy(F.col(score).desc_nulls_last(), F.col("model").asc()).limit(1)


def cv_evaluate(oof: DataFrame, keys=("model",), fold: str = "fold", label: str = "label",
                p: str = "p") -> DataFrame:
    """EVL11: per fold its own best threshold, then mean and population std over folds."""
    ks = _keys(keys)
    fk = ks + [fold]
    bt = best_threshold(threshold_curve(oof, fk, label, p), fk)
    rank = ranking_metrics(oof, fk, label, p)
    at = oof.join(bt.select(*fk, "best_threshold"), fk)
    y1 = F.col(label) == 1
    hit = F.col(p) >= F.col("best_threshold")
    rec = at.groupBy(*fk).agg(
        _safe_div(F.count_if(hit & y1), F.count_if(y1)).alias("recall"))
    per = rank.join(rec, fk).join(bt, fk)
    return per.groupBy(*ks).agg(
        F.avg("pr_auc").alias("cv_pr_auc"), F.avg("recall").alias("cv_recall"),
        F.avg("roc_auc").alias("cv_roc_auc"),
        F.stddev_pop("pr_auc").alias("cv_pr_auc_std"), F.stddev_pop("recall").alias("cv_recall_std"),
        F.stddev_pop("roc_auc").alias("cv_roc_auc_std"),
        F.avg("best_threshold").alias("cv_avg_threshold"),
        F.count(F.lit(1)).alias("cv_folds"),
    ).withColumn("cv_best_overall_score",
                 overall_score(F.col("cv_pr_auc"), F.col("cv_recall"), F.col("cv_roc_auc")))


def _band(x: Column, bands, fallback: str) -> Column:
    e = None
    for bound, word in bands:
        e = F.when(x >= bound, word) if e is None else e.when(x >= bound, word)
    return e.otherwise(fallback)


def metric_bands(metrics: DataFrame, keys=("model",)) -> DataFrame:
    """EVL20: each headline metric in words."""
    ks = _keys(keys)
    return metrics.select(
        *ks,
        _band(F.col("roc_auc"), C.AUC_BANDS, C.AUC_FALLBACK).alias("roc_auc_band"),
        _band(F.col("recall"), C.RECALL_BANDS, C.RECALL_FALLBACK).alias("recall_band"),
        _band(F.col("pr_auc"), C.AP_BANDS, C.AP_FALLBACK).alias("pr_auc_band"),
        _band(F.col("f1"), C.F1_BANDS, C.F1_FALLBACK).alias("f1_band"))


def overfit_report(train_auc: DataFrame, test_auc: DataFrame, keys=("model",), cv_auc: DataFrame | None = None) -> DataFrame:
    """EVL12: train, cross-validated (null where not given) and test ROC-AUC, the train - test gap and its band."""
    ks = _keys(keys)
    j = train_auc.select(*ks, F.col("roc_auc").alias("train_roc_auc")).join(
        test_auc.select(*ks, F.col("roc_auc").alias("test_roc_auc")), ks)
    j = j.join(cv_auc.select(*ks, "cv_roc_auc"), ks, "left") if cv_auc is not None else j.withColumn(
        "cv_roc_auc", F.lit(None).cast("double"))
    gap = F.col("train_roc_auc") - F.col("test_roc_auc")
    status = F.when(gap.isNull(), "-")
    for bound, word in C.OVERFIT_BANDS:
        status = status.when(gap < bound, word)
    return j.select(*ks, "train_roc_auc", "cv_roc_auc", "test_roc_auc", gap.alias("gap"),
                    status.otherwise(C.OVERFIT_FALLBACK).alias("status"))


def comparison_table(metrics: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """EVL17: models by score, best first (numeric sort), with their rank and status.

    A model in ``cv`` (from cv_evaluate) shows its cross-validated values; one with an ``error`` has no values and
    comes last with the reason. One row per model."""
    names = ["pr_auc", "recall", "roc_auc", "best_overall_score"]
    error = F.col("error") if "error" in metrics.columns else F.lit(None).cast("string")
    x = metrics.select("model", error.alias("error"), *names)
    if cv is not None:
        x = x.join(cv.select("model", *[F.col(f"cv_{n}") for n in names]), "model", "left").select(
            "model", "error", *[F.coalesce(f"cv_{n}", n).alias(n) for n in names])
    fine = F.col("error").isNull()
    x = x.select("model", F.when(fine, "ok").otherwise(F.concat(F.lit("failed: "), F.col("error"))).alias("status"),
                 *[F.when(fine, F.col(n)).alias(n) for n in names])
    w = Window.orderBy(F.col("best_overall_score").desc_nulls_last(), F.col("model").asc())
    return x.withColumn("rank", F.row_number().over(w))


def roc_curve(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL18: (fpr, tpr) at every distinct score."""
    ks = _keys(keys)
    st = score_table(pred, ks, label, p)
    return st.select(*ks, F.col("p").alias("threshold"),
                     _safe_div(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
                     _safe_div(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"))


def pr_curve(pred: DataFrame, keys=("model",), label: str = "label", p: str = "p") -> DataFrame:
    """EVL19: (recall, precision) at every distinct score."""
    ks = _keys(keys)
    st = score_table(pred, ks, label, p)
    return st.select(*ks, F.col("p").alias("threshold"),
                     _safe_div(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
                     _safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))
