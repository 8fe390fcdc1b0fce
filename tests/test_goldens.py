"""Hand-computed results on tiny frames."""
import math

from pyspark.sql import functions as F

from churnspark.functions.chi2 import chi2_sf
from churnspark.operators import metrics as M
from churnspark.operators.signal import assess_signal


def _pred(spark, rows):
    return spark.createDataFrame([("m", y, p) for y, p in rows], "model string, label int, p double")


def test_auc_with_ties(spark):
    # positives at 0.9, 0.5 ; negatives at 0.5, 0.1 -> pairs: (0.9>0.5) 1, (0.9>0.1) 1, (0.5=0.5) .5, (0.5>0.1) 1
    df = _pred(spark, [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)])
    r = M.ranking_metrics(df).first()
    assert abs(r["roc_auc"] - 3.5 / 4) < 1e-12


def test_average_precision_step_sum(spark):
    # scores desc: 0.9(+) 0.8(-) 0.7(+) 0.6(-) 0.5(+) 0.4(-)
    df = _pred(spark, [(1, .9), (0, .8), (1, .7), (0, .6), (1, .5), (0, .4)])
    ap = M.ranking_metrics(df).first()["pr_auc"]
    want = (1 / 3) * (1 / 1) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    assert abs(ap - want) < 1e-12


def test_threshold_ties_lowest_wins(spark):
    # every threshold in [0.20, 0.30] gives the same F1 -> 0.20 is chosen
    df = _pred(spark, [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.05)])
    bt = M.best_threshold(M.threshold_curve(df)).first()
    assert abs(bt["best_threshold"] - 0.2) < 1e-12 and bt["f1_at_threshold"] == 1.0


def test_confusion_default_is_strict(spark):
    df = _pred(spark, [(1, 0.5), (0, 0.5), (1, 0.51)])
    cm = M.confusion(df).first()
    assert (cm["tp"], cm["fp"], cm["fn"], cm["tn"]) == (1, 0, 1, 1)


def test_chi2_sf_closed_forms():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(chi2_sf(7.814727903251178, 3) - 0.05) < 1e-9
    assert chi2_sf(0.0, 4) == 1.0


def test_yates_and_cramers_v(spark):
    # 2x2 table: value a: 20 churn / 10 stay, value b: 10 churn / 20 stay
    rows = [("a", 1)] * 20 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 20
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(rows)], "id long, grp string, churn int")
    f = assess_signal(df, "churn", "id").features.first()
    # Yates: E = 15 everywhere, |O-E| = 5 -> (4.5^2/15)*4 = 5.4
    assert abs(f["chi2"] - 5.4) < 1e-9 and f["dof"] == 1
    n = 60
    phi2c = max(0.0, 5.4 / n - 1 / (n - 1))
    denom = min(2 - 1 / (n - 1) - 1, 2 - 1 / (n - 1) - 1)
    assert abs(f["cramers_v"] - math.sqrt(phi2c / denom)) < 1e-9
    assert abs(f["p_value"] - chi2_sf(5.4, 1)) < 1e-12


def test_signal_guard_one_class(spark):
    df = spark.range(40).select(F.col("id"), F.lit(1).alias("churn"), (F.col("id") % 3).alias("x"))
    s = assess_signal(df, "churn", "id").summary.first()
    assert s["error"].startswith("Target column has only one class")
    assert s["potential_label"] == "Unknown"
