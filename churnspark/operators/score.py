"""Scoring outputs and monitoring (SCR1-SCR11).

All of these are projections or single aggregates over a scored frame
(``p`` = churn probability), so they stream and scale with no shuffle except
the final small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import config as C


def risk_level(p: Column) -> Column:
    """SCR3: High >= 0.70, Medium >= 0.40, else Low (on the unrounded probability)."""
    return F.when(p >= C.RISK_HIGH, "High").when(p >= C.RISK_MEDIUM, "Medium").otherwise("Low")


def predictions(scored: DataFrame, id_col: str, threshold: float | Column = 0.5, p: str = "p",
                keep=()) -> DataFrame:
    """SCR2 + SCR3: customer_id, Yes/No by threshold, probability rounded to 4, risk tier."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.select(
        *keep,
        F.col(id_col).alias("customer_id"),
        F.when(F.col(p) >= t, "Yes").otherwise("No").alias("churn_prediction"),
        F.round(F.col(p), 4).alias("churn_probability"),
        risk_level(F.col(p)).alias("risk_level"),
    )


def batch_summary(scored: DataFrame, threshold: float | Column = 0.5, p: str = "p", keys=()) -> DataFrame:
    """SCR4: total, churning, staying and the churn share of a scored batch."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    agg = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                    F.count_if(F.col(p) >= t).alias("churning"))
    return agg.select(*keys, "total", "churning", (F.col("total") - F.col("churning")).alias("staying"),
                      (F.col("churning") / F.greatest(F.col("total"), F.lit(1))).alias("pct_churn"))


def churn_monitor(predicted_rate: Column, historical_rate: Column) -> list[Column]:
    """SCR5: difference in percentage points and the shift flag (|diff| > 10 pp)."""
    diff = (predicted_rate - historical_rate) * 100.0
    return [historical_rate.alias("historical_rate"), predicted_rate.alias("predicted_rate"),
            diff.alias("diff_pp"), (F.abs(diff) > C.MONITOR_SHIFT_PP).alias("shift")]


def monitor(scored: DataFrame, threshold: float | Column = 0.5, label: str = "label", p: str = "p",
            keys=()) -> DataFrame:
    """SCR5 in one aggregate: historical churn rate of the labelled rows vs predicted rate."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    agg = scored.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("h"),
                                    (F.count_if(F.col(p) >= t) / F.count(F.lit(1))).alias("q"))
    return agg.select(*keys, *churn_monitor(F.col("q"), F.col("h")))


def expected_at_threshold(curve: DataFrame, chosen: float, keys=("model",)) -> DataFrame:
    """SCR6: recall/precision of the curve point nearest to the chosen threshold (lower wins ties)."""
    ks = list(keys)
    dist = F.round(F.abs(F.col("threshold") - F.lit(float(chosen))), 9)
    return curve.groupBy(*ks).agg(
        F.min_by(F.struct("threshold", "recall", "precision"), F.struct(dist, F.col("threshold"))).alias("pt")
    ).select(*ks, F.col("pt.threshold").alias("nearest_threshold"),
             F.col("pt.recall").alias("expected_recall"), F.col("pt.precision").alias("expected_precision"))


def sensitivity_mode(threshold: Column) -> Column:
    """SCR7: threshold <= .40 high recall, <= .55 balanced, else high precision."""
    return (F.when(threshold <= C.SENSITIVITY_RECALL_MAX, "High Recall")
            .when(threshold <= C.SENSITIVITY_BALANCED_MAX, "Balanced").otherwise("High Precision"))


def rethreshold(stored: DataFrame, thresholds: list[float], p: str = "p", keys=()) -> DataFrame:
    """SCR8: apply other thresholds to stored probabilities (no rescoring), one pass."""
    aggs = [F.count_if(F.col(p) >= F.lit(float(t))).alias(f"c{i}") for i, t in enumerate(thresholds)]
    wide = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("churning"))
                    for i, t in enumerate(thresholds)])
    return wide.select(*keys, "total", F.explode(arr).alias("x")).select(*keys, "total", "x.threshold", "x.churning")


def probability_histogram(scored: DataFrame, bins: int = 30, label: str = "label", p: str = "p",
                          keys=()) -> DataFrame:
    """SCR9: counts of p in equal-width bins over [0, 1], by label."""
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*keys, F.col(label).alias("label"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def risk_breakdown(scored: DataFrame, p: str = "p", keys=()) -> DataFrame:
    """SCR10: rows per risk tier."""
    return scored.groupBy(*keys, risk_level(F.col(p)).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """SCR11: rows per class and share."""
    from pyspark.sql import Window
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
