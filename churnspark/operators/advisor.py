"""Model recommendation from dataset meta-features (TRN12).

Meta-features come from one aggregate plus the profile (one row per
column); the rule scores are column expressions over that single row, so
the whole recommendation is a tiny DataFrame job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: recommendation rules (base score, then (condition, delta)) -------------
# conditions: large n > 50k, medium 5k < n <= 50k, small n <= 5k, many_cat share > 0.35,
# many_num share > 0.60, high_dim features > 50, imb = imbalanced, fast/best = mode
RULES = {
    "Logistic Regression": (3.0, [("high_dim", 0.5)]),
    "XGBoost": (5.0, [("many_num", 1.5), ("large", 0.5), ("imb", 1.0)]),
    "LightGBM": (5.0, [("large", 2.0), ("many_cat", 1.5), ("imb", 0.5)]),
    "CatBoost": (4.0, [("many_cat", 2.5), ("imb", 1.0), ("large", -0.5)]),
    "Random Forest": (3.5, [("small_or_medium", 1.0), ("imb", 0.5)]),
}
REASONS = {
    "Logistic Regression": "linear baseline",
    "XGBoost": "boosting for numeric-heavy data",
    "LightGBM": "fast histogram boosting",
    "CatBoost": "boosting robust to categorical columns",
    "Random Forest": "robust bagged trees",
    "Gradient Boosting": "classic boosting",
    "Decision Tree": "single-tree baseline",
}


def meta_features(df: DataFrame, numeric: list[str], categorical: list[str], label: str = "label") -> DataFrame:
    """One row: n_samples, n_features, numeric/categorical shares, missing rate, imbalance."""
    feats = numeric + categorical
    n_cells = F.count(F.lit(1)) * F.lit(max(len(feats), 1))
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in feats), F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("n_samples"), (nulls / n_cells).alias("missing_rate"),
               F.avg(F.col(label).cast("double")).alias("churn_rate"))
    n_f = max(len(feats), 1)
    return a.select("n_samples", F.lit(len(feats)).alias("n_features"),
                    F.lit(len(numeric) / n_f).alias("numeric_ratio"),
                    F.lit(len(categorical) / n_f).alias("categorical_ratio"), "missing_rate",
                    ((F.col("churn_rate") < 0.2) | (F.col("churn_rate") > 0.8)).alias("is_imbalanced"))


def recommend(meta: DataFrame, mode: str = "balanced", top_n: int = 5) -> DataFrame:
    n = F.col("n_samples")
    cond: dict[str, Column] = {
        "large": n > 50_000, "medium": (n > 5_000) & (n <= 50_000), "small": n <= 5_000,
        "small_or_medium": n <= 50_000,
        "many_cat": F.col("categorical_ratio") > 0.35, "many_num": F.col("numeric_ratio") > 0.60,
        "high_dim": F.col("n_features") > 50, "imb": F.col("is_imbalanced"),
    }
    rows = []
    for model, (base, deltas) in RULES.items():
        s = F.lit(base)
        for c, d in deltas:
            s = s + F.when(cond[c], F.lit(d)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(model).alias("model"), s.alias("score"), F.lit(REASONS[model]).alias("reason"),
                             F.lit(len(rows)).alias("ord")))
    gb = F.lit(3.5) if mode == "best" else F.when(cond["large"], F.lit(-99.0)).otherwise(F.lit(1.5))
    rows.append(F.struct(F.lit("Gradient Boosting").alias("model"), gb.alias("score"),
                         F.lit(REASONS["Gradient Boosting"]).alias("reason"), F.lit(len(rows)).alias("ord")))
    dt = 1.5 if mode == "fast" else -99.0
    rows.append(F.struct(F.lit("Decision Tree").alias("model"), F.lit(dt).alias("score"),
                         F.lit(REASONS["Decision Tree"]).alias("reason"), F.lit(len(rows)).alias("ord")))
    x = meta.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(F.col("score") > 0)
    # stable order on ties: rule order (a window over at most seven rows)
    w = Window.orderBy(F.col("score").desc(), F.col("ord"))
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).drop("ord")
