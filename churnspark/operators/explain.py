"""Explanations (EXP1-EXP7).

Permutation importance and sampled Shapley values are one stacked job each: rows
are permuted by joining two hash orders on their global rank (histogram offsets
and a window per hash bucket, so no window spans all rows), the model transforms
the stack once and the results are grouped (importance: ROC-AUC by
``metrics.ranking_metrics``). All given rows are explained; ``n_rows`` takes a
hashed sample of that many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.operators.metrics import ranking_metrics
from churnspark.operators.prep import PrepModel
from churnspark.operators.split import hash_order


#: Columns of the stack that ``score_fn`` of ``sampled_shap`` must keep beside the key.
SHAP_KEEP = ["__k", "__t"]


def feature_names(prep: PrepModel) -> DataFrame | list[str]:
    """EXP1: names of the model's input slots."""
    return prep.output_names()


def builtin_importance(spark, prep: PrepModel, model) -> DataFrame:
    """EXP2: tree importances or |coefficient| per slot, sorted, with the sign for linear models."""
    names = prep.output_names()
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
        signs = [1.0] * len(vals)
    else:
        coef = model.coefficients.toArray().tolist()
        vals = [abs(v) for v in coef]
        signs = [1.0 if v >= 0 else -1.0 for v in coef]
    df = spark.createDataFrame([(n, float(v), float(s)) for n, v, s in zip(names, vals, signs)],
                               "feature string, importance double, sign double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w))


def _sample(df: DataFrame, n: int | None, key: str, salt: str) -> DataFrame:
    """All rows, or the first ``n`` in hash order."""
    if n is None:
        return df
    return df.withColumn("__h", F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def _hash_ranked(df: DataFrame, key: str, salts: dict[int, str]) -> DataFrame:
    """``df`` once per salt (number ``__k``) with ``__r``, the row's rank in that hash order of the keys."""
    orders = []
    for k, salt in salts.items():
        bucket, digest = hash_order(F.col(key).cast("string"), salt)
        orders.append(F.struct(F.lit(k).alias("__k"), bucket.alias("__b"), digest.alias("__h")))
    x = df.withColumn("__o", F.explode(F.array(*orders))).select("*", "__o.*").drop("__o")
    hist = x.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__n"))
    offset = F.sum("__n").over(Window.partitionBy("__k").orderBy("__b")) - F.col("__n")
    hist = hist.select("__k", "__b", offset.alias("__skip"))
    rank = F.col("__skip") + F.row_number().over(Window.partitionBy("__k", "__b").orderBy("__h", key)) - 1
    return x.join(hist, ["__k", "__b"]).withColumn("__r", rank).drop("__b", "__h", "__skip")


def _with_partner(rows: DataFrame, cols: list[str], key: str, repeats: int, salt: str) -> DataFrame:
    """Every row once per repeat ``__k``, beside the columns (``__z0``, ``__z1``, ...) of another row: a permutation of the rows."""
    here = _hash_ranked(rows, key, {k: f"{salt}{k}|row|" for k in range(repeats)})
    there = _hash_ranked(rows.select(key, *[F.col(f"`{c}`").alias(f"__z{i}") for i, c in enumerate(cols)]), key,
                         {k: f"{salt}{k}|partner|" for k in range(repeats)})
    return here.join(there.drop(key), ["__k", "__r"]).drop("__r")


def permutation_importance(df: DataFrame, raw_cols: list[str], score_fn, key: str, label: str = "label",
                           n_rows: int | None = None, repeats: int = 5, salt: str = "42|perm|") -> DataFrame:
    """EXP3: mean and std of the ROC-AUC drop when one raw column is shuffled.

    ``score_fn(frame) -> frame with p`` applies preprocessing and model.
    """
    sample = _sample(df, n_rows, key, salt)
    paired = _with_partner(sample, raw_cols, key, repeats, salt)
    stack = paired.withColumn("__f", F.explode(F.array(*[F.lit(c) for c in raw_cols])))
    swapped = stack.select(
        "__f", "__k", key, label,
        *[F.when(F.col("__f") == c, F.col(f"__z{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(raw_cols)],
        *[F.col(f"`{c}`") for c in df.columns if c not in raw_cols and c not in (key, label)])
    scored = score_fn(swapped).select("__f", "__k", label, "p")
    aucs = ranking_metrics(scored, keys=["__f", "__k"], label=label)
    whole = score_fn(sample).select(F.lit(0).alias("__g"), label, "p")
    base = ranking_metrics(whole, keys=["__g"], label=label).first()
    drop = aucs.select(F.col("__f").alias("feature"), (F.lit(base["roc_auc"] if base else None).cast("double") - F.col("roc_auc")).alias("drop"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                       F.stddev_pop("drop").alias("importance_std")).withColumn(
        "n_rows", F.lit(sample.count()))


def linear_shap(vectors: DataFrame, prep: PrepModel, model, key: str, features: str = "features",
                n_rows: int | None = None, salt: str = "42|shap|") -> DataFrame:
    """EXP4 for linear models: phi_j = w_j (x_j - mean_j) on the margin, per row and slot."""
    names = prep.output_names()
    coef = model.coefficients.toArray().tolist()
    x = vectors.withColumn("__x", vector_to_array(F.col(features)))
    means = x.agg(*[F.avg(F.col("__x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    sample = _sample(x, n_rows, key, salt)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("__x")[i].alias("value"),
                              (F.lit(coef[i]) * (F.col("__x")[i] - F.lit(means[f"m{i}"] or 0.0))).alias("phi"))
                     for i, n in enumerate(names)])
    return sample.select(key, F.explode(rows).alias("s")).select(key, "s.*")


def tree_shap(vectors: DataFrame, prep: PrepModel, model, key: str, features: str = "features", n_rows: int | None = None,
              salt: str = "42|shap|") -> DataFrame:
    """EXP4 for tree ensembles: exact attributions of the margin (random forest: of the probability) per row and slot.

    A row's values sum to its margin less the mean margin of the training rows."""
    paths = model.paths()

    def phi(batch: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.array(batch.tolist(), dtype=float).reshape(len(batch), -1))
        return pd.Series(list(model.attributions(x, paths)))

    sample = _sample(vectors, n_rows, key, salt)
    x = sample.select(key, vector_to_array(F.col(features)).alias("__x"))
    y = x.withColumn("__phi", F.pandas_udf(phi, "array<double>")("__x"))
    names = F.array(*[F.lit(n) for n in prep.output_names()])
    return y.select(key, F.inline(F.arrays_zip(names.alias("feature"), F.col("__x").alias("value"), F.col("__phi").alias("phi"))))


def mean_abs_shap(shap: DataFrame, top: int = 20) -> DataFrame:
    """EXP5: features by mean |phi|, top 20."""
    return shap.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(
        F.col("mean_abs_phi").desc(), "feature").limit(top)


def normalised_values(shap: DataFrame) -> DataFrame:
    """EXP6: min-max normalised feature value beside phi (per feature: one small aggregate, broadcast)."""
    mm = shap.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    j = shap.join(F.broadcast(mm), "feature")
    rng = F.col("mx") - F.col("mn")
    return j.select(*shap.columns, F.when(rng > 0, (F.col("value") - F.col("mn")) / rng).otherwise(0.5)
                    .alias("value_norm"))


def top_importance(imp: DataFrame, n: int = 15) -> DataFrame:
    """EXP7: top-n slots with signed importance."""
    return imp.orderBy(F.col("importance").desc(), "feature").limit(n).select(
        "feature", (F.col("importance") * F.col("sign")).alias("signed_importance"))


def sampled_shap(df: DataFrame, raw_cols: list[str], numeric_cols: list[str], score_fn, key: str,
                 n_rows: int | None = None, n_perm: int = 8, seed: int = C.RANDOM_STATE,
                 salt: str = "42|shap|") -> DataFrame:
    """EXP4 for any model: sampled permutation Shapley values (Strumbelj-Kononenko) on P(churn).

    Every row x meets, in each of ``n_perm`` rounds, a feature order (seeded) and a
    background row z of its own (a hashed permutation of the rows). Step t of a
    round takes the first t features of the order from x, the others from z; the
    feature added between two steps gets the difference of their scores. A row's
    values sum to f(x) minus the mean score of its background rows.
    ``score_fn`` keeps the columns in ``SHAP_KEEP``.
    """
    rng = np.random.default_rng(seed)
    d = len(raw_cols)
    orders = [rng.permutation(d).tolist() for _ in range(n_perm)]
    place = [[order.index(c) for order in orders] for c in range(d)]   # by feature: its place in every order
    sample = _sample(df, n_rows, key, salt).select(key, *[F.col(f"`{c}`") for c in raw_cols])
    stack = _with_partner(sample, raw_cols, key, n_perm, salt).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(d))))

    def of_round(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__k") + 1)

    mixed = stack.select(key, "__k", "__t", *[
        F.when(of_round(place[i]) < F.col("__t"), F.col(f"`{c}`")).otherwise(F.col(f"__z{i}")).alias(c)
        for i, c in enumerate(raw_cols)])
    scored = score_fn(mixed)
    order = F.element_at(F.array(*[F.array(*[F.lit(j) for j in o]) for o in orders]), F.col("__k") + 1)
    ends = F.array(F.struct(F.get(order, F.col("__t") - 1).alias("__j"), F.col("p").alias("v")),
                   F.struct(F.get(order, F.col("__t")).alias("__j"), (-F.col("p")).alias("v")))
    steps = scored.select(key, F.explode(ends).alias("e")).select(key, "e.*").filter("__j is not null")
    phi = steps.groupBy(key, "__j").agg((F.sum("v") / n_perm).alias("phi"))
    names = F.array(*[F.lit(c) for c in raw_cols])
    vals = sample.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("__j"),
                 (F.col(f"`{c}`").cast("double") if c in numeric_cols else F.lit(None).cast("double")).alias("value"))
        for i, c in enumerate(raw_cols)])).alias("v")).select(key, "v.*")
    return phi.join(vals, [key, "__j"]).select(key, F.element_at(names, F.col("__j") + 1).alias("feature"),
                                                "value", "phi")
