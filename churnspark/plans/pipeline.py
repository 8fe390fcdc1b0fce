"""End-to-end training plan (the original's "run pipeline") on Spark.

load -> clean (frozen plan) -> strict target -> profile -> prune -> split ->
engineer features (fitted on train) -> select (train) -> folds -> train and
tune every family -> evaluate all on test in one job -> pick best ->
cross-validated threshold -> calibrate -> refit on all rows.

Every step is a DataFrame job; what reaches the driver is one row per
column, model, fold or threshold.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.operators import metrics as M
from churnspark.operators.clean import CleanEstimator, CleanModel, convert_target, prune, with_row_id
from churnspark.operators.features import FeatureEstimator, FeatureModel, select_features
from churnspark.operators.isotonic import IsotonicModel, fit_isotonic
from churnspark.operators.profile import profile as profile_frame
from churnspark.operators.split import align_columns, stratified_folds, stratified_split
from churnspark.session import ensure_checkpoint_dir, stored
from churnspark.sources.io import load_model, save_model
from churnspark.operators.train import (FamilyResult, TrainConfig, Trainer, apply_platt, brier_of, choose_calibration,
                                        fit_platt, lost, params_json)


@dataclass
class PipelineResult:
    clean: CleanModel
    profile: DataFrame | None
    drops: dict
    features: FeatureModel
    selected: list[str]
    numeric: list[str]
    categorical: list[str]
    data: DataFrame | None               # cleaned, pruned, engineered rows with split
    families: dict = field(default_factory=dict)
    test_predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    best: str | None = None
    cv: DataFrame | None = None
    threshold: float = 0.5
    fold_thresholds: list = field(default_factory=list)
    calibration: dict = field(default_factory=dict)
    final: FamilyResult | None = None
    calibrator: tuple | None = None      # (method, fitted calibrator) that the final model applies
    columns: dict = field(default_factory=dict)   # cleaned training columns and their types
    churn_rate: float | None = None
    is_imbalanced: bool = False
    trainer: Trainer | None = None
    timings: dict = field(default_factory=dict)


def _mark(timings: dict, name: str, t0: list) -> None:
    now = time.time()
    timings[name] = round(now - t0[0], 3)
    t0[0] = now


ROW_ID = "row_id"


def _name(column: str) -> str:
    return column.strip().lower().replace(" ", "_").replace("-", "_")


def prepare(raw: DataFrame, target: str, id_col: str | None, cfg: TrainConfig | None = None) -> PipelineResult:
    """Everything before the models: cleaned, pruned, split and engineered rows with a trainer for them.

    Without an id column the rows get a reproducible id (CLN7)."""
    cfg = cfg or TrainConfig()
    timings: dict = {}
    t0 = [time.time()]
    if id_col is None:
        raw, id_col = with_row_id(raw, None, ROW_ID), ROW_ID
    ensure_checkpoint_dir(raw.sparkSession)
    raw = raw.checkpoint(eager=True)   # the upload is a plan of its own; read it once
    cm = CleanEstimator().fit(raw)
    df = cm.transform(raw)
    t = _name(target)
    key = _name(id_col)
    df = convert_target(df, t, out="label")
    if t != "label":
        df = df.drop(t)
    # profile, split, feature fit and selection each read the cleaned rows: materialise them once
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    cleaned = df
    prof = profile_frame(df, "label", key)
    prow = prof.select("column", "detected_type", "drop_reason").collect()   # one row per column
    drops = {r["column"]: r["drop_reason"] for r in prow if r["drop_reason"]}
    kept = [r for r in prow if not r["drop_reason"]]
    numeric = [r["column"] for r in kept if r["detected_type"] == "numeric"]
    boolean = [r["column"] for r in kept if r["detected_type"] == "boolean"]
    categorical = [r["column"] for r in kept if r["detected_type"] == "categorical"]
    df = prune(df, list(drops))
    rate_row = df.agg(F.avg(F.col("label").cast("double")).alias("r")).first()
    churn_rate = rate_row["r"]
    imb = churn_rate is not None and (churn_rate < C.IMBALANCE_LOW or churn_rate > C.IMBALANCE_HIGH)

    sp = stratified_split(df, "label", [key])
    train = sp.filter(F.col("split") == "train")
    fm = FeatureEstimator().fit(train, numeric, boolean)          # Q7: fitted on train rows only
    sp = fm.transform(sp)
    train = sp.filter(F.col("split") == "train")
    selected = select_features(train, fm.keep, "label")
    extra = [n for n in fm.keep if n not in selected]
    # cut the lineage once: every fit below starts from this checkpoint (in spark.checkpoint.dir)
    ensure_checkpoint_dir(raw.sparkSession)
    sp = sp.drop(*extra).checkpoint(eager=True)
    cleaned.unpersist()
    _mark(timings, "prepare", t0)
    num_all = numeric + boolean + selected
    columns = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != "label"}
    return PipelineResult(clean=cm, profile=prof, drops=drops, features=fm, selected=selected, numeric=num_all,
                          categorical=categorical, data=sp, churn_rate=churn_rate, is_imbalanced=imb, columns=columns,
                          trainer=Trainer(num_all, categorical, cfg, key=key, label="label"), timings=timings)


def run_pipeline(raw: DataFrame, target: str, id_col: str | None, models: list[str] | None = None,
                 cfg: TrainConfig | None = None, finish: bool = True) -> PipelineResult:
    """The whole plan; ``finish=False`` ends after the test metrics (no threshold, calibration or final refit)."""
    cfg = cfg or TrainConfig()
    models = models or ["Logistic Regression", "Random Forest", "XGBoost", "LightGBM", "CatBoost"]
    res = prepare(raw, target, id_col, cfg)
    timings, t0 = res.timings, [time.time()]
    trainer, sp, key, imb = res.trainer, res.data, res.trainer.key, res.is_imbalanced
    train = sp.filter(F.col("split") == "train")
    test = sp.filter(F.col("split") == "test")
    train_f = stored(stratified_folds(train, "label", [key], k=cfg.folds), "folds")
    res.families = trainer.search_many(list(models), train_f, imb)
    trainer.release()
    _mark(timings, "search", t0)

    ok = [n for n, r in res.families.items() if r.error is None]
    if not ok:
        raise RuntimeError("no family could be trained: " + "; ".join(f"{n}: {r.error}" for n, r in res.families.items()))
    preds, train_preds = None, None
    for n in ok:
        p = trainer.score(res.families[n], test).select(F.lit(n).alias("model"), key, "label", "p")
        q = trainer.score(res.families[n], train).select(F.lit(n).alias("model"), key, "label", "p")
        preds = p if preds is None else preds.unionByName(p)
        train_preds = q if train_preds is None else train_preds.unionByName(q)
    preds, train_preds = stored(preds, "test-scores"), stored(train_preds, "train-scores")   # the metrics read them several times
    res.test_predictions = preds
    spark = raw.sparkSession
    info = spark.createDataFrame(
        [(n, r.cv_score, params_json(r.params), r.n_estimators, float(r.train_time), r.error)
         for n, r in res.families.items()],
        "model string, cv_roc_auc double, best_params string, n_estimators int, train_time double, error string")
    ev = M.evaluate(preds)
    tr = M.ranking_metrics(train_preds).select("model", F.col("roc_auc").alias("train_roc_auc"))
    res.metrics = info.join(ev, "model", "left").join(tr, "model", "left")
    best_row = M.pick_best(ev).first()
    res.best = best_row["model"] if best_row else None
    _mark(timings, "evaluate", t0)
    if finish and res.best:
        fam = res.families[res.best]
        # CV threshold, calibration and the final refit are independent jobs: run them side by side
        with ThreadPoolExecutor(max_workers=3) as ex:
            cv = ex.submit(_cross_validate, res, sp, key, cfg)
            cal = ex.submit(_calibrate, res, train, test, key)
            fin = ex.submit(trainer.refit, res.best, fam.params, sp, imb, fam.n_estimators)   # EVL21: all rows
            cv.result()
            cal.result()
            prep, model = fin.result()
        res.final = FamilyResult(res.best, fam.params, fam.cv_score, fam.n_estimators, prep, model, calibrator=res.calibrator)
    _mark(timings, "cv_calibrate_refit", t0)
    res.timings = timings
    return res


def _cross_validate(res: PipelineResult, rows: DataFrame, key: str, cfg: TrainConfig):
    """EVL11: out-of-fold scores of the best configuration over all rows, per-fold thresholds."""
    fam = res.families[res.best]
    folds = stored(stratified_folds(rows, "label", [key], k=cfg.folds), "cv-folds")

    oof = res.trainer.out_of_fold(res.best, fam.params, folds, res.is_imbalanced, fam.n_estimators).select(
        F.lit(res.best).alias("model"), "fold", "label", "p")
    res.cv = M.cv_evaluate(oof)
    row = res.cv.first()
    res.threshold = float(row["cv_avg_threshold"]) if row and row["cv_avg_threshold"] is not None else 0.5
    bt = M.best_threshold(M.threshold_curve(oof, ["model", "fold"]), ["model", "fold"]).orderBy("fold").collect()
    res.fold_thresholds = [round(float(x["best_threshold"]), 2) for x in bt]


def _calibrate(res: PipelineResult, train: DataFrame, test: DataFrame, key: str):
    """EVL13-16: sigmoid and isotonic on a held-out part of train; kept if the test Brier drops by > 0.001."""
    fam = res.families[res.best]
    before = brier_of(res.trainer.score(fam, test), "p")
    sub = stratified_split(train.drop("fold") if "fold" in train.columns else train, "label", [key],
                           salt="42|cal|", split_col="cal_split")
    sub = stored(sub, "calibration")
    fit_part = sub.filter(F.col("cal_split") == "train")
    val_part = sub.filter(F.col("cal_split") == "test")
    prep, model = res.trainer.refit(res.best, fam.params, fit_part, res.is_imbalanced, fam.n_estimators)
    clone = FamilyResult(res.best, prep=prep, model=model)
    val_p = stored(res.trainer.score(clone, val_part).select("label", "p"), "calibration-scores")   # the fits and scores below read them again
    test_p = stored(res.trainer.score(clone, test).select("label", "p"), "calibration-scores")
    cands, fitted, errors = _calibrators(val_p, test_p)
    method, after = choose_calibration(before, cands)
    res.calibration = {"brier_before": before, "candidates": cands, "method": method, "brier_after": after,
                       "calibrated": method is not None} | ({"errors": errors} if errors else {})
    res.calibrator = (method, fitted[method]) if method else None


def _calibrators(val_p: DataFrame, test_p: DataFrame) -> tuple[dict, dict, dict]:
    """Per method the Brier score on the test scores and the fitted calibrator, or the reason why it could not be fitted; work that the engine
    lost is raised."""
    cands, fitted, errors = {}, {}, {}
    for method, fit, apply in (("sigmoid", fit_platt, apply_platt), ("isotonic", fit_isotonic, lambda m, df: m.apply(df))):
        try:
            model = fit(val_p)
            cands[method], fitted[method] = brier_of(apply(model, test_p), "p_cal"), model
        except Exception as exc:  # noqa: BLE001
            if lost(exc):
                raise
            errors[method] = f"{type(exc).__name__}: {exc}"[:500]
    return cands, fitted, errors


def comparison(res: PipelineResult) -> DataFrame:
    """EVL17 of a result: all families, failed ones included, the winner with its cross-validated values."""
    m = res.metrics
    for n in ("pr_auc", "recall", "roc_auc", "best_overall_score"):
        m = m if n in m.columns else m.withColumn(n, F.lit(None).cast("double"))
    return M.comparison_table(m, res.cv)


def overfit(res: PipelineResult) -> DataFrame:
    """EVL12 of a result: the families that were fitted, with the mean ROC-AUC of their search folds."""
    m = res.metrics.filter("error is null")
    return M.overfit_report(m.select("model", F.col("train_roc_auc").alias("roc_auc")), m, cv_auc=m)


def final_report(res: PipelineResult) -> dict:
    """EVL22: the report as a nested dict (JSON-serialisable)."""
    rows = res.metrics.collect() if res.metrics is not None else []
    return {
        "best_model": res.best,
        "threshold": res.threshold,
        "fold_thresholds": res.fold_thresholds,
        "churn_rate": res.churn_rate,
        "is_imbalanced": res.is_imbalanced,
        "dropped_columns": res.drops,
        "engineered_features": res.selected,
        "calibration": res.calibration,
        "timings_sec": res.timings,
        "comparison": [r.asDict() for r in comparison(res).orderBy("rank").collect()] if rows else [],
        "overfit": [r.asDict() for r in overfit(res).collect()] if rows and "roc_auc" in res.metrics.columns else [],
        "models": {r["model"]: {k: r[k] for k in r.asDict() if k != "model"} for r in rows},
    }


def report_json(res: PipelineResult) -> str:
    return json.dumps(final_report(res), default=str, sort_keys=True)


def new_rows(res: PipelineResult, raw: DataFrame) -> DataFrame:
    """Rows of a new upload with the frozen plans: cleaned, aligned to the training columns (missing ones null, extras
    dropped), engineered. Works on streams as well."""
    key = res.trainer.key
    if key == ROW_ID and ROW_ID not in raw.columns:
        raw = with_row_id(raw, None, ROW_ID)
    return res.features.transform(align_columns(res.clean.transform(raw), list(res.columns), res.columns))


def score_new_customers(res: PipelineResult, raw: DataFrame, threshold: float | None = None) -> dict:
    """The scoring plan for a new batch: frozen clean -> frozen features -> model -> outputs.

    Returns lazy frames: predictions (SCR1-3), summary (SCR4) and monitor (SCR5 against the
    training churn rate). Narrow transformations only until the two small aggregates.
    """
    from churnspark.operators import score as S
    t = res.threshold if threshold is None else threshold
    scored = res.trainer.score(res.final, new_rows(res, raw))
    preds = S.predictions(scored, res.trainer.key, t)
    summary = S.batch_summary(scored, t)
    rate = F.col("churning") / F.greatest(F.col("total"), F.lit(1))
    monitor = summary.select(*S.churn_monitor(rate, F.lit(float(res.churn_rate or 0.0))))
    return {"predictions": preds, "summary": summary, "monitor": monitor}


#: Fields of a result that scoring a new upload needs beside the fitted plans and the model.
SAVED = ("selected", "numeric", "categorical", "columns", "threshold", "churn_rate", "is_imbalanced", "drops", "best")


def save_pipeline(res: PipelineResult, path: str) -> str:
    """SNK3: the whole scoring plan: cleaning, features, columns, preprocessing, model, calibrator, threshold, churn rate."""
    save_model(res.final, path)
    method, fitted = res.final.calibrator or (None, None)
    if method == "sigmoid":
        fitted.write().overwrite().save(f"{path}/calibrator")
    elif method == "isotonic":
        fitted.save(f"{path}/calibrator")
    plan = {name: getattr(res, name) for name in SAVED}
    plan |= {"clean": res.clean.to_json(), "features": res.features.to_json(), "calibrator": method,
             "key": res.trainer.key, "label": res.trainer.label}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(plan),)], "plan string").coalesce(1).write.mode("overwrite").json(f"{path}/plan")
    return path


def load_pipeline(spark: SparkSession, path: str) -> PipelineResult:
    """A saved scoring plan; it scores uploads and streams like the result it was saved from (no training rows or metrics)."""
    plan = json.loads(spark.read.json(f"{path}/plan").first()["plan"])
    readers = {"sigmoid": LogisticRegressionModel.load, "isotonic": lambda p: IsotonicModel.load(spark, p)}
    method = plan["calibrator"]
    final = load_model(spark, path)
    final.calibrator = (method, readers[method](f"{path}/calibrator")) if method else None
    return PipelineResult(
        clean=CleanModel.from_json(plan["clean"]), features=FeatureModel(**json.loads(plan["features"])), profile=None, data=None,
        final=final, calibrator=final.calibrator,
        trainer=Trainer(plan["numeric"], plan["categorical"], key=plan["key"], label=plan["label"]),
        **{name: plan[name] for name in SAVED})
