"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Names are the lower-case operator IDs of the survey inventory. Several IDs
are columns of one operator output; each query projects what its ID computes.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.operators import neighbours as NB
from churnspark.operators.signal import assess_signal
from churnspark.plans.inputs import CLEAN, DOCS, RAW, Input
from churnspark.session import stored
from churnspark.sources import fixtures as FX
from churnspark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _signal(spark: SparkSession, sf_dir: str, inp: Input):
    return assess_signal(inp.build(spark, sf_dir), inp.target, inp.id_col)


# --- views -----------------------------------------------------------------------
register("view_customer_features")(FX.customer_features)
register("view_customer_features_imb")(FX.customer_features_imb)
register("view_customer_raw")(FX.customer_raw)
register("view_doc_features")(FX.doc_features)
register("view_user_events")(FX.user_events)
register("view_scored")(FX.scored)

# --- signal assessment ----------------------------------------------------------------
SIGNAL_COLS = ["feature", "type", "signal", "tier", "mean_diff", "d", "r", "mi", "cramers_v",
               "chi2", "dof", "ig", "explanation"]


def _r6(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals for engine-independent comparison."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(F.round(F.col(f.name), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


for _suffix, _inp in (("", RAW), ("_clean", CLEAN), ("_docs", DOCS)):
    def _mk(inp):
        def features(spark, sf_dir):
            return _r6(_signal(spark, sf_dir, inp).features.select(*SIGNAL_COLS))

        def summary(spark, sf_dir):
            return _signal(spark, sf_dir, inp).summary
        return features, summary
    _f, _s = _mk(_inp)
    register(f"sig{_suffix}")(_f)
    register(f"sig_summary{_suffix}")(_s)


def _sig_cols(cols, kind=None, inp=RAW):
    def q(spark, sf_dir):
        f = _signal(spark, sf_dir, inp).features
        if kind:
            f = f.filter(F.col("type") == kind)
        return _r6(f.select(*cols))
    return q


register("sig1")(lambda spark, sf_dir: _sig1(spark, sf_dir))
register("sig5_neighbours")(lambda spark, sf_dir: _r6(NB.neighbour_mi(CLEAN.build(spark, sf_dir), CF_NUMERIC)))
register("sig2")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).routing)
register("sig3")(_sig_cols(["feature", "d", "mean_diff"], "Numerical"))
register("sig4")(_sig_cols(["feature", "r"], "Numerical"))
register("sig5")(_sig_cols(["feature", "mi"], "Numerical"))
register("sig6")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).contingency)
register("sig7")(_sig_cols(["feature", "cramers_v", "chi2", "dof"], "Categorical"))
register("sig8")(_sig_cols(["feature", "chi2", "dof", "p_value"], "Categorical"))
register("sig9")(_sig_cols(["feature", "ig"], "Categorical"))
register("sig10")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).contingency.groupBy("feature").agg(
    F.count(F.lit(1)).alias("n_values"), F.sum(F.col("n_neg") + F.col("n_pos")).alias("n_rows")))
register("sig11")(_sig_cols(["feature", "signal"], "Numerical"))
register("sig12")(_sig_cols(["feature", "signal"], "Categorical"))
register("sig13")(_sig_cols(["feature", "tier"]))
register("sig14")(_sig_cols(["feature", "explanation"]))
register("sig15")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).summary.select(
    "overall_score", "potential_label"))
register("sig16")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).summary.select(
    "n_strong", "n_medium", "n_weak", "n_total", "top_features", "weak_features"))
register("sig17")(lambda spark, sf_dir: _signal(spark, sf_dir, RAW).summary.select("explanation"))


def _sig1(spark, sf_dir):
    """SIG1 per-class sample of the assessment, at the feature's own size."""
    from churnspark.operators.split import stratified_take
    from churnspark.functions.exprs import lenient_target
    cf = CLEAN.build(spark, sf_dir)
    x = cf.withColumn("__y", lenient_target(F.col("label"), cf.schema["label"].dataType))
    kept = stratified_take(x, "__y", C.SIGNAL_MAX_ROWS // 2, key_cols=["c_custkey"])
    return kept.groupBy("__y").agg(F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("__y", "label")


@register("sig18")
def _sig18(spark, sf_dir):
    """SIG18 guard: a target with one class gives the typed error row."""
    cf = CLEAN.build(spark, sf_dir).withColumn("label", F.lit(1))
    return assess_signal(cf, "label", "c_custkey").summary.select("overall_score", "potential_label", "error")


# --- evaluation on the scored view -------------------------------------------------------
from churnspark.operators import metrics as M  # noqa: E402
from churnspark.operators import score as S  # noqa: E402


def _scored(spark, sf_dir):
    return FX.scored(spark, sf_dir)


def _q(fn):
    def q(spark, sf_dir):
        return _r6(fn(_scored(spark, sf_dir)))
    return q


register("evl1")(_q(lambda s: M.ranking_metrics(s).select("model", "roc_auc")))
register("evl2")(_q(lambda s: M.ranking_metrics(s).select("model", "pr_auc")))


@register("evl3")
def _evl3(spark, sf_dir):
    s = _scored(spark, sf_dir)
    default = M.confusion(s).withColumn("kind", F.lit("default"))
    bt = M.best_threshold(M.threshold_curve(s))
    opt = M.confusion(s.join(bt.select("model", "best_threshold"), "model"),
                      threshold=F.col("best_threshold"), strict=False).withColumn("kind", F.lit("optimal"))
    return default.unionByName(opt)


register("evl4")(_q(lambda s: M.rates(M.confusion(s)).drop("tp", "fp", "tn", "fn")))
register("evl5")(_q(lambda s: M.classification_report(s)))
register("evl6")(_q(lambda s: M.threshold_curve(s)))
register("evl7")(_q(lambda s: M.best_threshold(M.threshold_curve(s))))
register("evl8")(_q(lambda s: M.evaluate(s).select("model", "best_overall_score")))
register("evl9")(_q(lambda s: M.evaluate(s)))
register("evl10")(_q(lambda s: M.pick_best(M.evaluate(s)).select("model", "best_overall_score")))
register("evl11")(_q(lambda s: M.cv_evaluate(s)))


@register("evl12")
def _evl12(spark, sf_dir):
    s = _scored(spark, sf_dir)
    train = M.ranking_metrics(s.filter(F.col("fold") != 0))
    test = M.ranking_metrics(s.filter(F.col("fold") == 0))
    return _r6(M.overfit_report(train, test, cv_auc=M.cv_evaluate(s)))


register("evl13")(_q(lambda s: M.brier(s)))
register("evl17")(_q(lambda s: M.comparison_table(M.evaluate(s))))
register("evl18")(_q(lambda s: M.roc_curve(s)))
register("evl19")(_q(lambda s: M.pr_curve(s)))
register("evl20")(lambda spark, sf_dir: M.metric_bands(M.evaluate(_scored(spark, sf_dir))))

# --- scoring outputs on the scored view ----------------------------------------------------


register("scr2")(lambda spark, sf_dir: S.predictions(_scored(spark, sf_dir), "c_custkey", keep=["model"]).drop(
    "risk_level"))


@register("scr3")
def _scr3(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("model", F.col("c_custkey").alias("customer_id"), S.risk_level(F.col("p")).alias("risk_level"))


register("scr4")(_q(lambda s: S.batch_summary(s, keys=["model"])))
register("scr5")(_q(lambda s: S.monitor(s, keys=["model"])))
register("scr6")(_q(lambda s: S.expected_at_threshold(M.threshold_curve(s), 0.5)))
register("scr7")(lambda spark, sf_dir: M.best_threshold(M.threshold_curve(_scored(spark, sf_dir))).select(
    "model", "best_threshold", S.sensitivity_mode(F.col("best_threshold")).alias("mode")))
register("scr8")(_q(lambda s: S.rethreshold(s, [0.3, 0.5, 0.7], keys=["model"])))
register("scr9")(_q(lambda s: S.probability_histogram(s, keys=["model"])))
register("scr10")(_q(lambda s: S.risk_breakdown(s, keys=["model"])))
register("scr11")(lambda spark, sf_dir: _r6(S.class_distribution(CLEAN.build(spark, sf_dir))))

# --- cleaning and profiling ------------------------------------------------------------
from churnspark.functions.exprs import bool_map_expr, clean_names, numeric_string, strict_target  # noqa: E402
from churnspark.operators import clean as CL  # noqa: E402
from churnspark.operators import profile as PR  # noqa: E402


def _raw_named(spark, sf_dir):
    return clean_names(RAW.build(spark, sf_dir))


register("cln1")(_raw_named)
register("cln2")(lambda spark, sf_dir: _r6(CL.decision_frame(RAW.build(spark, sf_dir))))
register("cln2_values")(lambda spark, sf_dir: _raw_named(spark, sf_dir).select(
    "customer_id", numeric_string(F.col("total_spend")).alias("total_spend"),
    numeric_string(F.col("nation")).alias("nation")))
register("cln3")(lambda spark, sf_dir: _raw_named(spark, sf_dir).select(
    "customer_id", bool_map_expr(F.col("has_urgent")).alias("has_urgent"),
    bool_map_expr(F.col("has_open")).alias("has_open"), bool_map_expr(F.col("churn")).alias("churn")))
register("cln4")(lambda spark, sf_dir: _raw_named(spark, sf_dir).select(
    "customer_id", strict_target(F.col("churn")).alias("label")))
register("cln5")(lambda spark, sf_dir: CL.target_frame(_raw_named(spark, sf_dir), "churn", "lenient").select(
    "customer_id", "y"))
register("cln6")(lambda spark, sf_dir: _r6(CL.churn_summary(_raw_named(spark, sf_dir), "churn")))
register("cln7")(lambda spark, sf_dir: CL.with_row_id(RAW.build(spark, sf_dir).drop("Customer ID"), None).select(
    "row_id"))


register("cln7_unique")(lambda spark, sf_dir: CL.with_row_id(RAW.build(spark, sf_dir).drop("Customer ID"), None).agg(
    F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids")))


@register("cln8")
def _cln8(spark, sf_dir):
    """Full cleaning of the raw upload, then id, target and profiled drops pruned."""
    raw = RAW.build(spark, sf_dir)
    clean = CL.raw_clean(raw)
    prof = PR.profile(clean, "churn", "customer_id")
    drops = [r["column"] for r in prof.filter(F.col("drop_reason").isNotNull()).select("column").collect()]
    return CL.prune(clean, ["customer_id", "churn"] + drops)


def _prof_raw(spark, sf_dir):
    return _r6(PR.profile(_raw_named(spark, sf_dir), "churn", "customer_id"))


def _prof_clean(spark, sf_dir):
    return _r6(PR.profile(CLEAN.build(spark, sf_dir), "label", "c_custkey"))


register("prf16")(_prof_raw)
register("prf16_clean")(_prof_clean)
_PRF = {
    "prf1": lambda: ["column", "null_count", "null_pct"], "prf2": lambda: ["column", "n_unique"],
    "prf3": lambda: ["column", "top_value", "top_freq"],
    "prf4": lambda: ["column", (F.col("n_unique") <= 1).alias("is_constant"),
                     (F.coalesce(F.col("top_freq"), F.lit(0.0)) >= 0.98).alias("is_near_constant")],
    "prf5": lambda: ["column", "mean", "std", "skewness"],
    "prf6": lambda: ["column", (F.col("detected_type") == "datetime").alias("is_datetime")],
    "prf7": lambda: ["column", "detected_type"],
    "prf8": lambda: ["column", (F.col("detected_type") == "boolean").alias("is_boolean")],
    "prf9": lambda: ["column", "detected_type", "drop_reason"],
    "prf10": lambda: ["column", (F.col("detected_type") == "identifier").alias("is_identifier"), "is_id_like"],
    "prf11": lambda: ["column", "n_unique", "detected_type", "high_card"],
    "prf12": lambda: ["column", "drop_reason"], "prf13": lambda: ["column", "leak_warning"],
    "prf14": lambda: ["column", "missing_warning"],
}
for _k, _cols in _PRF.items():
    def _mkp(cols, clean):
        def q(spark, sf_dir):
            p = _prof_clean(spark, sf_dir) if clean else _prof_raw(spark, sf_dir)
            return p.select(*cols())
        return q
    register(_k)(_mkp(_cols, _k in ("prf5", "prf7")))
register("prf15")(lambda spark, sf_dir: PR.roles(_prof_raw(spark, sf_dir)))


@register("prf17")
def _prf17(spark, sf_dir):
    return PR.id_candidates(RAW.build(spark, sf_dir))


@register("prf18")
def _prf18(spark, sf_dir):
    raw = RAW.build(spark, sf_dir)
    name = PR.detect_target_column(raw)
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("target_column"), "n_rows")


register("prf19")(lambda spark, sf_dir: _r6(PR.dataset_warnings(FX.customer_features_imb(spark, sf_dir))))

# --- feature engineering, selection, split ---------------------------------------------------
from pyspark.sql import Window  # noqa: E402

from churnspark.operators import features as FE  # noqa: E402
from churnspark.operators import split as SP  # noqa: E402

CF_NUMERIC = ["c_nationkey", "c_acctbal", "n_orders", "total_spend", "avg_spend", "max_spend", "n_open", "n_final",
              "n_urgent", "tenure_days"]
CF_BOOL = ["has_urgent", "has_open", "has_big"]


def _roles(spark, sf_dir):
    """numeric and boolean feature columns of customer_features, as the profiler assigns them."""
    cf = CLEAN.build(spark, sf_dir)
    rows = PR.roles(PR.profile(cf, "label", "c_custkey")).collect()   # <= 4 rows
    r = {x["role"]: x["columns"] for x in rows}
    order = {c: i for i, c in enumerate(cf.columns)}
    key = order.get
    return cf, sorted(r.get("numeric", []), key=key), sorted(r.get("boolean", []), key=key)


def _feature_model(spark, sf_dir):
    cf, num, boo = _roles(spark, sf_dir)
    return cf, FE.FeatureEstimator().fit(cf, num, boo)


def _long(df: DataFrame, names: list[str], key: str = "c_custkey") -> DataFrame:
    if not names:
        return df.sparkSession.createDataFrame([], f"{key} long, feature string, value double")
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names])
    return df.select(key, F.explode(arr).alias("kv")).select(key, "kv.feature", "kv.value")


@register("fea1")
def _fea1(spark, sf_dir):
    cf, num, _ = _roles(spark, sf_dir)
    s = FE.numeric_summary(cf, num)
    w = Window.partitionBy("ratio_eligible").orderBy(F.col("variance").desc(), F.col("pos"))
    return _r6(s.select("column", "variance", "min", "ratio_eligible",
                        F.when(F.col("ratio_eligible"), F.row_number().over(w)).alias("variance_rank")))


@register("fea2")
def _fea2(spark, sf_dir):
    cf, m = _feature_model(spark, sf_dir)
    out = m.transform(cf, only_kept=False)
    return _long(out, [r[0] for r in m.ratios])   # one IEEE division: identical in any engine, not rounded


@register("fea3")
def _fea3(spark, sf_dir):
    cf, m = _feature_model(spark, sf_dir)
    out = m.transform(cf, only_kept=False)
    return _r6(_long(out, [r[0] for r in m.logs]))


@register("fea4")
def _fea4(spark, sf_dir):
    cf, m = _feature_model(spark, sf_dir)
    return _r6(m.transform(cf, only_kept=False).select("c_custkey", "feat_n_active_services"))


@register("fea5")
def _fea5(spark, sf_dir):
    cf, m = _feature_model(spark, sf_dir)
    names = list(m.expressions())
    return cf.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(n in m.keep).alias("kept"))
                            for n in names])).alias("r")).select("r.*")


def _train_part(spark, sf_dir):
    cf, m = _feature_model(spark, sf_dir)
    sp = SP.stratified_split(m.transform(cf), "label", ["c_custkey"])
    return sp.filter(F.col("split") == "train"), m


@register("fea6")
def _fea6(spark, sf_dir):
    train, m = _train_part(spark, sf_dir)
    return FE.correlation_dedup(train, m.keep)


@register("fea7")
def _fea7(spark, sf_dir):
    train, m = _train_part(spark, sf_dir)
    return _r6(FE.binned_mi(train, m.keep))


@register("fea7_neighbours")
def _fea7_neighbours(spark, sf_dir):
    """The statistic of FEA7 by nearest neighbours, nulls as 0."""
    train, m = _train_part(spark, sf_dir)
    return _r6(NB.neighbour_mi(train, m.keep, fill=0.0))


@register("fea8")
def _fea8(spark, sf_dir):
    """Frozen plan fitted on the train part, replayed on the test part."""
    cf, num, boo = _roles(spark, sf_dir)
    sp = SP.stratified_split(cf, "label", ["c_custkey"])
    model = FE.FeatureEstimator().fit(sp.filter(F.col("split") == "train"), num, boo)
    test = sp.filter(F.col("split") == "test")
    out = _long(model.transform(test), model.keep)
    # ratios are one IEEE division (identical in any engine); logs are rounded to 6 decimals
    return out.withColumn("value", F.when(F.col("feature").endswith("_log"), F.round("value", 6))
                          .otherwise(F.col("value")))


register("spl1")(lambda spark, sf_dir: SP.stratified_split(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
                 .select("c_custkey", "label", "split"))
register("spl2")(lambda spark, sf_dir: SP.stratified_folds(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
                 .select("c_custkey", "label", "fold"))


@register("spl3")
def _spl3(spark, sf_dir):
    sp = SP.stratified_split(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
    train = sp.filter(F.col("split") == "train").drop("split")
    return SP.stratified_split(train, "label", ["c_custkey"], salt="42|cal|", split_col="cal_split").select(
        "c_custkey", "label", "cal_split")


register("spl4")(lambda spark, sf_dir: SP.hash_sample(CLEAN.build(spark, sf_dir), 300, ["c_custkey"]).select(
    "c_custkey"))


@register("set1")
def _set1(spark, sf_dir):
    sp = SP.stratified_split(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
    return SP.union_parts(sp.filter("split = 'train'"), sp.filter("split = 'test'")).select("c_custkey", "label")


SET2_KNOWN = ["c_custkey", "n_orders", "c_acctbal", "c_mktsegment", "tenure_days", "support_calls"]
register("set2")(lambda spark, sf_dir: SP.align_columns(
    CLEAN.build(spark, sf_dir), SET2_KNOWN, {"support_calls": "double"}))

# --- training, calibration, explanation (model fits: row-count checks) --------------------------
from churnspark.operators import advisor as AD  # noqa: E402
from churnspark.operators import explain as EX  # noqa: E402
from churnspark.operators import train as TR  # noqa: E402
from churnspark.plans import pipeline as PL  # noqa: E402

# The registered queries search with the library default, the original budget (30 trials x 5 folds, 300 trees, 500
# boosting rounds). Those whose feature is the comparison of families (trn8, trn13, evl22) search every family, trn10 those that stop
# early; those that need one trained plan (calibration, explanation, scoring, streams) search PLAN_MODEL. A search runs once per
# Spark application, table folder and set of models.
SEARCH_CONFIG = TR.TrainConfig()
ALL_MODELS = TR.PRODUCTION_MODELS + TR.REGISTRY_MODELS
PLAN_MODEL = "LightGBM"
EARLY_STOPPED = ("XGBoost", "LightGBM", "CatBoost")
_PIPELINES: dict = {}


def fits_models(name: str) -> bool:
    """Whether a registered query fits models (these run longest)."""
    return name.startswith(("trn", "exp", "stream_", "evl14", "evl15", "evl16", "evl21", "evl22", "scr1", "snk3")) and name not in (
        "trn9", "trn11", "trn12", "trn5_ordered", "scr10", "scr11") or name in ("scr4_model", "scr5_model")


def _prepared(spark, sf_dir):
    """Cleaned, split and engineered rows, before any model; one per Spark application and table folder."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _PIPELINES:
        _PIPELINES[k] = PL.prepare(RAW.build(spark, sf_dir), RAW.target, RAW.id_col, SEARCH_CONFIG)
    return _PIPELINES[k]


def _pipeline(spark, sf_dir, models=tuple(ALL_MODELS), finish=True):
    """A trained pipeline over ``models``; runs once per Spark application, table folder and models. ``finish``: with threshold, calibration
    and the final refit."""
    k = (spark.sparkContext.applicationId, sf_dir, models, finish)
    if k not in _PIPELINES:
        _PIPELINES[k] = PL.run_pipeline(RAW.build(spark, sf_dir), RAW.target, RAW.id_col, list(models), SEARCH_CONFIG, finish=finish)
    return _PIPELINES[k]


def _plan(spark, sf_dir):
    """The whole plan with one family at the full budget."""
    return _pipeline(spark, sf_dir, (PLAN_MODEL,))


def _family_row(name):
    def q(spark, sf_dir):
        return _pipeline(spark, sf_dir, (name,), finish=False).metrics.select(
            "model", "cv_roc_auc", "best_params", "error", "roc_auc", "pr_auc", "recall")
    return q


for _id, _name in (("trn1", "Logistic Regression"), ("trn2", "Random Forest"), ("trn3", "XGBoost"),
                   ("trn4", "LightGBM"), ("trn5", "CatBoost"), ("trn6", "Decision Tree"),
                   ("trn7", "Gradient Boosting")):
    register(_id)(_family_row(_name))
register("trn8")(lambda spark, sf_dir: _pipeline(spark, sf_dir, finish=False).metrics.select("model", "cv_roc_auc", "best_params"))


@register("trn9")
def _trn9(spark, sf_dir):
    """Trial budget from the training-row count (train part of the 80/20 split)."""
    sp = SP.stratified_split(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
    n = F.count(F.lit(1))
    return sp.filter(F.col("split") == "train").agg(n.alias("n_train")).select(
        "n_train", F.when(F.col("n_train") > 100_000, F.greatest(F.lit(10), F.lit(C.N_TRIALS // 3)))
        .when(F.col("n_train") > 50_000, F.greatest(F.lit(15), F.lit(C.N_TRIALS // 2)))
        .otherwise(F.lit(C.N_TRIALS)).alias("n_trials"))


register("trn10")(lambda spark, sf_dir: _pipeline(spark, sf_dir, EARLY_STOPPED, finish=False).metrics.filter(
    F.col("n_estimators").isNotNull()).select("model", "n_estimators"))


@register("trn11")
def _trn11(spark, sf_dir):
    """A family that fails is reported with its error, the others are unaffected."""
    cf = stored(SP.stratified_folds(CLEAN.build(spark, sf_dir), "label", ["c_custkey"], k=2), "folds")   # every fit reads the rows
    t = TR.Trainer(CF_NUMERIC, [], TR.TrainConfig(n_trials=1, folds=2, boost_cap=0, boost_floor=0))   # no boosting round: that family fails
    found = t.search_many(["Logistic Regression", "XGBoost"], cf, False)
    rows = [(n, r.cv_score, r.error) for n, r in found.items()]
    n_rows = cf.count()
    return spark.createDataFrame(rows, "model string, cv_roc_auc double, error string").withColumn("n_rows", F.lit(n_rows))


@register("trn12")
def _trn12(spark, sf_dir):
    res = _prepared(spark, sf_dir)
    meta = AD.meta_features(res.data.filter(F.col("split") == "train"), res.numeric, res.categorical)
    return AD.recommend(meta)


@register("trn13")
def _trn13(spark, sf_dir):
    """Every parameter draw of the search with its mean CV ROC-AUC (the grids as searched)."""
    res = _pipeline(spark, sf_dir, finish=False)
    rows = [(n, t, p, a) for n, r in res.families.items() for t, p, a in r.trials]
    return spark.createDataFrame(rows, "model string, trial int, params string, cv_roc_auc double")


def _calibration(spark, sf_dir, *methods):
    """What the plan's calibration found; a method that could not be fitted is an error, not an empty value."""
    c = _plan(spark, sf_dir).calibration
    failed = {m: c.get("errors", {}).get(m, "not fitted") for m in methods if c.get("candidates", {}).get(m) is None}
    if failed:
        raise RuntimeError(f"calibration failed: {failed}")
    return c


register("evl14")(lambda spark, sf_dir: spark.createDataFrame(
    [("sigmoid", _calibration(spark, sf_dir, "sigmoid")["candidates"]["sigmoid"])], "method string, brier double"))
register("evl15")(lambda spark, sf_dir: spark.createDataFrame(
    [("isotonic", _calibration(spark, sf_dir, "isotonic")["candidates"]["isotonic"])], "method string, brier double"))


@register("evl16")
def _evl16(spark, sf_dir):
    c = _calibration(spark, sf_dir, "sigmoid", "isotonic")
    return spark.createDataFrame([(c.get("brier_before"), c.get("brier_after"), c.get("method"),
                                   bool(c.get("calibrated")))],
                                 "brier_before double, brier_after double, method string, calibrated boolean")


@register("evl21")
def _evl21(spark, sf_dir):
    res = _plan(spark, sf_dir)
    return res.trainer.score(res.final, res.data).select("c_custkey" if "c_custkey" in res.data.columns
                                                         else res.trainer.key, "label", "p")


register("evl22")(lambda spark, sf_dir: spark.createDataFrame([(PL.report_json(_pipeline(spark, sf_dir)),)],
                                                              "report string"))


@register("exp1")
def _exp1(spark, sf_dir):
    names = EX.feature_names(_plan(spark, sf_dir).final.prep)
    return spark.createDataFrame(list(enumerate(names)), "slot int, feature string")


register("exp2")(lambda spark, sf_dir: EX.builtin_importance(spark, _plan(spark, sf_dir).final.prep,
                                                             _plan(spark, sf_dir).final.model))


@register("exp3")
def _exp3(spark, sf_dir):
    res = _plan(spark, sf_dir)
    test = res.data.filter(F.col("split") == "test")
    raw_cols = res.numeric + res.categorical
    key = res.trainer.key
    return EX.permutation_importance(
        test, raw_cols, lambda d: res.trainer.score(res.final, d, keep=[c for c in ("__f", "__k") if c in d.columns]),
        key)


def _shap(spark, sf_dir):
    """Sampled permutation Shapley values of the final (best) model on the test rows."""
    res = _plan(spark, sf_dir)
    test = res.data.filter(F.col("split") == "test")
    return EX.sampled_shap(test, res.numeric + res.categorical, res.numeric,
                           lambda d: res.trainer.score(res.final, d, keep=EX.SHAP_KEEP), res.trainer.key)


@register("exp4_linear")
def _shap_linear(spark, sf_dir):
    """Closed-form attributions of the tuned logistic regression."""
    res = _pipeline(spark, sf_dir, ("Logistic Regression",), finish=False)
    lr = res.families["Logistic Regression"]
    vec = lr.prep.transform(res.data, keep=[res.trainer.key])
    return EX.linear_shap(vec, lr.prep, lr.model, res.trainer.key)


@register("exp4_tree")
def _shap_tree(spark, sf_dir):
    """Exact attributions of the final tree ensemble's margin, every row of the data."""
    res = _plan(spark, sf_dir)
    vec = res.final.prep.transform(res.data, keep=[res.trainer.key])
    return EX.tree_shap(vec, res.final.prep, res.final.model, res.trainer.key)


register("exp4")(_shap)
register("exp5")(lambda spark, sf_dir: EX.mean_abs_shap(_shap(spark, sf_dir)))
register("exp6")(lambda spark, sf_dir: EX.normalised_values(_shap(spark, sf_dir)))
register("exp7")(lambda spark, sf_dir: EX.top_importance(EX.builtin_importance(
    spark, _plan(spark, sf_dir).final.prep, _plan(spark, sf_dir).final.model)))


@register("scr1")
def _scr1(spark, sf_dir):
    """Score a new batch with the frozen plans: clean -> features -> model (no refit, no re-decisions)."""
    res = _plan(spark, sf_dir)
    batch = res.clean.transform(RAW.build(spark, sf_dir))
    batch = res.features.transform(batch)
    scored = res.trainer.score(res.final, batch)
    return S.predictions(scored, res.trainer.key, res.threshold)

# --- sources, sinks, streaming ------------------------------------------------------------
from churnspark.sources import io as IO  # noqa: E402
from churnspark.streaming import scoring as ST  # noqa: E402


def _upload(spark, sf_dir, sep=";", encoding="UTF-8", extra=None):
    """The raw customer view written as an upload file (BOM in the header, given delimiter)."""
    raw = RAW.build(spark, sf_dir)
    first = raw.columns[0]
    df = raw.withColumnRenamed(first, IO.BOM + " " + first + " ")
    if extra is not None:
        df = df.withColumn("city", extra)
    path = IO.new_output_path(spark, "upload")
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


@register("src1")
def _src1(spark, sf_dir):
    return IO.read_csv(spark, _upload(spark, sf_dir, sep=";"))


@register("src2")
def _src2(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", IO.delimiter_expr(F.split(F.col("text"), "\n")[0]).alias("delimiter"))


@register("src3")
def _src3(spark, sf_dir):
    path = _upload(spark, sf_dir, sep=",", encoding="ISO-8859-1", extra=F.lit("Zürich"))
    df = IO.read_csv(spark, path)
    return df.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@register("src4")
def _src4(spark, sf_dir):
    df = IO.read_csv(spark, _upload(spark, sf_dir, sep="|"))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(df.columns[0]).alias("first_column"), "n_rows")


register("src5")(lambda spark, sf_dir: IO.shape_and_preview(read_table(spark, sf_dir, "customer"))[0])
register("src5_preview")(lambda spark, sf_dir: IO.shape_and_preview(read_table(spark, sf_dir, "customer"))[1])


@register("snk1")
def _snk1(spark, sf_dir):
    preds = S.predictions(FX.scored(spark, sf_dir), "c_custkey", keep=["model"])
    path = IO.write_predictions(preds, IO.new_output_path(spark, "predictions"))
    return spark.read.option("header", True).csv(path)


@register("snk2")
def _snk2(spark, sf_dir):
    summary = assess_signal(CLEAN.build(spark, sf_dir), "label", "c_custkey").summary.first().asDict()
    path = IO.write_report(spark, summary, IO.new_output_path(spark, "report"))
    return spark.read.text(path)


@register("snk3")
def _snk3(spark, sf_dir):
    res = _plan(spark, sf_dir)
    loaded = PL.load_pipeline(spark, PL.save_pipeline(res, IO.new_output_path(spark, "model")))
    return PL.score_new_customers(loaded, RAW.build(spark, sf_dir))["predictions"]


def _stream_source(spark, sf_dir):
    """The raw customer view split into files of a stream source folder."""
    raw = RAW.build(spark, sf_dir)
    path = IO.new_output_path(spark, "stream-source")
    raw.repartition(4).write.parquet(path)
    return path, raw.schema


@register("stream_score")
def _stream_score(spark, sf_dir):
    res = _plan(spark, sf_dir)
    src, schema = _stream_source(spark, sf_dir)
    sink, _ = ST.run_scoring(spark, src, schema, res)
    return spark.read.parquet(sink)


@register("stream_monitor")
def _stream_monitor(spark, sf_dir):
    res = _plan(spark, sf_dir)
    src, schema = _stream_source(spark, sf_dir)
    return spark.read.parquet(ST.run_monitor(spark, src, schema, res))

# --- preprocessing plans fitted on the training part ------------------------------------------
from churnspark.operators import prep as PP  # noqa: E402

PRE_NUM = CF_NUMERIC + CF_BOOL
PRE_CAT = ["c_mktsegment"]


def _train_rows(spark, sf_dir):
    sp = SP.stratified_split(CLEAN.build(spark, sf_dir), "label", ["c_custkey"])
    return sp.filter(F.col("split") == "train").drop("split"), sp


@register("pre1")
def _pre1(spark, sf_dir):
    train, _ = _train_rows(spark, sf_dir)
    m = PP.PrepEstimator(PRE_NUM, []).fit(train)
    return spark.createDataFrame([(c, float(v) if v is not None else None) for c, v in m.medians.items()],
                                 "column string, median double").transform(_r6)


@register("pre2")
def _pre2(spark, sf_dir):
    train, sp = _train_rows(spark, sf_dir)
    m = PP.PrepEstimator(PRE_NUM, [], scale=True).fit(train)
    cols = m.columns()
    wide = sp.select("c_custkey", *cols)
    return _r6(_long(wide, [f"num__{c}" for c in PRE_NUM]))


@register("pre3")
def _pre3(spark, sf_dir):
    train, _ = _train_rows(spark, sf_dir)
    m = PP.PrepEstimator([], PRE_CAT).fit(train)
    return spark.createDataFrame(list(m.modes.items()), "column string, mode string")


@register("pre4")
def _pre4(spark, sf_dir):
    train, sp = _train_rows(spark, sf_dir)
    m = PP.PrepEstimator([], PRE_CAT).fit(train)
    wide = sp.select("c_custkey", *m.columns())
    names = m.output_names()
    return _long(wide, names).filter(F.col("value") != 0)


@register("pre5")
def _pre5(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    train, sp = _train_rows(spark, sf_dir)
    m = PP.PrepEstimator(PRE_NUM, PRE_CAT).fit(train)
    return m.transform(sp, keep=["c_custkey"]).select("c_custkey", F.size(vector_to_array("features")).alias("n_slots"))


@register("trn5_ordered")
def _trn5_ordered(spark, sf_dir):
    """Ordered target statistics of the training rows (what the CatBoost family trains on)."""
    train, _ = _train_rows(spark, sf_dir)
    prior = train.agg(F.avg("label")).first()[0] or 0.0
    modes = PP.PrepEstimator([], PRE_CAT).fit(train).modes
    return _r6(PP.ordered_target_stats(train, PRE_CAT, modes, float(prior), "label", "c_custkey").select("c_custkey", *[f"te__{c}" for c in PRE_CAT]))


register("pre6")(lambda spark, sf_dir: _r6(PP.class_weights(_train_rows(spark, sf_dir)[0]).select(
    "label", "n_c", "balanced_weight")))
register("pre7")(lambda spark, sf_dir: _r6(PP.class_weights(_train_rows(spark, sf_dir)[0]).select(
    "label", "scale_pos_weight")))


@register("stream_window_monitor")
def _stream_window_monitor(spark, sf_dir):
    res = _plan(spark, sf_dir)
    src, schema = _stream_source(spark, sf_dir)
    return ST.latest_windows(spark, ST.run_windowed_monitor(spark, src, schema, res))


@register("scr4_model")
def _scr4_model(spark, sf_dir):
    """Batch summary of the trained model's predictions for the upload (SCR4 on real scores)."""
    return PL.score_new_customers(_plan(spark, sf_dir), RAW.build(spark, sf_dir))["summary"]


@register("scr5_model")
def _scr5_model(spark, sf_dir):
    """Churn-rate monitor of the trained model's predictions against the training rate."""
    return PL.score_new_customers(_plan(spark, sf_dir), RAW.build(spark, sf_dir))["monitor"]
