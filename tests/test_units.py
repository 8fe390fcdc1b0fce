"""Driver-side rules: budgets, early stopping, calibration choice, recommendations, names."""
from pyspark.sql import functions as F

from churnspark.operators import advisor as AD
from churnspark.operators.features import ratio_plan, squeezed
from churnspark.operators.signal import assess_signal
from churnspark.operators.train import best_iteration, choose_calibration, trial_budget
from churnspark.sources import fixtures as FX
from tests.conftest import SF_SMALL


def test_trial_budget():
    assert trial_budget(5_000) == 30
    assert trial_budget(60_000) == 15
    assert trial_budget(150_000) == 10


def test_best_iteration_patience():
    losses = [5, 4, 3, 3.5, 3.6, 3.7, 2.0]
    assert best_iteration(losses, patience=3) == 3     # stops before the late improvement
    assert best_iteration(losses, patience=10) == 7


def test_calibration_needs_real_gain():
    assert choose_calibration(0.200, {"sigmoid": 0.1995, "isotonic": 0.1999}) == (None, 0.1995)
    assert choose_calibration(0.200, {"sigmoid": 0.198, "isotonic": 0.190}) == ("isotonic", 0.190)


def test_ratio_names():
    assert squeezed("Total-Spend_per month") == "totalspend"
    # equal names: the first pair stays and the limit counts names
    assert ratio_plan(["a", "b_1", "b1", "c"], 4) == [
        ("feat_ratio_a_b1", "a", "b_1"), ("feat_ratio_a_c", "a", "c"), ("feat_ratio_b1_b1", "b_1", "b1"),
        ("feat_ratio_b1_c", "b_1", "c")]


def test_recommendation_rules(spark):
    meta = spark.createDataFrame([(60_000, 20, 0.8, 0.2, 0.0, True)],
                                 "n_samples long, n_features int, numeric_ratio double, categorical_ratio double, "
                                 "missing_rate double, is_imbalanced boolean")
    got = [(r["model"], r["score"]) for r in AD.recommend(meta).orderBy("rank").collect()]
    # XGBoost 5+1.5+0.5+1 = 8, LightGBM 5+2+0.5 = 7.5, CatBoost 4+1-0.5 = 4.5, RF 3.5+0.5 = 4 (not small/medium),
    # LR 3; gradient boosting excluded on large data, decision tree only in fast mode
    assert got == [("XGBoost", 8.0), ("LightGBM", 7.5), ("CatBoost", 4.5), ("Random Forest", 4.0),
                   ("Logistic Regression", 3.0)]


def test_signal_class_cap_keeps_both_classes(spark):
    cf = FX.customer_features(spark, SF_SMALL)
    rep = assess_signal(cf, "label", "c_custkey", max_rows=100)
    f = rep.features.filter(F.col("feature") == "n_orders").first()
    assert f is not None and f["n_valid"] == 100   # 50 per class


def test_target_encoding_and_one_hot(spark):
    from churnspark.operators.prep import PrepEstimator
    rows = [("a", 1)] * 3 + [("a", 0)] * 1 + [("b", 0)] * 4 + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "seg string, label int")
    te = PrepEstimator([], ["seg"], target_encode=True).fit(df)
    prior = 5 / 10
    # nulls take the mode ("a" and "b" tie at 4 non-null rows -> smallest value "a"), so "a" has 6 rows, 5 churned
    assert te.modes["seg"] == "a"
    assert abs(te.encodings["seg"]["a"] - (5 + prior) / (6 + 1)) < 1e-12
    assert abs(te.encodings["seg"]["b"] - (0 + prior) / (4 + 1)) < 1e-12
    oh = PrepEstimator([], ["seg"]).fit(df)
    assert oh.output_names() == ["cat__seg_a", "cat__seg_b"]
    unseen = spark.createDataFrame([("zzz", 0)], "seg string, label int")
    vec = oh.transform(unseen).first()["features"]
    assert list(vec.toArray()) == [0.0, 0.0]     # unknown category -> all zeros


def test_white_space_of_any_kind_is_stripped(spark):
    from churnspark.functions.exprs import bool_map_expr, numeric_string, strict_target
    df = spark.createDataFrame([("Yes\t", " 1,234.5\n")], "a string, b string")
    r = df.select(strict_target("a").alias("t"), bool_map_expr("a").alias("f"), numeric_string("b").alias("n")).first()
    assert (r.t, r.f, r.n) == (1, 1, 1234.5)


def test_row_ids_are_unique_on_repeated_rows(spark):
    from churnspark.operators.clean import with_row_id
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (1, "a")], "x int, y string")
    assert with_row_id(df, None).select("row_id").distinct().count() == 4


def test_nan_counts_as_missing_in_the_profile(spark):
    from churnspark.operators.profile import profile
    df = spark.createDataFrame([(float("nan") if i < 40 else float(i),) for i in range(200)], "v double")
    r = profile(df).first()
    assert r.null_count == 40 and r.n_unique == 160 and abs(r["mean"] - 119.5) < 1e-9


def test_rare_event_scores_spread_over_buckets(spark):
    from churnspark.operators.metrics import ranking_metrics, score_table
    df = spark.range(4000).selectExpr("'m' as model", "cast(id % 50 = 0 as int) as label", "(id + 1) * 1e-9 as p")
    st = score_table(df)
    assert st.count() == 4000 and 0.4 < ranking_metrics(df).first()["roc_auc"] < 0.6


def test_exact_medians_of_odd_even_tied_and_missing_values(spark):
    import random
    import statistics

    from churnspark.operators.prep import PrepEstimator, exact_medians
    rng = random.Random(1)
    rows = [(float(rng.randrange(10**6)), float(rng.randrange(2)), None if i % 3 else float(i), float("nan") if i % 2 else float(i), None)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    got = exact_medians(df, ["a", "b", "c", "d", "e"])
    want = {c: statistics.median([r[i] for r in rows if r[i] is not None and r[i] == r[i]]) for i, c in enumerate("abcd")}
    assert got == {**want, "e": None}
    assert PrepEstimator(["a", "d"], [], scale=True).fit(df).means["d"] == want["d"]


def test_explanations_cover_every_row(spark):
    """Shapley values of a linear score: the weight times the distance to the mean of the row's own background rows, so
    each feature sums to 0 over all rows; shuffling a column that the score ignores costs nothing."""
    from pyspark.sql import functions as F

    from churnspark.operators.explain import permutation_importance, sampled_shap
    n = 400
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                               (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c"))
    df = df.withColumn("label", (2 * F.col("a") + F.col("b") > 11).cast("int"))
    score = F.col("a") * 2 + F.col("b")
    phi = sampled_shap(df, ["a", "b", "c"], ["a", "b", "c"], lambda d: d.withColumn("p", score), "k").collect()
    assert len(phi) == 3 * n
    for f in "abc":
        assert abs(sum(r["phi"] for r in phi if r["feature"] == f)) < 1e-6
    assert all(abs(r["phi"]) < 1e-9 for r in phi if r["feature"] == "c")
    # rows with equal values differ only by their background: the weight is the slope between values
    spread = [r for r in phi if r["feature"] == "a"]
    low, high = ([r["phi"] for r in spread if r["value"] == v] for v in (0.0, 6.0))
    assert abs((sum(high) / len(high) - sum(low) / len(low)) - 12) < 2
    imp = {r["feature"]: r for r in permutation_importance(df, ["a", "b", "c"], lambda d: d.withColumn("p", score), "k").collect()}
    assert imp["c"]["importance_mean"] == 0 and imp["a"]["importance_mean"] > 0.1
    assert {r["n_rows"] for r in imp.values()} == {n}


def test_comparison_shows_failed_models_last(spark):
    from churnspark.operators.metrics import comparison_table
    m = spark.createDataFrame([("a", None, 0.5, 0.5, 0.6, 0.5), ("b", "no rows", None, None, None, None), ("c", None, 0.4, 0.5, 0.6, 0.4)],
                              "model string, error string, pr_auc double, recall double, roc_auc double, best_overall_score double")
    cv = spark.createDataFrame([("c", 0.8, 0.8, 0.8, 0.8)],
                               "model string, cv_pr_auc double, cv_recall double, cv_roc_auc double, cv_best_overall_score double")
    rows = [(r["model"], r["status"], r["best_overall_score"], r["rank"]) for r in comparison_table(m, cv).orderBy("rank").collect()]
    assert rows == [("c", "ok", 0.8, 1), ("a", "ok", 0.5, 2), ("b", "failed: no rows", None, 3)]


def test_training_queries_search_with_the_library_defaults(spark, monkeypatch):
    import pytest

    from churnspark.operators.train import PRODUCTION_MODELS, REGISTRY_MODELS, TrainConfig
    from churnspark.plans import catalog as CAT

    class Asked(Exception):
        pass

    def asked(raw, target, id_col, models, cfg, finish=True):
        raise Asked(models, cfg)
    monkeypatch.setattr(CAT.PL, "run_pipeline", asked)
    monkeypatch.setattr(CAT, "_PIPELINES", {})
    every = PRODUCTION_MODELS + REGISTRY_MODELS
    wanted = {n: every for n in ("trn8", "trn13", "evl22")} | {"trn10": ["XGBoost", "LightGBM", "CatBoost"], "exp4_linear": ["Logistic Regression"]}
    wanted |= {n: [CAT.PLAN_MODEL] for n in ("evl14", "evl15", "evl16", "evl21", "exp1", "exp2", "exp3", "exp4", "exp4_tree", "exp5", "exp6", "exp7", "scr1",
                                             "scr4_model", "scr5_model", "snk3", "stream_score", "stream_monitor", "stream_window_monitor")}
    wanted |= dict(zip(("trn1", "trn2", "trn3", "trn4", "trn5", "trn6", "trn7"), [[m] for m in every]))
    for name, models in wanted.items():
        assert CAT.fits_models(name)
        with pytest.raises(Asked) as e:
            CAT.REGISTRY[name](spark, SF_SMALL)
        assert e.value.args == (models, TrainConfig())


def test_equal_rows_are_numbered_by_many_tasks(spark, monkeypatch):
    from churnspark.operators import clean

    monkeypatch.setattr(clean, "ROW_CHUNK", 500, raising=False)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        x = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.lit(None)).otherwise(F.col("id")).alias("a b"),
                                       F.timestamp_micros(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id") % 3)).alias("t"))
        got = clean.with_row_id(x, None)
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert got.columns == ["a b", "t", "row_id"]
        assert got.select("row_id").distinct().count() == got.count() == 30_000
        assert got.drop("row_id").exceptAll(x).count() == x.exceptAll(got.drop("row_id")).count() == 0
        equal = [int(r.row_id.split("-")[1]) for r in got.filter("`a b` is null").collect()]
        assert sorted(equal) == list(range(1, 20_001))
        assert max(tasks) < 15_000
        # a digest that several rows share: milliseconds are all that JSON keeps
        near = spark.range(6).select(F.timestamp_micros(F.col("id") % 3).alias("t"))
        assert clean.with_row_id(near, None).select("row_id").distinct().count() == 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trn11_builds_its_rows_once(spark, monkeypatch):
    """Every fit of the two folds used to build the view anew (F29)."""
    from churnspark.plans import catalog as CT
    from churnspark.plans.inputs import Input
    seen, n = spark.sparkContext.accumulator(0), 200

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    def build(spark, sf_dir):
        rows = spark.range(n).selectExpr("id AS c_custkey", "CAST(id % 3 = 0 AS INT) AS label", *[f"CAST((id * {i + 7}) % 31 AS DOUBLE) AS {c}"
                                                                                             for i, c in enumerate(CT.CF_NUMERIC)])
        return rows.mapInPandas(counted, rows.schema)

    monkeypatch.setattr(CT, "CLEAN", Input("small", build, "label", "c_custkey"))
    rows = {r.model: r for r in CT.REGISTRY["trn11"](spark, "").collect()}
    assert rows["Logistic Regression"].error is None and "boosting" in rows["XGBoost"].error
    assert {r.n_rows for r in rows.values()} == {n}
    assert seen.value <= 4 * n   # the split counts and ranks the rows
