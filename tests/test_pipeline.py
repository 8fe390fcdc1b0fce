"""End-to-end training, scoring and streaming on the smallest tables (small search)."""
import pytest
from pyspark.sql import functions as F

from churnspark.operators.train import TrainConfig
from churnspark.plans.pipeline import final_report, run_pipeline, score_new_customers
from churnspark.sources import fixtures as FX
from churnspark.sources import io as IO
from churnspark.streaming import scoring as ST
from tests.conftest import SF_SMALL
from tests.helpers import rows_of

CFG = TrainConfig(n_trials=1, folds=2, rf_trees=10, boost_cap=10, boost_floor=5, patience=3, parallelism=2)


@pytest.fixture(scope="module")
def result(spark):
    raw = FX.customer_raw(spark, SF_SMALL)
    return run_pipeline(raw, "Churn", "Customer ID", ["Logistic Regression", "Random Forest", "XGBoost"], CFG)


def test_pipeline_metrics(result):
    rows = result.metrics.collect()
    assert {r["model"] for r in rows} == {"Logistic Regression", "Random Forest", "XGBoost"}
    for r in rows:
        assert r["error"] is None
        assert 0.0 <= r["roc_auc"] <= 1.0 and 0.0 <= r["pr_auc"] <= 1.0
    assert result.best in {r["model"] for r in rows}
    assert 0.2 <= result.threshold <= 0.7
    rep = final_report(result)
    assert {r["model"] for r in rep["comparison"]} == {r["model"] for r in rep["overfit"]} == {r["model"] for r in rows}
    assert all(r["cv_roc_auc"] is not None for r in rep["overfit"]) and rep["comparison"][0]["status"] == "ok"
    assert rep["best_model"] == result.best and "email" in rep["dropped_columns"]


def test_probabilities_in_range(result):
    p = result.trainer.score(result.final, result.data).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert 0.0 <= p["lo"] <= p["hi"] <= 1.0


def test_scoring_one_row_equals_batch(spark, result):
    batch = result.features.transform(result.clean.transform(FX.customer_raw(spark, SF_SMALL)))
    all_p = {r[0]: r[1] for r in result.trainer.score(result.final, batch).select("customer_id", "p").collect()}
    one = batch.filter(F.col("customer_id") == 7)
    p1 = result.trainer.score(result.final, one).select("p").first()[0]
    assert abs(p1 - all_p[7]) < 1e-12


def test_stream_equals_batch(spark, result):
    raw = FX.customer_raw(spark, SF_SMALL)
    src = IO.new_output_path(spark, "test-stream-src")
    raw.repartition(3).write.parquet(src)
    sink, _ = ST.run_scoring(spark, src, raw.schema, result)
    stream_rows = rows_of(spark.read.parquet(sink))
    batch_rows = rows_of(ST.scored_stream(raw, result))
    assert stream_rows == batch_rows


def test_frozen_clean_plan(spark, result):
    """The cleaning decisions of the training batch are replayed, not re-derived, on a new batch."""
    raw = FX.customer_raw(spark, SF_SMALL).limit(3)
    out = result.clean.transform(raw)
    assert dict(out.dtypes)["total_spend"] == "double"
    assert dict(out.dtypes)["has_urgent"] == "int"


def test_windowed_monitor_equals_batch_counts(spark, result):
    raw = FX.customer_raw(spark, SF_SMALL)
    src = IO.new_output_path(spark, "test-window-src")
    raw.repartition(3).write.parquet(src)
    out = ST.latest_windows(spark, ST.run_windowed_monitor(spark, src, raw.schema, result))
    assert out.agg(F.sum("total")).first()[0] == raw.count()


def test_final_model_applies_its_calibrator(spark, result):
    import dataclasses

    from churnspark.operators.train import apply_platt, fit_platt
    scored = result.trainer.score(dataclasses.replace(result.final, calibrator=None), result.data)
    platt = fit_platt(scored)
    with_it = result.trainer.score(dataclasses.replace(result.final, calibrator=("sigmoid", platt)), result.data)
    want = rows_of(apply_platt(platt, scored).select("customer_id", F.col("p_cal").alias("p")))
    assert rows_of(with_it.select("customer_id", "p")) == want


def test_upload_without_a_training_column_is_scored(spark, result):
    raw = FX.customer_raw(spark, SF_SMALL)
    gone = next(c for c in raw.columns if c.strip().lower().replace(" ", "_") in result.numeric)
    assert score_new_customers(result, raw.drop(gone))["predictions"].count() == raw.count()


def test_data_without_an_id_column_trains_and_scores(spark):
    raw = FX.customer_raw(spark, SF_SMALL).drop("Customer ID")
    res = run_pipeline(raw.unionByName(raw.limit(5)), "Churn", None, ["Logistic Regression"], CFG)
    assert res.metrics.first()["error"] is None
    assert score_new_customers(res, raw)["predictions"].count() == raw.count()


def test_saved_pipeline_scores_an_upload_like_the_one_in_memory(spark, result):
    import dataclasses

    from churnspark.operators.train import fit_platt
    from churnspark.plans.pipeline import load_pipeline, save_pipeline
    platt = fit_platt(result.trainer.score(dataclasses.replace(result.final, calibrator=None), result.data))
    cal = dataclasses.replace(result, final=dataclasses.replace(result.final, calibrator=("sigmoid", platt)))
    raw = FX.customer_raw(spark, SF_SMALL)
    raw = raw.drop(next(c for c in raw.columns if c.strip().lower().replace(" ", "_") in result.numeric))
    loaded = load_pipeline(spark, save_pipeline(cal, IO.new_output_path(spark, "test-model")))
    for part in ("predictions", "monitor"):
        assert rows_of(score_new_customers(loaded, raw)[part]) == rows_of(score_new_customers(cal, raw)[part])


def test_restarted_stream_adds_no_duplicates(spark, result):
    raw = FX.customer_raw(spark, SF_SMALL)
    src = IO.new_output_path(spark, "test-restart-src")
    raw.repartition(2).write.parquet(src)
    sink, checkpoint = ST.run_scoring(spark, src, raw.schema, result)
    raw.limit(10).write.mode("append").parquet(src)
    ST.run_scoring(spark, src, raw.schema, result, sink=sink, checkpoint=checkpoint)
    assert spark.read.parquet(sink).count() == raw.count() + 10


def test_metrics_read_the_scores_and_score_no_row_again(result):
    files = result.metrics.inputFiles()
    assert all(any(tag in f for f in files) for tag in ("test-scores", "train-scores"))
    assert "ArrowEvalPython" not in result.metrics._jdf.queryExecution().toString()
