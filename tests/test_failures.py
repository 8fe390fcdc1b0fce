"""A failure is never a result: lost work, plans without a model, calibrators that could not be fitted."""
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from churnspark.operators.train import FamilyResult, TrainConfig, Trainer, fit_platt
from churnspark.plans import catalog as CT
from churnspark.plans import pipeline as PL


def trainer(monkeypatch, exc):
    def fails(self, name, *_):
        if name == "XGBoost":
            raise exc
        return FamilyResult(name, cv_score=0.5)

    monkeypatch.setattr(Trainer, "_fold_rows", lambda *_: None)
    monkeypatch.setattr(Trainer, "_search_family", fails)
    monkeypatch.setattr(Trainer, "refit", lambda *_: (None, None))
    return Trainer([], [], TrainConfig(parallelism=2))


@pytest.mark.parametrize("exc", [Py4JError("Job aborted"), MemoryError()])
def test_lost_work_is_raised_by_the_search(monkeypatch, exc):
    with pytest.raises(type(exc)):
        trainer(monkeypatch, exc).search_many(["LightGBM", "XGBoost"], None, False)


def test_a_family_that_refuses_its_parameters_keeps_its_error(monkeypatch):
    found = trainer(monkeypatch, ValueError("no rounds")).search_many(["LightGBM", "XGBoost"], None, False)
    assert found["LightGBM"].error is None and found["XGBoost"].error == "ValueError: no rounds"


def test_a_plan_without_a_model_is_an_error(spark, monkeypatch):
    rows = spark.range(40).selectExpr("id AS customer_id", "'train' AS split", "CAST(id % 2 AS INT) AS label")
    prepared = PL.PipelineResult(None, None, {}, None, [], [], [], rows, trainer=trainer(monkeypatch, ValueError("no rounds")))
    prepared.trainer.key = "customer_id"
    monkeypatch.setattr(PL, "prepare", lambda *_: prepared)
    with pytest.raises(RuntimeError, match="XGBoost: ValueError: no rounds"):
        PL.run_pipeline(rows, "label", "customer_id", ["XGBoost"], TrainConfig(folds=2))


def test_calibrators_say_why_they_were_not_fitted(spark, monkeypatch):
    scores = spark.range(200).select(((F.col("id") % 10 + 0.5) / 10).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    cands, fitted, errors = PL._calibrators(scores, scores)
    assert cands.keys() == fitted.keys() == {"sigmoid", "isotonic"} and not errors
    for bad in (scores.limit(0), scores.withColumn("p", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="rows to calibrate on"):
            fit_platt(bad)
    assert "sigmoid" in PL._calibrators(scores.limit(0), scores)[2]

    def gone(_):
        raise Py4JError("Job aborted")

    monkeypatch.setattr(PL, "fit_platt", gone)
    with pytest.raises(Py4JError):
        PL._calibrators(scores, scores)


@pytest.mark.parametrize("query", ["evl14", "evl16"])
def test_a_calibrator_that_was_not_fitted_is_no_row(spark, monkeypatch, query):
    res = PL.PipelineResult(None, None, {}, None, [], [], [], None)
    res.calibration = {"brier_before": 0.2, "candidates": {"isotonic": 0.1}, "errors": {"sigmoid": "ValueError: no rows"}, "method": None}
    monkeypatch.setattr(CT, "_plan", lambda *_: res)
    with pytest.raises(RuntimeError, match="sigmoid"):
        CT.REGISTRY[query](spark, "")
    assert CT.REGISTRY["evl15"](spark, "").first()["brier"] == 0.1
