"""Split, fold and invariance properties."""

from churnspark.operators import metrics as M
from churnspark.operators.split import stratified_folds, stratified_split
from churnspark.sources import fixtures as FX
from tests.conftest import SF_MID
from tests.helpers import rows_of


def test_split_disjoint_exhaustive_and_stratified(spark):
    cf = FX.customer_features(spark, SF_MID)
    sp = stratified_split(cf, "label", ["c_custkey"])
    assert sp.count() == cf.count()
    assert sp.select("c_custkey").distinct().count() == cf.count()
    per = {(r["label"], r["split"]): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    for y in (0, 1):
        n = per[(y, "train")] + per[(y, "test")]
        assert per[(y, "test")] == int(n * 0.2 + 0.5)


def test_split_invariant_to_partitioning(spark):
    cf = FX.customer_features(spark, SF_MID)
    a = rows_of(stratified_split(cf.repartition(1), "label", ["c_custkey"]).select("c_custkey", "split"))
    b = rows_of(stratified_split(cf.repartition(7), "label", ["c_custkey"]).select("c_custkey", "split"))
    assert a == b


def test_folds_balanced(spark):
    cf = FX.customer_features(spark, SF_MID)
    f = stratified_folds(cf, "label", ["c_custkey"], k=5)
    rows = f.groupBy("label", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["label"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1   # per class, fold sizes differ by at most one


def test_metrics_invariant_to_partitioning(spark):
    s = FX.scored(spark, SF_MID)
    a = rows_of(M.evaluate(s.repartition(1)))
    b = rows_of(M.evaluate(s.repartition(13)))
    assert a == b
