"""Long folds: a task reads all blocks of its fold, holds few bytes a row, and a forest's refit is shared out."""
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnspark.operators import hist_trees as H
from churnspark.operators import tree_search as TS
from tests.test_tree_search import KINDS, as_blocks, table


@pytest.mark.parametrize("kind", ["leaf", "forest"])
def test_a_task_reads_all_blocks_of_its_fold(spark, kind, monkeypatch):
    monkeypatch.setattr(H, "LISTED", 100)
    specs = [H.Spec(t, f, seed=9, n_train=320, **KINDS[kind]) for f in (0, 1) for t in range(2)]
    results = []
    for parts in (1, 3):
        state, books, trees = TS.train(as_blocks(spark, parts), specs, parts, 1, bins=16, keep=True, alone=True)
        scores = {(r.trial, r.fold): round(r.s, 6) for r in TS.held_out_scores(state).groupBy("trial", "fold").agg(F.sum("p").alias("s")).collect()}
        results.append((scores, {k: b.best_round.tolist() for k, b in books.items()}, {k: [t["feature"].tolist() for t in v] for k, v in trees.items()}))
    assert len(results[0][0]) == len(results[0][1]) == 4 and results[0] == results[1]


def test_no_copy_of_a_long_fold_is_shuffled_and_no_level_is_a_job(spark, monkeypatch):
    monkeypatch.setattr(H, "LISTED", 100)
    groups = TS.grouped([H.Spec(t, f, n_train=320, rounds=9) for f in (0, 1) for t in range(3)], 1, 4)
    units = TS._units(as_blocks(spark, 3), groups, 16, False)
    assert "Exchange" not in units._jdf.queryExecution().executedPlan().toString()
    assert units.select("fold").rdd.getNumPartitions() == 6 + 2     # a model a task (two tasks have no rows)
    from churnspark.session import stored
    files = stored(units, "units").groupBy(F.input_file_name()).agg(F.count_distinct("fold", "grp").alias("n")).collect()
    assert [r.n for r in files] == [1] * 6
    assert TS.long_and_whole(4_320_000, 5_400_000, 11) and TS.blocks_of(5_400_000, 11) > 1
    assert not TS.long_and_whole(50, 80, 11) and not TS.long_and_whole(1 << 23, 1 << 23, 2) and not TS.long_and_whole(1 << 22, 1 << 22, 40)


def test_blocks_are_put_together_training_rows_first():
    x, y, ids, held = table(700)
    cuts = (slice(0, 90), slice(90, 91), slice(91, 700))
    gx, gy, gids, gheld = TS._together([(x[c], y[c], ids[c], held[c]) for c in cuts])
    assert (np.diff(gheld.astype(int)) >= 0).all() and gx.T.flags.c_contiguous
    order, want = np.argsort(gids), np.argsort(ids)
    assert np.array_equal(gx[order], x[want]) and np.array_equal(gy[order], y[want]) and np.array_equal(gheld[order], held[want])


def test_a_long_fold_holds_few_bytes_a_row(monkeypatch):
    """Bytes that numpy holds at most while a model grows, beyond those of the rows themselves."""
    import tracemalloc
    monkeypatch.setattr(H, "STRETCH", 1 << 12)
    n = 400_000
    x, y, ids, held = table(n)
    for spec in (H.Spec(0, 0, growth="leaf", rounds=2, depth=4, leaves=9, l2=1.0, rows="bagging", row_p=0.8, rate=0.2, stop="logloss"),
                 H.Spec(0, 0, rule="gini", rounds=1, trees=2, depth=5, rows="poisson", mtry="sqrt")):
        tracemalloc.start()
        H.Block(x, y, ids, held, [spec], 16).start().grow(2)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak / n < 110       # 141 and 141 before


def test_stretches_give_the_sums_of_all_rows(monkeypatch):
    x, y, _, _ = table(900)
    x[:, 3:] %= 2
    rows, used = np.flatnonzero(np.arange(900) % 7 > 0).astype(np.int32), np.ones(6, bool)
    slots, columns = rows % 4, np.array([[0, 2], [1, 5], [2, 3], [0, 4]])
    got = []
    for stretch in (1 << 20, 64):
        monkeypatch.setattr(H, "STRETCH", stretch)
        for own, stats in ((H.Columns(x), [np.sin(np.arange(900.0)), np.ones(900), None]), (H.Columns(x, y), [np.arange(900) % 3 * H.PACKED + 1])):
            got.append([own.histograms(rows, stats, 16, used, True), own.some(rows, np.array([1, 4]), stats, 16, True),
                        own.pooled(rows, slots, stats, 4, 16, columns, True), own.beyond(rows, 2, 5).astype(float)])
    for one, other in zip(got[:2], got[2:]):
        assert all(np.allclose(a, b) for a, b in zip(one, other))
    assert np.allclose(got[0][0][2, 0], np.bincount(x[rows, 0], minlength=16))


def test_stored_blocks_reach_a_task_a_row_at_a_time(spark):
    from churnspark.session import stored
    blocks = stored(as_blocks(spark, 3), "blocks", by="fold")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    one = TS._row_by_row(blocks)
    assert one.columns == blocks.columns and one.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert [r.n for r in one.coalesce(1).mapInArrow(sizes, "n long").collect()] == [1] * 6
    assert max(r.n for r in blocks.coalesce(1).mapInArrow(sizes, "n long").collect()) > 1


@pytest.mark.parametrize("n", [1, 3, 50])
def test_parts_of_a_forest_have_its_trees(n):
    x, y, ids, held = table()
    spec = H.Spec(0, 0, rule="gini", rounds=5, trees=2, depth=4, min_n=3, rows="poisson", mtry="sqrt")
    parts = spec.parts(n)
    assert len(parts) == min(n, 5) and sum(s.work for s in parts) == spec.work
    whole = H.Block(x, y, ids, held, [spec], 16).start().grow(5, True).trees
    own = [t for s in parts for t in H.Block(x, y, ids, held, [s], 16).start().grow(s.rounds, True).trees]
    assert [t["feature"].tolist() for t in own] == [t["feature"].tolist() for t in whole] and len(own) == 10


def test_a_forest_s_refit_is_shared_out(spark, monkeypatch):
    from churnspark.operators.train import TrainConfig, Trainer
    df = spark.range(400).selectExpr("id AS c_custkey", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 37 % 101 > 50 AS INT) AS label")
    params = {"max_depth": 4, "min_samples_leaf": 2, "min_samples_split": 2, "max_features": "sqrt"}
    t, seen, real = Trainer(["a"], [], TrainConfig(rf_trees=30)), [], TS.train

    def counted(blocks, specs, *a, **k):
        seen.append(len(specs))
        return real(blocks, specs, *a, **k)

    monkeypatch.setattr(TS, "train", counted)
    want = t.refit("Random Forest", params, df, False)[1]
    monkeypatch.setattr(H, "LISTED", 100)
    got = t.refit("Random Forest", params, df, False)[1]
    assert seen == [1, 3] and got.n_trees == want.n_trees == 30
    assert all(np.array_equal(getattr(got, f), getattr(want, f)) for f in ("roots", "feature", "threshold", "value"))


def test_scores_of_a_long_fold_leave_the_task_in_several_rows(monkeypatch):
    monkeypatch.setattr(TS, "HELD_A_ROW", 30)
    x, y, ids, held = table()
    spec = H.Spec(0, 0, rounds=3, depth=3, l2=1.0, rate=0.2, stop="auc")
    batch = pa.RecordBatch.from_arrays([*(pa.array([0], pa.int32()) for _ in range(3)), pa.array([pickle.dumps((x, y, ids, held))], pa.binary())],
                                       names=["fold", "grp", "block", "data"])
    states = list(TS._whole({(0, 0): [spec]}, 16, False)([batch]))
    scores = [r for s in states for b in TS._scorer([s]) for r in b.to_pylist()]
    want = H.Block(x, y, ids, held, [spec], 16).start().grow(3).scores()[0]
    assert len(states) == 3 and np.allclose([r["p"] for r in scores], want) and [r["label"] for r in scores] == y[held].tolist()
