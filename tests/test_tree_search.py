"""Batched training: trees against brute force, one block against several, coefficients against lone fits, ordered statistics."""
import hashlib
import heapq
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnspark.operators import hist_trees as H
from churnspark.operators import logistic_search as LS
from churnspark.operators import tree_search as TS
from churnspark.operators.prep import ordered_target_stats


def table(n=400, d=6, bins=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, (n, d)).astype(np.uint8)
    z = x[:, 0] / bins * 2 - 1 + 1.5 * ((x[:, 1] > bins // 2) & (x[:, 2] < bins // 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(np.int64)
    return x, y, np.arange(n, dtype=np.uint64) * np.uint64(7919), np.arange(n) % 5 == 0


def one_block(specs, bins=16, rounds=500, keep=True, **kw):
    x, y, ids, held = table(bins=bins, **kw)
    return H.Block(x, y, ids, held, specs, bins).start().grow(rounds, keep)


# --- one tree by definition -------------------------------------------------------------------

def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def brute_split(x, g, h, rows, s, bins):
    """(gain, column, bin) of the best split of the rows, by trying them all."""
    def score(r):
        return soft(g[r].sum(), s.l1) ** 2 / (h[r].sum() + s.l2)
    best = None
    for c in range(x.shape[1]):
        for b in range(bins - 1):
            left, right = rows[x[rows, c] <= b], rows[x[rows, c] > b]
            if min(len(left), len(right)) < s.min_n or not len(left) or not len(right) or min(h[left].sum(), h[right].sum()) < s.min_h:
                continue
            gain = 0.5 * (score(left) + score(right) - score(rows)) - s.gamma
            if best is None or gain > best[0] + 1e-9:
                best = (gain, c, b, left, right)
    return best if best and best[0] > 1e-9 else None


def brute_tree(x, y, s, bins, rows):
    """Leaves (row sets) and values of a second-order tree grown best leaf first (by level: no bound on leaves)."""
    p = np.full(len(y), 1 / (1 + math.exp(-s.init)))
    w = np.where(y, s.w_pos, s.w_neg)
    g, h = w * (y - p), w * p * (1 - p)
    heap, done, n = [], [], 1

    def push(rows, depth):
        found = brute_split(x, g, h, rows, s, bins) if depth < s.depth and len(rows) >= s.min_split else None
        if found:
            heapq.heappush(heap, (-found[0], min(rows), rows, depth, found))
        else:
            done.append(rows)

    push(rows, 0)
    while heap and n < s.leaves:
        _, _, _, depth, found = heapq.heappop(heap)
        n += 1
        push(found[3], depth + 1)
        push(found[4], depth + 1)
    done += [item[2] for item in heap]
    out = np.full(len(y), np.nan)
    for rows in done:
        out[rows] = soft(g[rows].sum(), s.l1) / (h[rows].sum() + s.l2)
    return out, len(done)


@pytest.mark.parametrize("spec", [
    dict(depth=1, l2=1.0), dict(depth=2, l2=1.0, min_h=30.0), dict(depth=3, l2=1.0), dict(depth=5, l1=2.0, l2=3.0, gamma=0.4, min_h=3.0, w_pos=2.5, init=0.3),
    dict(growth="leaf", depth=8, leaves=6, min_n=10, l2=1.5), dict(growth="leaf", depth=4, leaves=31, min_n=20, l1=0.5, l2=1.0, w_neg=0.5)])
def test_second_order_tree_equals_brute_force(spec):
    s = H.Spec(0, 0, **spec)
    b = one_block([s])
    want, n_leaves = brute_tree(b.x, b.y, s, 16, np.flatnonzero(~b.held))
    (tree,) = b.trees
    assert (tree["left"] < 0).sum() == n_leaves <= s.leaves
    assert np.allclose((b.margin[0] - s.init)[~b.held], want[~b.held])


def test_leaf_growth_is_unbalanced_where_the_data_are():
    n, bins = 4096, 64
    x = np.column_stack([np.arange(n) * bins // n, np.zeros(n, int)]).astype(np.uint8)
    y = (np.arange(n) // 64 % 2 * (x[:, 0] >= 48)).astype(np.int64)    # all structure in the last quarter
    s = H.Spec(0, 0, growth="leaf", depth=20, leaves=15, min_n=20, l2=1.0)
    b = H.Block(x, y, np.arange(n, dtype=np.uint64), np.zeros(n, bool), [s], bins).start().grow(1, True)
    (tree,) = b.trees
    assert (tree["left"] < 0).sum() == 15
    node = np.zeros(n, int)
    while (tree["left"][node] >= 0).any():
        inner = tree["left"][node] >= 0
        node = np.where(inner, tree["left"][node] + (x[np.arange(n), np.maximum(tree["feature"][node], 0)] > tree["bin"][node]), node)
    assert len(set(node[x[:, 0] < 47])) <= 2 < 10 <= len(set(node[x[:, 0] >= 47]))


def test_gini_tree_is_pure_where_it_can_be():
    x, y, ids, held = table()
    y = ((x[:, 0] > 7) ^ (x[:, 1] > 3)).astype(np.int64)
    y[:3] = 1 - y[:3]     # no symmetry at the root
    b = H.Block(x, y, ids, np.zeros(len(y), bool), [H.Spec(0, 0, rule=r, depth=12) for r in ("gini", )], 16).start().grow(1)
    assert ((b.margin[0] > 0.5) == y).mean() > 0.99 and set(np.unique(b.margin[0])) <= {0.0, 1.0} | set(b.margin[0])


def test_oblivious_levels_share_one_split():
    b = one_block([H.Spec(0, 0, growth="oblivious", rounds=3, depth=4, l2=3.0, rows="bayes", row_p=0.5, noise=1.0, rate=0.1)])
    for tree in b.trees:
        assert len(tree["feature"]) == 2 ** 5 - 1
        level, by_level = {0: 0}, {}
        for i, left in enumerate(tree["left"]):
            if left >= 0:
                level[left] = level[left + 1] = level[i] + 1
                by_level.setdefault(level[i], set()).add((tree["feature"][i], tree["bin"][i]))
        assert [len(v) for v in by_level.values()] == [1, 1, 1, 1]


def test_samples_follow_their_shares():
    ids = np.arange(20_000, dtype=np.uint64)
    seeds = np.array([5], np.uint64)
    weights = {k: H.row_weights(H.Spec(0, 0, rows=k, row_p=0.7), seeds, 3, ids) for k in ("bernoulli", "bagging", "poisson", "bayes", "all")}
    assert abs(weights["bernoulli"].mean() - 0.7) < 0.02 and abs(weights["bagging"].mean() - 0.7) < 0.02
    assert abs(weights["poisson"].mean() - 1) < 0.03 and abs(weights["poisson"].var() - 1) < 0.06
    assert (weights["all"] == 1).all() and (weights["bayes"] > 0).all()
    same = [H.row_weights(H.Spec(0, 0, rows="bagging", row_p=0.7), seeds, r, ids) for r in (5, 9, 10)]
    assert (same[0] == same[1]).all() and (same[0] != same[2]).any()     # a new bag every five rounds
    batch = H.make_batch([H.Spec(i, 0, cols=0.5) for i in range(50)], 0, 10, 16)
    assert (batch.cols.sum(axis=1) == 5).all() and len({tuple(c) for c in batch.cols}) > 20


def test_early_stop_ends_patience_rounds_after_the_best():
    specs = [H.Spec(t, 0, rounds=200, rate=0.3, depth=4, l2=1.0, stop=stop, patience=7) for t, stop in enumerate(("auc", "logloss"))]
    for s in specs:
        b = one_block([s], keep=False)
        assert b.round == b.best_round[0] + 7 < 200
        again = one_block([H.Spec(s.trial, 0, rounds=int(b.best_round[0]), rate=0.3, depth=4, l2=1.0)], keep=False)
        assert np.allclose(b.scores()[0], H.sigmoid(again.margin[0, again.held]))     # the fold's score is that of the best round


# --- blocks -----------------------------------------------------------------------------------

def as_blocks(spark, parts):
    import pickle
    x, y, ids, held = table()
    rows = []
    for fold in (0, 1):
        h = np.arange(len(y)) % 5 == fold
        for b, at in enumerate(np.array_split(np.random.default_rng(3).permutation(len(y)), parts)):
            rows.append((fold, b, pickle.dumps((x[at], y[at], ids[at], h[at]))))
    return spark.createDataFrame(rows, "fold int, block int, data binary")


KINDS = {
    "level": dict(rounds=4, depth=3, l1=0.2, l2=1.0, gamma=0.05, min_h=1.0, rows="bernoulli", row_p=0.7, cols=0.7, rate=0.3, stop="auc", patience=2),
    "leaf": dict(growth="leaf", rounds=3, depth=6, leaves=9, min_n=10, l2=1.0, rows="bagging", row_p=0.8, rate=0.2, stop="logloss"),
    "oblivious": dict(growth="oblivious", rounds=3, depth=3, l2=3.0, rows="bayes", row_p=0.6, noise=0.7, rate=0.2, stop="auc"),
    "friedman": dict(rule="friedman", rounds=3, depth=3, rate=0.2),
    "forest": dict(rule="gini", rounds=2, trees=3, depth=6, min_n=3, min_split=8, rows="poisson", mtry="sqrt"),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_several_blocks_grow_the_trees_of_one(spark, kind, monkeypatch):
    monkeypatch.setattr(TS, "FAN", 2)
    specs = [H.Spec(t, f, seed=9, **KINDS[kind]) for f in (0, 1) for t in range(2)]
    results = []
    for parts in (1, 3):
        state, books, trees = TS.train(as_blocks(spark, parts), specs, parts, 1, bins=16, keep=True, columns={0: 6, 1: 6})
        scores = {(r.trial, r.fold): round(r.s, 6) for r in TS.held_out_scores(state).groupBy("trial", "fold").agg(F.sum("p").alias("s")).collect()}
        results.append((scores, {k: b.best_round.tolist() for k, b in books.items()}, trees))
    (s1, b1, t1), (s2, b2, t2) = results
    assert len(s1) == 4 and s1 == s2 and b1 == b2
    for k in t1:
        assert len(t1[k]) == len(t2[k]) > 0
        for one, other in zip(t1[k], t2[k]):
            assert (one["feature"] == other["feature"]).all() and (one["bin"] == other["bin"]).all()
            assert np.allclose(one["value"], other["value"])


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_trees_grown_over_lists_of_rows_are_the_same(kind, monkeypatch):
    specs = [H.Spec(t, 0, seed=9, w_pos=1.5, **KINDS[kind]) for t in range(2)]
    results = []
    for listed, long in ((1 << 40, 1), (1, 1), (1, 150), (1, 1 << 40)):       # side by side; one by one with lists, with both, pooled
        monkeypatch.setattr(H, "LISTED", listed)
        monkeypatch.setattr(H, "LONG", long)
        x, y, ids, held = table(n=1200)
        x[:, 4:] %= 2
        b = H.Block(x, y, ids, held, specs, 16).start().grow(5, True)
        scores = [sorted(s) for s in b.scores().round(9).tolist()]
        results.append((scores, b.best_round.tolist(), [(t["feature"].tolist(), t["bin"].tolist(), t["cover"].round(6).tolist()) for t in b.trees]))
    assert len(results[0][2]) > 3
    for other in results[1:]:
        assert other[1:] == results[0][1:] and np.allclose(other[0], results[0][0])


def test_one_job_trains_a_fold_that_is_one_block(spark):
    specs = [H.Spec(t, f, seed=9, **(KINDS["leaf"] | {"rounds": 60})) for f in (0, 1) for t in range(3)]
    group = "one-block"
    spark.sparkContext.setJobGroup(group, group)
    state, books, _ = TS.train(as_blocks(spark, 1), specs, 1, 2, bins=16)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(books) == 4 and all(b.round == 60 or b.done.all() for b in books.values())
    assert len(jobs) <= 4       # however many rounds: the sample of the ranges, the training, its result
    assert TS.blocks_of(1 << 20, 16) == 1 < TS.blocks_of((1 << 20) + 1, 16) and TS.blocks_of(1 << 20, 17) == 4 == TS.blocks_of(1 << 20, 2, whole=False)


def test_model_scores_as_it_was_trained(spark, tmp_path):
    x, y, ids, held = table()
    edges = [[float(v) + 0.5 for v in range(15)] for _ in range(6)]
    for s in (H.Spec(0, 0, rounds=5, depth=4, l2=1.0, rate=0.2, init=0.1), H.Spec(0, 0, rule="gini", rounds=2, trees=4, depth=7, rows="poisson", mtry="sqrt")):
        b = H.Block(x, y, ids, np.zeros(len(y), bool), [s], 16).start().grow(10, True)
        m = TS.TreeEnsembleModel(b.trees, edges, s.rate, s.init, s.boosts)
        want = H.sigmoid(b.margin[0]) if s.boosts else b.margin[0] / (s.rounds * s.trees)
        assert np.allclose(m.probability(x.astype(float)), want)
        path = str(tmp_path / f"model-{s.rule}")
        m.save(path)
        assert np.allclose(TS.TreeEnsembleModel.load(spark, path).probability(x.astype(float)), want)
        df = spark.createDataFrame([(i, Vectors.dense(r.astype(float))) for i, r in enumerate(x[:20])], ["i", "features"])
        assert np.allclose([r.p for r in m.score(df).orderBy("i").collect()], want[:20])
        imp = m.featureImportances.toArray()
        assert abs(imp.sum() - 1) < 1e-9 and imp[:3].sum() > 0.5


# --- logistic regression ----------------------------------------------------------------------

def test_coefficients_equal_lone_fits(spark):
    import pickle
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1, -1, 0.5, 0]))).astype(np.int64)
    held = np.arange(300) % 3 == 0
    parts = np.array_split(np.arange(300), 3)
    blocks = spark.createDataFrame([(0, b, pickle.dumps((x[i], y[i], i.astype(np.uint64), held[i]))) for b, i in enumerate(parts)],
                                   "fold int, block int, data binary")
    reg, weights = np.array([0.5, 0.01, 1e-4]), np.array([[1.0, 1.0], [1.0, 3.0], [0.7, 1.2]])
    got = LS.fit_all(blocks, {0: reg}, {0: weights}, {0: 4}, 3)[0]
    for w, r, (neg, pos) in zip(got, reg, weights):
        rows = [(Vectors.dense(v), float(t), float(pos if t else neg)) for v, t in zip(x[~held], y[~held])]
        lone = LogisticRegression(regParam=float(r), standardization=False, weightCol="weight", tol=1e-12, maxIter=1000).fit(
            spark.createDataFrame(rows, ["features", "label", "weight"]))
        assert np.allclose(w[:-1], lone.coefficients.toArray(), atol=1e-6) and abs(w[-1] - lone.intercept) < 1e-6
    scores = LS.held_out_scores(blocks, {0: got}).groupBy("trial").agg(F.count("p").alias("n"), F.sum("p").alias("s")).orderBy("trial").collect()
    assert [r.n for r in scores] == [100, 100, 100]
    assert np.allclose([r.s for r in scores], H.sigmoid(x[held] @ got[:, :-1].T + got[:, -1]).sum(axis=0))


def test_a_pass_holds_a_few_rows_at_a_time(monkeypatch):
    import pickle

    import pyarrow as pa
    rng = np.random.default_rng(3)
    x, y, held = rng.normal(size=(300, 4)), rng.integers(0, 2, 300), np.arange(300) % 3 == 0
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([pickle.dumps((x, y, None, held))], pa.binary())],
                                       names=["fold", "block", "data"])
    sizes, sums, points = [], [], rng.normal(size=(2, 5))
    monkeypatch.setattr(LS, "sigmoid", lambda z: sizes.append(len(z)) or H.sigmoid(z))
    for step in (1 << 15, 16):
        monkeypatch.setattr(LS, "STEP", step)
        (out,) = LS._pass({0: points}, {0: np.ones((2, 2))})([batch])
        sums.append(pickle.loads(out.column(4)[0].as_py()))
    assert sizes[0] == 200 and max(sizes[1:]) == 16 and sum(sizes[1:]) == 200
    assert np.allclose(*sums)


# --- ordered target statistics ----------------------------------------------------------------

def test_ordered_statistics_use_only_rows_before(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 7}" if i % 11 else None, i % 2, float((i * 7919) % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, c string, label int, other double").repartition(5)
    got = {r.k: r.te__c for r in ordered_target_stats(df, ["c"], {"c": "hot"}, 0.4, "label", "k", smoothing=2.0).collect()}
    seen, n_seen, want = {}, {}, {}

    def place(k):
        h = hashlib.md5(f"42|order|{k}".encode()).hexdigest()
        return int(h[:8], 16) % 65536, h
    for k, c, y, _ in sorted(rows, key=lambda r: place(r[0])):
        c = c or "hot"
        want[k] = (seen.get(c, 0) + 0.4 * 2) / (n_seen.get(c, 0) + 2)
        seen[c], n_seen[c] = seen.get(c, 0) + y, n_seen.get(c, 0) + 1
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ordered_statistics_send_no_rows_through_the_driver(spark):
    df = spark.range(500).selectExpr("id k", "string(id % 5) c", "id % 2 label")
    out = ordered_target_stats(df, ["c"], {"c": "0"}, 0.5, "label", "k")
    assert out.count() == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["XGBoost", "Logistic Regression"])
def test_search_over_many_blocks_equals_one_block(spark, name, monkeypatch):
    from churnspark.operators.train import TrainConfig, Trainer
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), "xyz"[i % 3], int(rng.random() < 1 / (1 + math.exp(-2 * a))), i % 2)
            for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "c_custkey int, a double, b double, c string, label int, fold int")
    cfg = TrainConfig(n_trials=2, folds=2, boost_cap=4, boost_floor=2, patience=2, parallelism=2)
    got = []
    for block_rows in (1 << 18, 90):
        monkeypatch.setattr(TS, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(TS, "FAN", 2)
        t = Trainer(["a", "b"], ["c"], cfg)
        r = t.search(name, df, False)
        assert r.error is None
        p = {x.c_custkey: x.p for x in t.score(r, df).select("c_custkey", "p").collect()}
        got.append((r.cv_score, r.n_estimators, [s for _, _, s in r.trials], p))
    one, many = got
    assert one[1] == many[1] and abs(one[0] - many[0]) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(one[2], many[2]))
    assert one[3].keys() == many[3].keys() and all(abs(one[3][k] - many[3][k]) < 1e-9 for k in one[3])
    assert one[0] > 0.7


def test_long_lists_draw_a_bag_once_in_five_rounds_and_in_strips(monkeypatch):
    n = H.LISTED + 1000
    x, y, ids, held = table(n=n)
    drawn, real = [], H.row_weights

    def counted(spec, seeds, r, some):
        drawn.append((r, len(some)))
        return real(spec, seeds, r, some)
    monkeypatch.setattr(H, "row_weights", counted)
    spec = H.Spec(0, 0, growth="leaf", rounds=7, depth=4, leaves=8, min_n=20, l2=1.0, rate=0.1, rows="bagging", row_p=0.7, stop="logloss")
    listed = H.Block(x, y, ids, held, [spec], 16).start().grow(7, True)
    assert {r for r, _ in drawn} == {0, 5} and max(k for _, k in drawn) <= H.STRIP
    assert sum(k for _, k in drawn) == 2 * int((~held).sum())
    monkeypatch.setattr(H, "LISTED", n + 1)
    together = H.Block(x, y, ids, held, [spec], 16).start().grow(7, True)
    assert [t["feature"].tolist() for t in listed.trees] == [t["feature"].tolist() for t in together.trees]
    order = np.argsort(held, kind="stable")
    assert np.allclose(listed.margin, together.margin[:, order]) and np.allclose(listed.best_margin, together.best_margin[:, :])


def test_trees_of_a_forest_leave_the_task_in_several_rows():
    import pickle
    import pyarrow as pa
    x, y, ids, held = table()
    spec = H.Spec(0, 0, rule="gini", rounds=3, trees=5, depth=6, min_n=2, mtry="sqrt", rows="poisson")
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()),
                                        pa.array([pickle.dumps((x, y, ids, held))], pa.binary())], names=["fold", "grp", "block", "data"])
    rows = [r for b in TS._whole({(0, 0): [spec]}, 16, True)([batch]) for r in b.to_pylist()]
    state, *parts = rows
    assert pickle.loads(state["data"]).trees == [] and state["alive"] == 0
    assert [len(pickle.loads(r["data"])) for r in parts] == [10, 5] and {r["alive"] for r in parts} == {-1}


@pytest.mark.parametrize("depth", [0, 1, 6])
def test_scorer_is_small_and_gives_the_model_s_values(depth):
    import pickle
    x, y, ids, held = table()
    spec = H.Spec(0, 0, rounds=40, depth=depth, l2=1.0, rate=0.2, init=0.3)
    b = H.Block(x, y, ids, held, [spec], 16).start().grow(40, True)
    edges = [[float(i) for i in range(15)]] * x.shape[1]
    model = TS.TreeEnsembleModel(b.trees, edges, spec.rate, spec.init, True)
    assert np.allclose(model.margin(x.astype(float)), b.margin[0])
    if depth == 6:
        assert 3 * len(pickle.dumps(TS.Scorer(model))) < len(pickle.dumps(model))


@pytest.mark.parametrize("kind", [dict(rule="gini", rows="poisson", mtry="sqrt", trees=3), dict(rule="entropy")])
def test_classes_are_counted_in_one_pass(kind, monkeypatch):
    x, y, ids, held = table(900)
    spec = H.Spec(0, 0, depth=5, min_n=3, w_pos=1.75, w_neg=0.6, **kind)
    monkeypatch.setattr(H, "LISTED", 1 << 40)
    together = H.Block(x, y, ids, held, [spec], 16).start().grow(1, True)
    order = np.argsort(held, kind="stable")
    monkeypatch.setattr(H, "LISTED", 1)
    for long in (1, 20, 1 << 40):
        monkeypatch.setattr(H, "LONG", long)
        listed = H.Block(x, y, ids, held, [spec], 16).start().grow(1, True)
        assert [t["feature"].tolist() for t in listed.trees] == [t["feature"].tolist() for t in together.trees]
        assert all(np.array_equal(a["cover"], b["cover"]) for a, b in zip(listed.trees, together.trees))
        assert np.allclose(listed.margin, together.margin[:, order])
    calls = []
    count = np.bincount
    monkeypatch.setattr(H.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    columns, used = H.Columns(x, y), np.ones(x.shape[1], bool)
    hist = columns.histograms(np.arange(900), [np.full(900, 2 * H.PACKED + 1)], 16, used, True)
    assert len(calls) == len(columns.wide)    # not once a statistic
    assert hist[:, 0].sum(axis=1).tolist() == [2 * y.sum(), 1800, 900]


def test_a_long_fold_trains_a_model_a_task_the_heaviest_first(monkeypatch):
    monkeypatch.setattr(H, "LISTED", 1000)
    specs = [H.Spec(t, f, rounds=500, depth=3 + t % 4, rate=0.01 * (1 + t), stop="auc", n_train=5000) for f in range(2) for t in range(6)]
    groups = TS.grouped(specs, 1, 4)
    assert len(groups) == 12 and all(len(own) == 1 for own in groups.values())
    for f in range(2):
        work = [groups[f, g][0].work for g in range(6)]
        assert work == sorted(work, reverse=True)
    for few, n_blocks in (([H.Spec(t, 0, n_train=900) for t in range(6)], 1), (specs[:6], 3)):   # short folds, folds of several blocks
        assert [len(own) for own in TS.grouped(few, n_blocks, 4).values()] == [2, 2, 1, 1]


def test_large_rows_have_files_of_their_own(spark):
    from churnspark.session import stored
    df = stored(spark.range(0, 6, 1, 1), "trees", rows_a_file=1)
    assert len(df.inputFiles()) == 6 and df.count() == 6
    assert len(stored(spark.range(0, 6, 1, 1), "trees").inputFiles()) == 1
