"""Model training and tuning (TRN1-TRN13, EVL14-16).

Families
--------
Logistic Regression   L2, regParam = 1 / (C * n), scaled inputs
Random Forest         bootstrap (Poisson) trees, sqrt or log2 columns a node, Gini
XGBoost               second-order boosting by level: L1 / L2 leaf penalties, gamma, row and column samples, least child hessian
LightGBM              second-order boosting leaf by leaf (num_leaves), row sample renewed every five rounds, column samples
CatBoost              oblivious trees on ordered target statistics, Bayesian row weights, score noise
Decision Tree         Gini or entropy (registry)
Gradient Boosting     first-order boosting (registry)

Search: a seeded random search (no TPE sampler) over the same spaces. Every trial is scored by the mean ROC-AUC over stratified folds of
the training rows; preprocessing and bin edges are fitted per fold on that fold's training part (no leakage). All trials and folds of a family
are trained together: trees by ``tree_search`` (boosting stops early inside it), coefficients by ``logistic_search``. The ROC-AUC of all models
comes from one ``metrics.ranking_metrics`` job.
"""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PythonException
from pyspark.errors.exceptions.captured import UnknownException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.operators import logistic_search as LS
from churnspark.operators import tree_search as TS
from churnspark.operators.hist_trees import Spec
from churnspark.operators.metrics import ranking_metrics
from churnspark.operators.prep import PrepEstimator, PrepModel, ordered_target_stats, with_weights

PRODUCTION_MODELS = ["Logistic Regression", "Random Forest", "XGBoost", "LightGBM", "CatBoost"]
REGISTRY_MODELS = ["Decision Tree", "Gradient Boosting"]
BOOSTING = {"XGBoost", "LightGBM", "CatBoost", "Gradient Boosting"}


@dataclass
class TrainConfig:
    n_trials: int = C.N_TRIALS         # the same at every size (TRN9 reports the original's rule)
    folds: int = C.CV_FOLDS
    rf_trees: int = 300
    boost_cap: int = C.MAX_BOOST_ROUNDS
    boost_floor: int = 50
    patience: int = C.EARLY_STOP_ROUNDS
    parallelism: int = 8
    seed: int = C.RANDOM_STATE


def trial_budget(n_samples: int, base: int = C.N_TRIALS) -> int:
    """TRN9: 30 trials; > 50k rows max(15, n/2); > 100k rows max(10, n/3)."""
    if n_samples > 100_000:
        return max(10, base // 3)
    if n_samples > 50_000:
        return max(15, base // 2)
    return base


def _loguniform(rng, lo, hi):
    return float(math.exp(rng.uniform(math.log(lo), math.log(hi))))


def suggest(name: str, rng: np.random.Generator, is_imbalanced: bool) -> dict:
    """TRN13: the search spaces (seeded random draws)."""
    if name == "Logistic Regression":
        return {"C": _loguniform(rng, 0.001, 100.0),
                "class_weight": "balanced" if is_imbalanced else str(rng.choice(["balanced", "none"]))}
    if name == "Random Forest":
        return {"max_depth": int(rng.integers(3, 16)), "min_samples_leaf": int(rng.integers(2, 51)),
                "min_samples_split": int(rng.integers(2, 21)), "max_features": str(rng.choice(["sqrt", "log2"]))}
    if name == "XGBoost":
        return {"max_depth": int(rng.integers(3, 7)), "learning_rate": _loguniform(rng, 0.01, 0.3),
                "subsample": float(rng.uniform(0.5, 1.0)), "colsample_bytree": float(rng.uniform(0.5, 1.0)),
                "gamma": float(rng.uniform(0.0, 2.0)), "reg_alpha": float(rng.uniform(0.0, 5.0)),
                "reg_lambda": float(rng.uniform(1.0, 10.0)), "min_child_weight": int(rng.integers(1, 11))}
    if name == "LightGBM":
        return {"num_leaves": int(rng.integers(15, 64)), "max_depth": int(rng.integers(3, 9)),
                "feature_fraction": float(rng.uniform(0.5, 1.0)), "bagging_fraction": float(rng.uniform(0.5, 1.0)),
                "lambda_l1": float(rng.uniform(0.0, 5.0)), "lambda_l2": float(rng.uniform(1.0, 10.0))}
    if name == "CatBoost":
        return {"depth": int(rng.integers(3, 8)), "learning_rate": _loguniform(rng, 0.01, 0.3),
                "l2_leaf_reg": float(rng.uniform(1.0, 15.0)), "bagging_temperature": float(rng.uniform(0.0, 1.0)),
                "random_strength": float(rng.uniform(0.0, 2.0))}
    if name == "Decision Tree":
        return {"criterion": str(rng.choice(["gini", "entropy"])), "max_depth": int(rng.integers(2, 16)),
                "min_samples_leaf": int(rng.integers(1, 21))}
    if name == "Gradient Boosting":
        return {"n_estimators": int(rng.choice([100, 200])), "max_depth": int(rng.integers(2, 5)),
                "learning_rate": _loguniform(rng, 0.01, 0.3)}
    raise ValueError(name)


def weight_mode(name: str, params: dict, is_imbalanced: bool) -> str | None:
    """PRE6/PRE7 and Q1/Q2: which weight column a family trains with."""
    if name == "XGBoost":
        return "pos"                       # always on (Q2)
    if name == "Logistic Regression":
        return "balanced" if params.get("class_weight") == "balanced" else None
    if name in ("Random Forest", "LightGBM", "CatBoost"):
        return "balanced" if is_imbalanced else None
    return None


def class_counts(counts: dict, mode: str | None) -> tuple[float, float]:
    """(weight of a positive row, of a negative row) for class counts {label: rows}."""
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if mode == "balanced":
        return ((pos + neg) / (2.0 * pos) if pos else 1.0), ((pos + neg) / (2.0 * neg) if neg else 1.0)
    if mode == "pos":
        return (math.floor(100 * neg / pos + 0.5) / 100 if pos else 1.0), 1.0
    return 1.0, 1.0


#: Trees of a random forest grown together in one round.
FOREST_ROUND = 10


def tree_spec(name: str, params: dict, trial: int, fold: int, counts: dict, mode: str | None, cfg: TrainConfig, n_iter: int | None = None,
              stop: bool = True) -> Spec:
    """TRN2-TRN7: the model that a family and a parameter draw name. ``counts``: training rows per label."""
    w_pos, w_neg = class_counts(counts, mode)
    common = dict(trial=trial, fold=fold, w_pos=w_pos, w_neg=w_neg, n_train=sum(counts.values()), seed=cfg.seed)
    if name == "Random Forest":
        each = min(FOREST_ROUND, cfg.rf_trees)
        while cfg.rf_trees % each:
            each -= 1
        return Spec(rule="gini", rounds=cfg.rf_trees // each, trees=each, depth=params["max_depth"], min_n=params["min_samples_leaf"],
                    min_split=params["min_samples_split"], mtry=params["max_features"], rows="poisson", **common)
    if name == "Decision Tree":
        return Spec(rule=params["criterion"], depth=params["max_depth"], min_n=params["min_samples_leaf"], **common)
    rounds = n_iter or cfg.boost_cap
    if rounds < 1:
        raise ValueError("boosting needs at least one round")
    up, down = w_pos * counts.get(1, 0), w_neg * counts.get(0, 0)
    init = math.log(up / down) if up and down else 0.0
    if name == "Gradient Boosting":
        # the round cap bounds every boosting family (default 500 >= the 100/200 grid)
        return Spec(rule="friedman", rounds=n_iter or min(params["n_estimators"], cfg.boost_cap), rate=params["learning_rate"],
                    depth=params["max_depth"], init=init, **common)
    common |= dict(rounds=rounds, patience=cfg.patience)
    if name == "XGBoost":
        return Spec(rate=params["learning_rate"], depth=params["max_depth"], min_h=params["min_child_weight"], l1=params["reg_alpha"],
                    l2=params["reg_lambda"], gamma=params["gamma"], rows="bernoulli", row_p=params["subsample"],
                    cols=params["colsample_bytree"], stop="auc" if stop else "", init=init, **common)
    if name == "LightGBM":
        bagged = params["bagging_fraction"] < 1
        return Spec(growth="leaf", rate=0.1, depth=params["max_depth"], leaves=params["num_leaves"], min_n=20, min_h=1e-3,
                    l1=params["lambda_l1"], l2=params["lambda_l2"], rows="bagging" if bagged else "all", row_p=params["bagging_fraction"],
                    cols=params["feature_fraction"], stop="logloss" if stop else "", init=init, **common)
    if name == "CatBoost":
        return Spec(growth="oblivious", rate=params["learning_rate"], depth=params["depth"], l2=params["l2_leaf_reg"], rows="bayes",
                    row_p=params["bagging_temperature"], noise=params["random_strength"], stop="auc" if stop else "", **common)
    raise ValueError(name)


def logistic_regression(params: dict, n_rows: int, weighted: bool) -> LogisticRegression:
    """TRN1: the Spark ML estimator of a parameter draw."""
    common = dict(featuresCol="features", labelCol="label", **({"weightCol": "weight"} if weighted else {}))
    return LogisticRegression(maxIter=1000, elasticNetParam=0.0, standardization=False, regParam=1.0 / (params["C"] * max(n_rows, 1)), **common)


def best_iteration(losses: list[float], patience: int) -> int:
    """TRN10: number of trees at the validation-loss minimum, stopping after ``patience`` rounds without gain."""
    best, best_i, since = float("inf"), 0, 0
    for i, v in enumerate(losses):
        if v < best - 1e-12:
            best, best_i, since = v, i, 0
        else:
            since += 1
            if since >= patience:
                break
    return best_i + 1


def positive_probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    if isinstance(model, TS.TreeEnsembleModel):
        return model.score(df, out)
    return model.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1])


def lost(exc: Exception) -> bool:
    """Whether the engine lost the work (executors, memory, disk): that says nothing of a model, as a refused parameter or row does."""
    return isinstance(exc, (Py4JError, UnknownException, MemoryError)) or isinstance(exc, PythonException) and "MemoryError" in str(exc)


@dataclass
class FamilyResult:
    name: str
    params: dict = field(default_factory=dict)
    cv_score: float | None = None
    n_estimators: int | None = None
    prep: PrepModel | None = None
    model: object = None
    train_time: float = 0.0
    error: str | None = None
    calibrator: tuple | None = None              # (method, fitted) applied to every score
    trials: list = field(default_factory=list)   # (trial, params json, mean CV ROC-AUC) of every draw
    fold_rounds: list = field(default_factory=list)   # best round of every fold (families that stop early)


class Trainer:
    """TRN8/TRN11: per family a seeded search with stratified CV, then a refit on all training rows."""

    def __init__(self, numeric: list[str], categorical: list[str], cfg: TrainConfig | None = None,
                 key: str = "c_custkey", label: str = "label"):
        self.numeric = numeric
        self.categorical = categorical
        self.cfg = cfg or TrainConfig()
        self.key = key
        self.label = label
        self._cache: dict = {}   # binned or scaled rows of the folds by kind of preprocessing
        self._rows: dict = {}    # class counts of the folds
        self._held: list = []    # frames whose id() is a cache key stay alive

    def release(self):
        """Forget the rows of the folds."""
        self._cache.clear()
        self._rows.clear()
        self._held.clear()

    @staticmethod
    def prep_kind(name: str) -> tuple[bool, bool]:
        """(scale, target_encode) of a family's preprocessing."""
        return name == "Logistic Regression", name == "CatBoost"

    def _prep(self, name: str) -> PrepEstimator:
        scale, te = self.prep_kind(name)
        return PrepEstimator(self.numeric, self.categorical, scale=scale, target_encode=te, label=self.label)

    def _columns(self, prep: PrepModel, rows: DataFrame, fitted: bool) -> tuple[DataFrame, list]:
        """Rows and feature columns; the rows that a target encoding was fitted on get ordered statistics instead."""
        if not (prep.target_encode and prep.categorical):
            return rows, prep.columns()
        names = prep.output_names()
        if fitted:
            rows = ordered_target_stats(rows, prep.categorical, prep.modes, prep.prior, self.label, self.key)
            return rows, prep.columns()[:len(prep.numeric)] + [F.col(f"`te__{c}`") for c in prep.categorical]
        extra = prep.columns()[len(prep.numeric):]
        return rows.select("*", *extra), prep.columns()[:len(prep.numeric)] + [F.col(f"`{n}`") for n in names[len(prep.numeric):]]

    def _fold_rows(self, train: DataFrame, name: str):
        """Blocks of all folds, their features and number of blocks: preprocessing and edges from each fold's training part, shared by
        every family with the same preprocessing."""
        kind = (id(train), self.prep_kind(name))
        if kind in self._cache:
            return self._cache[kind]
        counts = self._fold_counts(train)
        def one(f):
            tr, va = train.filter(F.col("fold") != f), train.filter(F.col("fold") == f)
            prep = self._prep(name).fit(tr)
            tr, columns = self._columns(prep, tr, True)
            edges = None if prep.scale else TS.bin_edges(tr, columns, prep.output_names())
            va, _ = self._columns(prep, va, False)
            rows = tr.withColumn("__held", F.lit(False)).unionByName(va.withColumn("__held", F.lit(True)))
            return f, rows, columns, edges, F.col("__held")

        with ThreadPoolExecutor(max_workers=self.cfg.parallelism) as ex:
            parts = list(ex.map(one, range(self.cfg.folds)))
        n_blocks = TS.blocks_of(sum(sum(c.values()) for c in counts.values()), len(parts[0][2]), whole=not kind[1][0])
        blocks = TS.fold_blocks(parts, self.key, self.label, n_blocks)
        self._cache[kind] = blocks, {f: len(columns) for f, _, columns, _, _ in parts}, n_blocks
        return self._cache[kind]

    def _fold_counts(self, train: DataFrame) -> dict[int, dict[int, int]]:
        """Rows per fold and label."""
        if id(train) not in self._rows:
            self._held.append(train)
            found = train.groupBy("fold", F.col(self.label).cast("int").alias("y")).count().collect()   # two rows per fold
            self._rows[id(train)] = {f: {r["y"]: r["count"] for r in found if r["fold"] == f} for f in range(self.cfg.folds)}
        return self._rows[id(train)]

    def search(self, name: str, train: DataFrame, is_imbalanced: bool) -> FamilyResult:
        """``train`` carries ``fold`` (stratified folds of the training rows)."""
        return self.search_many([name], train, is_imbalanced)[name]

    def _held_out(self, name: str, draws: list[dict], train: DataFrame, is_imbalanced: bool, n_iter: int | None = None):
        """(trial, fold, label, p) of every fold's held-out rows under every draw, and the best rounds. With ``n_iter`` boosting runs that many
        rounds and does not stop."""
        counts = self._fold_counts(train)
        inside = {f: {y: sum(c.get(y, 0) for g, c in counts.items() if g != f) for y in (0, 1)} for f in counts}
        modes = [weight_mode(name, p, is_imbalanced) for p in draws]
        specs = [] if name == "Logistic Regression" else [
            tree_spec(name, p, t, f, inside[f], m, self.cfg, n_iter=n_iter, stop=n_iter is None)
            for f in inside for t, (p, m) in enumerate(zip(draws, modes))]
        blocks, width, n_blocks = self._fold_rows(train, name)
        if name == "Logistic Regression":
            weights = {f: np.array([class_counts(inside[f], m)[::-1] for m in modes]) for f in inside}
            reg = {f: np.array([1.0 / (p["C"] * max(sum(inside[f].values()), 1)) for p in draws]) for f in inside}
            return LS.held_out_scores(blocks, LS.fit_all(blocks, reg, weights, width, n_blocks)), {}
        rows = sum(sum(c.values()) for c in counts.values())
        alone = TS.long_and_whole(min(s.n_train for s in specs), rows, max(width.values()))
        state, books, _ = TS.train(blocks, specs, n_blocks, blocks.sparkSession.sparkContext.defaultParallelism, columns=width, alone=alone)
        return TS.held_out_scores(state), {(s.trial, s.fold): int(r) for b in books.values() for s, r in zip(b.specs, b.best_round)}

    def out_of_fold(self, name: str, params: dict, rows: DataFrame, is_imbalanced: bool, n_iter: int | None = None) -> DataFrame:
        """(fold, label, p): every row scored by the model of the folds it is not in (``rows`` carries ``fold``)."""
        boosts = name in BOOSTING and name != "Gradient Boosting"
        scored, _ = self._held_out(name, [params], rows, is_imbalanced, (n_iter or self.cfg.boost_cap) if boosts else None)
        return scored.select("fold", F.col("label").alias(self.label), "p")

    def _search_family(self, name: str, train: DataFrame, is_imbalanced: bool) -> FamilyResult:
        """Every draw and fold of a family together; the best draw by mean validation ROC-AUC."""
        res, cfg = FamilyResult(name), self.cfg
        known = PRODUCTION_MODELS.index(name) if name in PRODUCTION_MODELS else 10 + REGISTRY_MODELS.index(name)
        rng = np.random.default_rng([cfg.seed, known])
        draws = [suggest(name, rng, is_imbalanced) for _ in range(cfg.n_trials)]
        scored, rounds = self._held_out(name, draws, train, is_imbalanced)
        aucs = ranking_metrics(scored, keys=["trial", "fold"]).select("trial", "fold", "roc_auc").collect()   # one row per model
        by_trial = [[r["roc_auc"] for r in aucs if r["trial"] == t and r["roc_auc"] is not None] for t in range(len(draws))]
        means = [sum(a) / len(a) if a else None for a in by_trial]
        best = max(range(len(draws)), key=lambda t: (means[t] if means[t] is not None else -1, -t))
        res.params, res.cv_score = draws[best], means[best]
        res.trials = [(t, params_json(p), means[t]) for t, p in enumerate(draws)]
        if name in BOOSTING and name != "Gradient Boosting":
            med = float(np.median([rounds[best, f] for f in range(cfg.folds)]))
            res.n_estimators = int(min(max(med, min(cfg.boost_floor, cfg.boost_cap)), cfg.boost_cap))
            res.fold_rounds = [rounds[best, f] for f in range(cfg.folds)]
        return res

    def search_many(self, names: list[str], train: DataFrame, is_imbalanced: bool) -> dict:
        """TRN8 for several families: the families' searches and the winners' refits side by side, each a sequence of jobs over all rows. A
        failing family keeps its error (TRN11); work that the engine lost is raised, it is no result of a family."""
        results = {}
        for n in {self.prep_kind(n): n for n in names}.values():   # shared by the families of a kind
            try:
                self._fold_rows(train, n)
            except Exception:  # noqa: BLE001 (the family's own search reports it)
                pass

        def run(n):
            t0 = time.time()
            try:
                res = self._search_family(n, train, is_imbalanced)
                res.prep, res.model = self.refit(n, res.params, train, is_imbalanced, res.n_estimators)
            except Exception as exc:  # noqa: BLE001
                if lost(exc):
                    raise
                res = FamilyResult(n, error=f"{type(exc).__name__}: {exc}"[:500])
            res.train_time = time.time() - t0
            return res

        with ThreadPoolExecutor(max_workers=min(len(names), self.cfg.parallelism)) as ex:
            results = dict(zip(names, ex.map(run, names)))
        return results

    def refit(self, name: str, params: dict, rows: DataFrame, is_imbalanced: bool, n_iter: int | None = None):
        """Fit preprocessing and the model on all given rows (Q1: weights kept in the refit)."""
        prep = self._prep(name).fit(rows)
        mode = weight_mode(name, params, is_imbalanced)
        counts = {r[0]: r[1] for r in rows.groupBy(F.col(self.label).cast("int")).count().collect()}   # two rows
        if name == "Logistic Regression":
            vec = prep.transform(rows, keep=[self.key, self.label])
            data = with_weights(vec, mode, self.label) if mode else vec
            return prep, logistic_regression(params, sum(counts.values()), mode is not None).fit(data)
        spec = tree_spec(name, params, 0, 0, counts, mode, self.cfg, n_iter=n_iter, stop=False)
        rows, columns = self._columns(prep, rows, True)
        n_blocks = TS.blocks_of(sum(counts.values()), len(columns))
        return prep, TS.fit(rows, prep, columns, spec, self.key, self.label, n_blocks, rows.sparkSession.sparkContext.defaultParallelism)

    def score(self, res: FamilyResult, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """SCR1: P(churn) for rows with the family's frozen preprocessing and model."""
        cols = [c for c in df.columns if c in (self.key, self.label)] + list(keep or [])
        vec = res.prep.transform(df, keep=cols)
        return calibrated(positive_probability(res.model, vec), res.calibrator)


def params_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


# --- calibration (EVL14-EVL16) ---------------------------------------------------------------

def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(q / (1 - q))


def fit_platt(cal: DataFrame, p: str = "p", label: str = "label"):
    """EVL14: sigmoid calibration = one-feature logistic regression on the score's logit, with Platt's smoothed targets
    (n+ + 1) / (n+ + 2) and 1 / (n- + 2): every row counts towards both classes with those weights."""
    from pyspark.ml.feature import VectorAssembler
    n = cal.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
                F.count_if(F.col(p).isNull() | F.isnan(p) | F.col(label).isNull()).alias("unknown")).first()
    if n["unknown"] or not n["pos"] + n["neg"]:
        raise ValueError(f"{n['pos'] + n['neg']} rows to calibrate on, {n['unknown']} rows without a score or label")
    target = F.when(F.col(label) == 1, F.lit((n["pos"] + 1) / (n["pos"] + 2))).otherwise(F.lit(1 / (n["neg"] + 2)))
    x = cal.select(_logit(F.col(p)).alias("__z"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))).alias("t"))
    v = VectorAssembler(inputCols=["__z"], outputCol="__zv").transform(x.select("__z", "t.y", "t.w"))
    return LogisticRegression(featuresCol="__zv", labelCol="y", weightCol="w", regParam=0.0, maxIter=100).fit(v)


def apply_platt(model, df: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=["__z"], outputCol="__zv").transform(df.withColumn("__z", _logit(F.col(p))))
    coef = float(model.coefficients[0])
    b = float(model.intercept)
    return x.withColumn(out, 1.0 / (1.0 + F.exp(-(F.lit(coef) * F.col("__z") + F.lit(b))))).drop("__z", "__zv")


def calibrated(df: DataFrame, calibrator: tuple | None, p: str = "p") -> DataFrame:
    """``df`` with the chosen calibrator applied to ``p`` (EVL16); unchanged without one."""
    if not calibrator:
        return df
    method, model = calibrator
    out = apply_platt(model, df, p, "__cal") if method == "sigmoid" else model.apply(df, p, "__cal")
    return out.withColumn(p, F.col("__cal")).drop("__cal")


def brier_of(df: DataFrame, p: str, label: str = "label") -> float:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("b")).first()["b"]


def choose_calibration(brier_before: float, candidates: dict[str, float]) -> tuple[str | None, float | None]:
    """EVL16: the best method, used only when it lowers the Brier score by more than 0.001."""
    if not candidates:
        return None, None
    method = min(candidates, key=candidates.get)
    after = candidates[method]
    if brier_before is not None and after < brier_before - C.CALIBRATION_MIN_GAIN:
        return method, after
    return None, after
