"""All trials and folds of a family trained together: binned rows once per fold, then rounds of trees for every model at once.

``fold_blocks`` writes the binned rows of every fold (its edges and preprocessing come from its own training part) as blocks, one where the
fold has at most ``BLOCK_ROWS`` rows. ``train`` grows the models; the result is a table in the shared folder.

* Larger folds: one job per tree level. Every block sums the histograms of the nodes that the trees need, the sums are
  added up a fan of blocks at a time, and the best splits of each part (one row per part, bounded by nodes and not by data) go back to the
  driver, which names the next nodes. A round ends with one job that adds the new trees to the margins and sums the validation score; the
  state after it is a table, so a lost executor costs one step and no lineage grows.
* Folds of one block, or of so few that a task can hold them all (``long_and_whole``): the sum over blocks is the task's own, so one job trains everything: a
  task has a fold and a few of its models, and reads the blocks of the fold itself.

Both take their splits from the same histograms and give the same trees. Early stopping ends a model ``patience`` rounds after its best
round; its fold score is that of the best round.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.operators import hist_trees as H
from churnspark.operators.prep import PrepModel
from churnspark.session import stored

BINS = 64
#: Rows (and cells: 16 a row) up to which a fold is one block; larger folds have blocks of a quarter of the rows.
BLOCK_ROWS = 1 << 20
#: Rows and cells of a fold whose blocks a task puts together, to train on all of them.
WHOLE_ROWS, WHOLE_CELLS = 6 << 20, 72 << 20
#: Validation rows of a row of the table that growing leaves.
HELD_A_ROW = 1 << 17
#: Blocks whose sums one task adds up.
FAN = 16
QUANTILE_ACCURACY = 10_000
#: Trees of one row of the table that growing leaves; rows x trees that are scored together.
TREES_A_ROW, SCORED = 10, 1 << 16


def blocks_of(rows: int, width: int, whole: bool = True) -> int:
    """Blocks of a fold with ``width`` features; ``whole``: one block where the fold is small enough for a task to train on."""
    if whole and rows <= BLOCK_ROWS and rows * width <= 16 * BLOCK_ROWS:
        return 1
    return -(-rows // max(1, BLOCK_ROWS // 4)) or 1


def long_and_whole(n_train: int, rows: int, width: int) -> bool:
    """Whether a fold is so long that its models train alone, and not too long for a task to train on all of it."""
    return n_train >= H.LISTED and rows <= WHOLE_ROWS and rows * width <= WHOLE_CELLS


# --- binned rows ------------------------------------------------------------------------------

def bin_edges(rows: DataFrame, columns: list[Column], names: list[str], bins: int = BINS) -> list[list[float]]:
    """Per column the upper bin edges: quantiles of the rows; 0.5 for indicators."""
    share = [i / bins for i in range(1, bins)]
    counted = [i for i, n in enumerate(names) if not n.startswith("cat__")]
    out = [[0.5]] * len(names)
    if counted:
        got = rows.select(*columns).agg(*[F.percentile_approx(F.col(f"`{names[i]}`"), share, QUANTILE_ACCURACY).alias(f"q{i}") for i in counted]).first()
        for i in counted:
            out[i] = sorted(set(got[f"q{i}"] or [0.0]))
    return out


def _pack(edges: list[list[float]] | None):
    """Rows of one partition -> one block; features binned, or as they are without edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ids, y, held, *xs = (np.nan_to_num(c.to_numpy()) if i > 2 else c.to_numpy() for i, c in enumerate(t.columns))
        if edges is not None:
            xs = [np.searchsorted(e, x).astype(np.uint8) for e, x in zip(edges, xs)]
        x = np.column_stack(xs) if xs else np.zeros((len(y), 0))
        data = pickle.dumps((x, y.astype(np.int8), ids.astype(np.int64).view(np.uint64), held.astype(bool)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])
    return run


def fold_blocks(folds: list[tuple[int, DataFrame, list[Column], list[list[float]] | None, Column]], key: str, label: str, n_blocks: int) -> DataFrame:
    """(fold, block, data): per fold (number, rows, feature columns, edges, validation flag) its rows in ``n_blocks`` blocks.

    Block numbers are unique within a fold and below folds * ``n_blocks``."""
    out = None
    for f, rows, columns, edges, held in folds:
        flat = rows.select(F.xxhash64(F.col(f"`{key}`")).alias("__id"), F.col(label).cast("int").alias("__y"), held.alias("__held"),
                           *[c.alias(f"x{i}") for i, c in enumerate(columns)]).repartition(n_blocks)
        part = flat.mapInArrow(_pack(edges), "data binary").select(F.lit(f).alias("fold"), F.spark_partition_id().alias("block"), "data")
        out = part if out is None else out.unionByName(part)
    return stored(out, "blocks", by="" if folds[0][3] is None else "fold")   # a task of the tree search reads one fold


# --- growing ----------------------------------------------------------------------------------

STATE = "fold int, grp int, block int, alive int, sums binary, data binary"


def _state(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, H.Block]]:
    fold, grp, block, data = (batch.column(batch.schema.get_field_index(n)) for n in ("fold", "grp", "block", "data"))
    for i in range(batch.num_rows):
        yield fold[i].as_py(), grp[i].as_py(), block[i].as_py(), pickle.loads(data[i].as_buffer())   # a row's megabytes at a time


def _state_row(fold: int, grp: int, block: int, b: H.Block, sums: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([fold], pa.int32()), pa.array([grp], pa.int32()), pa.array([block], pa.int32()), pa.array([len(b.growing())], pa.int32()),
         pa.array([None if sums is None else pickle.dumps(sums)], pa.binary()), pa.array([pickle.dumps(b, protocol=5)], pa.binary())],
        names=["fold", "grp", "block", "alive", "sums", "data"])


def _trees_row(fold: int, grp: int, first: int, trees: list[dict]) -> pa.RecordBatch:
    """Trees from number ``first`` on; ``alive`` -1 tells such rows from states."""
    return pa.RecordBatch.from_arrays(
        [*(pa.array([v], pa.int32()) for v in (fold, grp, first, -1)), pa.array([None], pa.binary()), pa.array([pickle.dumps(trees, protocol=5)], pa.binary())],
        names=["fold", "grp", "block", "alive", "sums", "data"])


def _starter(specs: dict[tuple[int, int], list[H.Spec]], bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, grp, block, (x, y, ids, held) in _state(batch):
                yield _state_row(fold, grp, block, H.Block(x, y, ids, held, specs[fold, grp], bins).start())
    return run


def _whole(specs: dict[tuple[int, int], list[H.Spec]], bins: int, keep: bool):
    """All rounds of a group of models where a task has all blocks of their fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for fold, grp, _, block in _state(batch):
                found.setdefault((fold, grp), []).append(block)
        for fold, grp in list(found):
            own = specs[fold, grp]
            b = H.Block(*_together(found.pop((fold, grp))), own, bins).start().grow(max(s.rounds for s in own), keep)
            trees, b.trees = b.trees, []
            for part in b.finished().pieces(HELD_A_ROW):
                yield _state_row(fold, grp, 0, part)
            for i in range(0, len(trees), TREES_A_ROW):   # a deep forest is too large for one row
                yield _trees_row(fold, grp, i, trees[i:i + TREES_A_ROW])
    return run


def _together(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of several blocks, training rows first; columns lie one after the other. ``blocks`` is emptied."""
    if len(blocks) == 1:
        return blocks.pop()
    n, d = sum(len(b[1]) for b in blocks), blocks[0][0].shape[1]
    x, y, ids, held = np.empty((d, n), blocks[0][0].dtype), *(np.empty(n, a.dtype) for a in blocks[0][1:])
    at, end = 0, n
    while blocks:
        part = blocks.pop()
        order = np.argsort(part[3], kind="stable")
        own = int((~part[3]).sum())
        for here, there in ((order[:own], slice(at, at + own)), (order[own:], slice(end - len(order) + own, end))):
            for i in range(d):
                x[i, there] = part[0][:, i].take(here)
            y[there], ids[there], held[there] = (a.take(here) for a in part[1:])
        at, end = at + own, end - len(order) + own
    return x.T, y, ids, held


def _row_by_row(blocks: DataFrame) -> DataFrame:
    """Stored blocks in a session of their own, whose Arrow batches have one row: a batch of many such rows takes the JVM a multiple of its size."""
    spark, root, found = blocks.sparkSession, *next(iter(blocks.inputFiles()), "").rpartition("/fold=")[:2]
    if not found:
        return blocks
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    return own.read.schema(blocks.schema).parquet(root).select(blocks.columns)


def _units(blocks: DataFrame, groups: dict[tuple[int, int], list[H.Spec]], bins: int, keep: bool) -> DataFrame:
    """A group of models a task, the heaviest first; every task reads its fold's blocks where they lie, no copy of them is shuffled."""
    # no row, but partitioned otherwise: a union of children that are all single partitions would be a single partition, one task for all models
    blocks = _row_by_row(blocks)
    parts = [blocks.sparkSession.range(0, 1, 1, 2).filter("id < 0").selectExpr(*(f"CAST(NULL AS {t}) AS {n}" for n, t in map(str.split, STATE.split(","))))]
    for f, g in sorted(groups, key=lambda k: -sum(s.work for s in groups[k])):
        own = blocks.filter(F.col("fold") == f).select("fold", F.lit(g).alias("grp"), "block", "data").coalesce(1)
        parts.append(own.mapInArrow(_whole({(f, g): groups[f, g]}, bins, keep), STATE))
    while len(parts) > 1:   # neighbours in pairs: a chain of unions is analysed again at every link
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class _Plan:
    """What the driver knows of a group of models in a round: early stopping, the growing trees, models that got better last."""

    def __init__(self, specs: list[H.Spec], bins: int):
        nothing = np.zeros(0, bool)
        self.book = H.Block(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.uint64), nothing, specs, bins).start()
        self.better: list[int] = []
        self.trees: list = []
        self.grower = None

    def begin(self, d: int) -> bool:
        self.which = self.book.growing()
        if not len(self.which):
            self.grower = None
            return False
        self.batch = H.make_batch([self.book.specs[i] for i in self.which], self.book.round, d, self.book.bins)
        self.grower = H.Grower(self.batch)
        return True


def _with_plan(b: H.Block, plan: _Plan) -> H.Block:
    b.round, b.done, b.best, b.best_round = plan.book.round, plan.book.done, plan.book.best, plan.book.best_round
    return b


SUMS = "fold int, grp int, part int, block int, data binary"


def _level(plans: dict[tuple[int, int], _Plan]):
    """Every block's histograms of the nodes that the trees need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, grp, block, b in _state(batch):
                plan = plans[fold, grp]
                if plan.grower is None or not len(plan.grower.active):
                    continue
                stats = _with_plan(b, plan).statistics(plan.which, plan.batch)
                node = H.walk(plan.grower, b.x)
                for part, nodes in enumerate(H.chunks(plan.grower, b.x.shape[1])):
                    hist = H.node_histograms(plan.grower, nodes, b.x, node, stats)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([v], pa.int32()) for v in (fold, grp, part, block)), pa.array([pickle.dumps(hist, protocol=5)], pa.binary())],
                        names=["fold", "grp", "part", "block", "data"])
    return run


def _added(g: pd.DataFrame) -> pd.DataFrame:
    total = None
    for data in g["data"]:
        one = pickle.loads(data)
        total = one if total is None else total + one
    return g.iloc[:1].assign(block=int(g["block"].iloc[0]) // FAN, data=[pickle.dumps(total, protocol=5)])


def added(sums: DataFrame, n_blocks: int) -> DataFrame:
    """Sums over all blocks (numbers below ``n_blocks``), a fan of blocks in one task."""
    while True:
        sums = sums.groupBy("fold", "grp", "part", F.floor(F.col("block") / FAN).alias("__fan")).applyInPandas(_added, SUMS)
        n_blocks = -(-n_blocks // FAN)
        if n_blocks == 1:
            return sums


def _chooser(plans: dict[tuple[int, int], _Plan], d: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            out = []
            for fold, grp, part, data in zip(g["fold"], g["grp"], g["part"], g["data"]):
                grower = plans[fold, grp].grower
                nodes = H.chunks(grower, d[fold])[part]
                out.append(pickle.dumps(H.choose(grower.batch, pickle.loads(data), grower.tree[nodes], grower.path[nodes])))
            yield g.assign(data=out)
    return run


def _ending(plans: dict[tuple[int, int], _Plan], values: dict[tuple[int, int], np.ndarray]):
    """Add the finished trees to the margins; sum the validation score of every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, grp, block, b in _state(batch):
                plan = plans[fold, grp]
                _with_plan(b, plan).remember(plan.better)
                sums = None
                if plan.grower is not None:
                    b.add(plan.which, values[fold, grp][H.walk(plan.grower, b.x)])
                    sums = b.validation(plan.which)
                yield _state_row(fold, grp, block, b, sums)
    return run


def _distributed(state: DataFrame, specs: dict[tuple[int, int], list[H.Spec]], d: dict[int, int], bins: int, n_blocks: int, keep: bool):
    plans = {k: _Plan(s, bins) for k, s in specs.items()}
    while any([p.begin(d[k[0]]) for k, p in plans.items()]):
        while any(p.grower is not None and len(p.grower.active) for p in plans.values()):
            sums = added(state.mapInArrow(_level(plans), SUMS), n_blocks)
            found = {}
            for fold, grp, part, data in sums.mapInPandas(_chooser(plans, d), SUMS).select("fold", "grp", "part", "data").collect():
                found.setdefault((fold, grp), {})[part] = pickle.loads(data)   # one row per part of the nodes
            for k, parts in found.items():
                grower = plans[k].grower
                H.chunks(grower, d[k[0]])   # the order of the parts
                grower.step(H.joined([parts[i] for i in range(len(parts))]))
        values = {}
        for k, p in plans.items():
            if p.grower is not None:
                values[k] = p.grower.values()
                if keep:
                    p.trees += p.grower.export(values[k])
        state = stored(state.mapInArrow(_ending(plans, values), STATE), "trees", rows_a_file=1)
        sums = state.filter("sums is not null").select("fold", "grp", F.lit(0).alias("part"), "block", F.col("sums").alias("data"))
        for fold, grp, data in added(sums, n_blocks).select("fold", "grp", "data").collect():   # one row per group of models
            p = plans[fold, grp]
            p.better = p.book.judge(p.which, pickle.loads(data))
        for p in plans.values():
            if p.grower is not None:
                p.book.round += 1
            else:
                p.better = []
    # the margins of the models that got better in the last round
    for p in plans.values():
        p.grower = None
    state = stored(state.mapInArrow(_ending(plans, {}), STATE), "trees", rows_a_file=1)
    return state, {k: p.book for k, p in plans.items()}, {k: p.trees for k, p in plans.items()}


def grouped(specs: list[H.Spec], n_blocks: int, parallelism: int) -> dict[tuple[int, int], list[H.Spec]]:
    """The models of every (fold, group). A fold of one block that is long enough for lists of rows gains nothing from models that grow side by side:
    a group is one model there, the heaviest ones first, so that no task ends long after the others."""
    by_fold: dict[int, list[H.Spec]] = {}
    for s in specs:
        by_fold.setdefault(s.fold, []).append(s)
    groups = {}
    for f, own in by_fold.items():
        alone = n_blocks == 1 and min(s.n_train for s in own) >= H.LISTED
        n = len(own) if alone else min(len(own), parallelism)
        if alone:
            own = sorted(own, key=lambda s: -s.work)
        for g in range(n):
            groups[f, g] = own[g::n]
    return groups


def train(blocks: DataFrame, specs: list[H.Spec], n_blocks: int, parallelism: int, bins: int = BINS, keep: bool = False,
          columns: dict[int, int] | None = None, alone: bool = False):
    """Grow all models; returns the final state, per (fold, group) its bookkeeping and, with ``keep``, its trees.

    ``columns``: features of every fold (needed for folds of several blocks). ``alone``: a task trains on all blocks of a fold."""
    groups = grouped(specs, 1 if alone else n_blocks, parallelism)
    numbers: dict[int, int] = {}
    for f, _ in groups:
        numbers[f] = numbers.get(f, 0) + 1
    per_fold = F.element_at(F.create_map(*[F.lit(v) for item in numbers.items() for v in item]), F.col("fold"))
    units = blocks.filter(F.col("fold").isin(list(numbers))).withColumn("grp", F.explode(F.sequence(F.lit(0), per_fold - 1)))
    units = units.select("fold", "grp", "block", "data")
    if n_blocks > 1 and not alone:
        state = stored(units.repartition(max(parallelism, n_blocks)).mapInArrow(_starter(groups, bins), STATE), "trees", rows_a_file=1)
        return _distributed(state, groups, columns, bins, n_blocks * len(numbers), keep)   # the folds' blocks are numbered on
    # a group a task, the heaviest ones of all folds first
    if alone:
        grown = _units(blocks, groups, bins, keep)
    else:
        grown = units.repartitionByRange(len(groups), "grp", "fold").mapInArrow(_whole(groups, bins, keep), STATE)
    state = stored(grown, "trees", rows_a_file=1, session=blocks.sparkSession)
    grown, state = state.filter("alive < 0"), state.filter("alive >= 0")
    books, trees = {}, {k: [] for k in groups}
    for fold, grp, data in state.mapInArrow(_books, "fold int, grp int, data binary").collect():   # one row per group of models
        books[fold, grp] = pickle.loads(data)
    if keep:
        for fold, grp, data in grown.orderBy("fold", "grp", "block").select("fold", "grp", "data").toLocalIterator():   # the model
            trees[fold, grp] += pickle.loads(data)
    return state, books, trees


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fold, grp, _, b in _state(batch):
            b.x = b.y = b.ids = b.held = b.margin = b.best_margin = None
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([grp], pa.int32()), pa.array([pickle.dumps(b)], pa.binary())],
                                             names=["fold", "grp", "data"])


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, b in _state(batch):
            y = b.y[b.held]
            for s, p in zip(b.specs, b.scores()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), s.trial, np.int32)), pa.array(np.full(len(y), s.fold, np.int32)), pa.array(y.astype(np.int32)),
                     pa.array(p, pa.float64())], names=["trial", "fold", "label", "p"])


def held_out_scores(state: DataFrame) -> DataFrame:
    """(trial, fold, label, p) of every validation row and model, at the models' best rounds."""
    return state.mapInArrow(_scorer, "trial int, fold int, label int, p double")


# --- the fitted model -------------------------------------------------------------------------

class Scorer:
    """What scoring needs of an ensemble: every worker holds it, and of a deep forest the whole model is several times as large."""

    def __init__(self, model: TreeEnsembleModel):
        self.rate, self.init, self.boosts, self.n_trees = model.rate, model.init, model.boosts, model.n_trees
        inner = model.feature >= 0
        cuts, number = np.unique(np.stack([model.feature[inner].astype(float), model.threshold[inner]]), axis=1, return_inverse=True)
        self.cut_feature, self.cut = np.append(cuts[0].astype(np.int64), 0), np.append(cuts[1], np.inf)   # the last for leaves
        self.roots = model.roots
        self.split = np.full(len(inner), len(cuts[0]), np.min_scalar_type(len(cuts[0])))
        self.split[inner] = number.ravel()
        # the left child (the right one follows), or the place of the leaf's value
        self.next = model.left.astype(np.min_scalar_type(-max(1, len(inner))))
        self.next[~inner] = np.arange(int((~inner).sum()))
        self.leaf = model.value[~inner]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row (with rate and start value), or their mean."""
        out, leaf = np.zeros(len(x)), len(self.cut_feature) - 1
        step = max(1, SCORED // max(1, self.n_trees))
        for i in range(0, len(x), step):
            part = x[i:i + step]
            node = np.repeat(self.roots[None], len(part), axis=0)
            row = np.arange(len(part))[:, None]
            while True:
                s = self.split[node]
                inner = s < leaf
                if not inner.any():
                    break
                go = part[row, self.cut_feature[s]] > self.cut[s]
                node = np.where(inner, self.next[node] + go, node)
            out[i:i + step] = self.leaf[self.next[node]].sum(axis=1)
        return self.init + self.rate * out if self.boosts else out / max(1, self.n_trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(np.nan_to_num(x))
        return H.sigmoid(m) if self.boosts else m


class TreeEnsembleModel:
    """Trees over the assembled feature vector: a sum of leaf values on the log-odds scale, or a mean of class shares."""

    def __init__(self, trees: list[dict], edges: list[list[float]], rate: float, init: float, boosts: bool):
        self.rate, self.init, self.boosts, self.n_trees, self.n_features = rate, init, boosts, len(trees), len(edges)
        start = np.cumsum([0] + [len(t["feature"]) for t in trees])
        self.roots = start[:-1].astype(np.int64)
        cat = {n: np.concatenate([t[n] for t in trees]) if trees else np.zeros(0) for n in ("feature", "bin", "left", "value", "gain", "cover")}
        self.feature = cat["feature"].astype(np.int64)
        shift = np.repeat(start[:-1], np.diff(start))
        self.left = np.where(cat["left"] >= 0, cat["left"] + shift, -1).astype(np.int64)
        self.threshold = np.array([edges[f][b] if f >= 0 and b < len(edges[f]) else np.inf for f, b in zip(self.feature, cat["bin"].astype(int))])
        self.value, self.gain, self.cover = (cat[n].astype(float) for n in ("value", "gain", "cover"))

    FIELDS = ("roots", "feature", "left", "threshold", "value", "gain", "cover")

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row (with rate and start value), or their mean."""
        return Scorer(self).margin(x)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return Scorer(self).probability(x)

    def score(self, df: DataFrame, out: str = "p", features: str = "features") -> DataFrame:
        """``df`` with P(churn) from the feature vector."""
        scorer = Scorer(self)

        def p(batch: pd.Series) -> pd.Series:
            x = np.array(batch.tolist(), dtype=float).reshape(len(batch), -1)
            return pd.Series(scorer.probability(x), dtype="float64")
        return df.withColumn(out, F.pandas_udf(p, "double")(vector_to_array(F.col(features))))

    def paths(self) -> dict[str, np.ndarray]:
        """Per leaf its value and, for every feature on the way to it, the range (lo, hi] that leads there and the share of rows that follow.

        Padded to the longest path with a feature that always holds (-1, share 1)."""
        rows = []
        for root in self.roots.tolist():
            stack = [(root, {})]
            while stack:
                i, way = stack.pop()
                f = int(self.feature[i])
                if f < 0:
                    rows.append((float(self.value[i]), way))
                    continue
                for c, right in ((int(self.left[i]), False), (int(self.left[i]) + 1, True)):
                    lo, hi, share = way.get(f, (-np.inf, np.inf, 1.0))
                    t = float(self.threshold[i])
                    share *= float(self.cover[c] / self.cover[i]) if self.cover[i] > 0 else 0.5
                    stack.append((c, way | {f: (max(lo, t), hi, share) if right else (lo, min(hi, t), share)}))
        most = max((len(w) for _, w in rows), default=0) or 1
        out = {"feature": np.full((len(rows), most), -1), "lo": np.full((len(rows), most), -np.inf), "hi": np.full((len(rows), most), np.inf),
               "share": np.ones((len(rows), most)), "value": np.array([v for v, _ in rows])}
        for i, (_, way) in enumerate(rows):
            for j, (f, (lo, hi, share)) in enumerate(way.items()):
                out["feature"][i, j], out["lo"][i, j], out["hi"][i, j], out["share"][i, j] = f, lo, hi, share
        return out

    def expected(self, paths: dict[str, np.ndarray]) -> float:
        """Mean output over the training rows."""
        total = float((paths["value"] * paths["share"].prod(axis=1)).sum())
        return self.init + self.rate * total if self.boosts else total / max(1, self.n_trees)

    def attributions(self, x: np.ndarray, paths: dict[str, np.ndarray]) -> np.ndarray:
        """(rows, features) exact Shapley values of the output (``margin``), absent features following the training rows' shares.

        A leaf gives feature i: value * (o_i - z_i) * integral over t in (0, 1) of the product over the other features j of
        z_j (1 - t) + o_j t, with z the share that follows the path and o whether the row does: the integral of t^s (1 - t)^(m-1-s) is the Shapley
        weight. The integrand is a polynomial of degree m - 1, so ceil(m / 2) Gauss points give it exactly.
        """
        n, most = len(x), paths["feature"].shape[1]
        nodes, weights = np.polynomial.legendre.leggauss(-(-most // 2))
        t, w = (nodes + 1) / 2, weights / 2
        out = np.zeros((self.n_features + 1, n))
        step = max(1, 4_000_000 // max(1, n * most * len(t)))
        for i in range(0, len(paths["value"]), step):
            f, lo, hi, z, v = (paths[k][i:i + step] for k in ("feature", "lo", "hi", "share", "value"))
            at = x[:, np.maximum(f, 0)]
            o = ((at > lo) & (at <= hi)) | (f < 0)
            term = z[..., None] * (1 - t) + o[..., None] * t                    # (rows, leaves, features, points)
            whole = term.prod(axis=2, keepdims=True)
            others = np.divide(whole, term, out=np.zeros_like(term), where=term > 0) @ w
            phi = v[:, None] * (o - z) * others
            for j in range(most):
                np.add.at(out, f[:, j], phi[:, :, j].T)                            # the padding's zeros go to the last row
        out = out[:-1].T
        return self.rate * out if self.boosts else out / max(1, self.n_trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (as Spark ML names it)
        """Share of each feature in the total gain."""
        total = np.zeros(self.n_features)
        inner = self.feature >= 0
        np.add.at(total, self.feature[inner], self.gain[inner])
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def save(self, path: str) -> None:
        """One JSON row per tree."""
        spark = SparkSession.getActiveSession()
        ends = np.append(self.roots[1:], len(self.feature))
        head = {"rate": self.rate, "init": self.init, "boosts": self.boosts, "n_features": self.n_features}
        rows = [(i, json.dumps({n: getattr(self, n)[a:b].tolist() for n in self.FIELDS[1:]} | {"root": int(a)} | head))
                for i, (a, b) in enumerate(zip(self.roots, ends))]
        spark.createDataFrame(rows, "tree int, nodes string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeEnsembleModel:
        found = [json.loads(r["nodes"]) for r in spark.read.parquet(path).orderBy("tree").collect()]   # one row per tree
        self = cls.__new__(cls)
        self.rate, self.init, self.boosts, self.n_features = (found[0][n] for n in ("rate", "init", "boosts", "n_features"))
        self.n_trees, self.roots = len(found), np.array([t["root"] for t in found], np.int64)
        for n in cls.FIELDS[1:]:
            setattr(self, n, np.concatenate([np.array(t[n], float) for t in found]).astype(np.int64 if n in ("feature", "left") else float))
        return self


def fit(rows: DataFrame, prep: PrepModel, columns: list[Column], spec: H.Spec, key: str, label: str, n_blocks: int, parallelism: int) -> TreeEnsembleModel:
    """One model on all rows."""
    names = prep.output_names()
    edges = bin_edges(rows, columns, names)
    blocks = fold_blocks([(spec.fold, rows, columns, edges, F.lit(False))], key, label, n_blocks)
    alone = long_and_whole(spec.n_train, spec.n_train, len(names))
    specs = [spec] if spec.boosts or not alone else spec.parts(parallelism)   # the trees of a forest need not wait for each other
    _, books, trees = train(blocks, specs, n_blocks, parallelism, keep=True, columns={spec.fold: len(names)}, alone=alone)
    order = sorted(trees, key=lambda k: books[k].specs[0].first)
    return TreeEnsembleModel([t for k in order for t in trees[k]], edges, spec.rate, spec.init, spec.boosts)
