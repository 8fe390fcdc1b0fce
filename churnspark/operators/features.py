"""Feature engineering and selection as Estimator/Model (FEA1-FEA8).

``FeatureEstimator.fit`` looks at the training rows only (the original used
all rows before the split): one aggregate for min/variance/skewness of every
numeric column, one for the candidates' spread. The fitted ``FeatureModel``
is a frozen list of expressions, so new batches get exactly the same
columns (FEA8) instead of re-ranking by their own variance.

Selection (``select_features``): pairwise |corr| > 0.95 dedup from the blocks
of one Gram matrix, then a binned mutual information with the Miller-Madow
correction, >= 0.003 kept.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.session import stored

MI_BINS = 16


def squeezed(column: str) -> str:
    """A column's part of a ratio name: lower case without separators, cut to the name length."""
    return re.sub(r"[ _-]+", "", column.lower())[:C.SHORT_NAME_LEN]


def ratio_plan(ranked: list[str], limit: int = C.MAX_RATIO_PAIRS) -> list[tuple[str, str, str]]:
    """FEA2: (name, numerator, denominator) of the pairs of ``ranked``, higher rank above; of equal names the first stays."""
    pairs: dict[str, tuple[str, str]] = {}
    for pair in combinations(ranked, 2):
        pairs.setdefault("_".join(["feat_ratio", *map(squeezed, pair)]), pair)
    return [(name, *pair) for name, pair in islice(pairs.items(), limit)]


@dataclass
class FeatureModel:
    ratios: list[tuple[str, str, str]] = field(default_factory=list)   # (name, numerator, denominator)
    logs: list[tuple[str, str]] = field(default_factory=list)          # (name, column)
    service_cols: list[str] = field(default_factory=list)              # summed into feat_n_active_services
    keep: list[str] = field(default_factory=list)                      # candidates kept (FEA5 / FEA6-7)

    def expressions(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name, a, b in self.ratios:
            den = F.when(F.col(f"`{b}`") != 0, F.col(f"`{b}`").cast("double"))
            out[name] = F.coalesce(F.col(f"`{a}`").cast("double") / den, F.lit(0.0))
        for name, c in self.logs:
            out[name] = F.log1p(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))
        if self.service_cols:
            out["feat_n_active_services"] = reduce_sum(
                [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.service_cols])
        return out

    def transform(self, df: DataFrame, only_kept: bool = True) -> DataFrame:
        exprs = self.expressions()
        names = [n for n in exprs if (n in self.keep or not only_kept)]
        return df.select("*", *[exprs[n].alias(n) for n in names])

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def reduce_sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def numeric_summary(df: DataFrame, numeric_cols: list[str]) -> DataFrame:
    """FEA1/FEA3 statistics in one aggregate: (column, pos, n, min, variance, std, skewness G1)."""
    aggs = []
    for i, c in enumerate(numeric_cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.var_samp(x).alias(f"v{i}"),
                 F.skewness(x).alias(f"g{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"n{i}").alias("n"),
                              F.col(f"mn{i}").alias("min"), F.col(f"v{i}").alias("variance"),
                              F.col(f"g{i}").alias("g1")) for i, c in enumerate(numeric_cols)])
    x = wide.select(F.explode(rows).alias("r")).select("r.*")
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") > 2) & ~F.isnan("g1"), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    eligible = (F.col("min") >= 0) & (F.sqrt(F.col("variance")) > 0)
    return x.select("column", "pos", "n", "min", "variance", F.sqrt("variance").alias("std"),
                    skew.alias("skewness"), F.coalesce(eligible, F.lit(False)).alias("ratio_eligible"),
                    F.coalesce((F.abs(skew) > C.SKEW_LOG_LIMIT) & (F.col("min") >= 0), F.lit(False))
                    .alias("log_eligible"))


class FeatureEstimator:
    """FEA1-FEA5: decide the candidate features on the training rows."""

    def fit(self, df: DataFrame, numeric_cols: list[str], bool_cols: list[str] | None = None) -> FeatureModel:
        bool_cols = [c for c in (bool_cols or []) if c in df.columns]
        numeric_cols = [c for c in numeric_cols if c in df.columns]
        stats = numeric_summary(df, numeric_cols).collect() if numeric_cols else []   # one row per column
        elig = [r for r in stats if r["ratio_eligible"]]
        elig.sort(key=lambda r: (-r["variance"], r["pos"]))   # variance desc, column order on ties
        top = [r["column"] for r in elig[:C.MAX_RATIO_COLS]]
        model = FeatureModel(ratios=ratio_plan(top))
        made = {name for name, _, _ in model.ratios}
        by_position = sorted((r for r in stats if r["log_eligible"]), key=lambda r: r["pos"])
        model.logs = [(f"feat_{r['column']}_log", r["column"]) for r in by_position if r["column"] not in made]
        if len(bool_cols) >= 2:
            model.service_cols = list(bool_cols)
        model.keep = spread_check(df, model)
        return model


def spread_check(df: DataFrame, model: FeatureModel) -> list[str]:
    """FEA5: keep candidates with at least two distinct values (min < max after filling 0)."""
    exprs = model.expressions()
    if not exprs:
        return []
    row = df.agg(*[(F.min(e) < F.max(e)).alias(f"k{i}") for i, e in enumerate(exprs.values())]).first()
    return [n for i, n in enumerate(exprs) if row[f"k{i}"]]


#: Columns of one block of the Gram matrix, partial sums added up by one task.
GRAM_COLUMNS, GRAM_FAN = 256, 16
_GRAM = "bi int, bj int, part int, data binary"


def _gram_partials(means: np.ndarray):
    """Per partition the products of the centred columns, a row per pair of column blocks."""
    def run(batches):
        d, total = len(means), None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d) - means
            total = x.T @ x if total is None else total + x.T @ x
        if total is None:
            return
        part, blocks = TaskContext.get().partitionId(), range(0, d, GRAM_COLUMNS)
        for i in blocks:
            for j in blocks:
                if i <= j:
                    data = np.ascontiguousarray(total[i:i + GRAM_COLUMNS, j:j + GRAM_COLUMNS]).tobytes()
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (i // GRAM_COLUMNS, j // GRAM_COLUMNS, part)), pa.array([data], pa.binary())],
                                                     names=["bi", "bj", "part", "data"])
    return run


def _gram_added(g: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v) for v in g["data"])
    return g.iloc[:1].assign(part=int(g["part"].iloc[0]) // GRAM_FAN, data=[total.tobytes()])


def gram_blocks(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(bi, bj, part, data): the upper blocks of the Gram matrix of the centred columns, from one pass over the rows.

    What crosses the shuffle is a row per task and pair of column blocks, added up a fan at a time, whatever the number of column pairs."""
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    rows = df.select(F.array(*columns).alias("x"))
    sums = stored(rows.mapInArrow(_gram_partials(np.array([m or 0.0 for m in means], float)), _GRAM), "gram")
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        sums = sums.groupBy("bi", "bj", F.floor(F.col("part") / GRAM_FAN)).applyInPandas(_gram_added, _GRAM)
        parts = -(-parts // GRAM_FAN)
        if parts == 1:
            return stored(sums, "gram")


def correlation_dedup(df: DataFrame, names: list[str]) -> DataFrame:
    """FEA6: (feature, dropped) — of each pair with |r| > 0.95 the lower-variance one is dropped.

    All correlations come from the blocks of one Gram matrix; only the diagonal and each block's losers reach the driver.
    """
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "feature string, dropped boolean")
    blocks = gram_blocks(df, [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    d = len(names)

    def shape(i: int, j: int) -> tuple[int, int]:
        return tuple(min(GRAM_COLUMNS, d - b * GRAM_COLUMNS) for b in (i, j))

    def diagonals(frames):
        for g in frames:
            yield pd.DataFrame([(int(i), np.diag(np.frombuffer(v).reshape(shape(i, i))).tolist()) for i, v in zip(g["bi"], g["data"])], columns=["bi", "v"])

    found = blocks.filter("bi = bj").mapInPandas(diagonals, "bi int, v array<double>").collect()   # one value per column
    v = np.zeros(d)
    for r in found:
        v[r["bi"] * GRAM_COLUMNS:][:len(r["v"])] = r["v"]

    def losers(frames):
        for g in frames:
            out = set()
            for bi, bj, data in zip(g["bi"], g["bj"], g["data"]):
                i0, j0 = bi * GRAM_COLUMNS, bj * GRAM_COLUMNS
                m = np.frombuffer(data).reshape(shape(bi, bj))
                vi, vj = v[i0:i0 + m.shape[0], None], v[None, j0:j0 + m.shape[1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = np.abs(m / np.sqrt(vi * vj)) > C.CORR_DEDUP_LIMIT
                i, j = np.nonzero(near)
                for a, b in zip((i + i0).tolist(), (j + j0).tolist()):
                    if a < b:
                        out.add(b if v[b] < v[a] else a)
            yield pd.DataFrame({"i": sorted(out)}, dtype="int32")

    drop = {r["i"] for r in blocks.mapInPandas(losers, "i int").distinct().collect()}   # at most one row per column
    return spark.createDataFrame([(n, i in drop) for i, n in enumerate(names)], "feature string, dropped boolean")


def binned_mi(df: DataFrame, names: list[str], label: str = "label", bins: int = MI_BINS) -> DataFrame:
    """FEA7 statistic: MI(feature; label) in nats over equal-width bins, Miller-Madow corrected, >= 0.

    One unpivot + two small aggregates; features with no spread get 0.
    """
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "feature string, mi double")
    arr = F.array(*[F.struct(F.lit(n).alias("feature"),
                             F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias("x")) for n in names])
    long = df.select(F.col(label).alias("y"), F.explode(arr).alias("kv")).select("y", "kv.*")
    rng = long.groupBy("feature").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    w = F.col("mx") - F.col("mn")
    b = F.when(w > 0, F.least(F.floor((F.col("x") - F.col("mn")) / w * bins), F.lit(bins - 1))).otherwise(0)
    cells = long.join(F.broadcast(rng), "feature").groupBy("feature", b.cast("int").alias("bin")).agg(
        F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1"))
    tot = cells.groupBy("feature").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"),
                                       F.count(F.lit(1)).alias("nb"))
    j = cells.join(F.broadcast(tot), "feature")
    n = F.col("t0") + F.col("t1")
    bt = F.col("c0") + F.col("c1")

    def term(o, t):
        return F.coalesce(F.when(o > 0, (o / n) * F.log(o * n / (bt * t))), F.lit(0.0))

    mi = j.groupBy("feature").agg(F.sum(term(F.col("c0"), F.col("t0")) + term(F.col("c1"), F.col("t1"))).alias("raw"),
                                  F.first("nb").alias("nb"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    k = (F.col("t0") > 0).cast("int") + (F.col("t1") > 0).cast("int")
    corr = (F.col("nb") - 1) * (k - 1) / (2.0 * (F.col("t0") + F.col("t1")))
    return mi.select("feature", F.greatest(F.lit(0.0), F.col("raw") - corr).alias("mi"))


def select_features(train: DataFrame, names: list[str], label: str = "label",
                    min_mi: float = C.MIN_MI) -> list[str]:
    """FEA6 + FEA7 on the training rows; returns the kept names in candidate order."""
    dd = {r["feature"]: r["dropped"] for r in correlation_dedup(train, names).collect()}
    valid = [n for n in names if not dd.get(n, False)]
    if not valid:
        return []
    mi = {r["feature"]: r["mi"] for r in binned_mi(train, valid, label).collect()}
    return [n for n in valid if mi.get(n, 0.0) >= min_mi]
