"""EVL15: isotonic calibration by a distributed pool-adjacent-violators.

Rows are range-partitioned by score; every partition pools its own rows into monotone blocks (score range, positives, rows). Pooling is
associative over neighbouring ranges, so the blocks of a fan of neighbouring partitions are pooled again until one list is left; rows
never meet in one task. With 0/1 labels the block means are different fractions, so n rows leave at most some n^(2/3) blocks.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_ROWS, FAN = 500_000, 16
BLOCKS = "part int, lo double, hi double, y double, n double"


def pooled(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Monotone blocks of blocks in score order (``y``: sum of labels, ``n``: rows)."""
    out: list[list[float]] = []
    for a, b, s, k in zip(lo.tolist(), hi.tolist(), y.tolist(), n.tolist()):
        while out and out[-1][2] * k >= s * out[-1][3]:   # mean of the block before >= mean of this one
            top = out.pop()
            a, s, k = top[0], s + top[2], k + top[3]
        out.append([a, b, s, k])
    return tuple(np.array(out, float).reshape(-1, 4).T)


def _pool_rows(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        part, p, y = (t.column(i).to_numpy() for i in range(3))
        x, back = np.unique(p, return_inverse=True)
        blocks = pooled(x, x, np.bincount(back, y), np.bincount(back))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(dict(zip(("part", "lo", "hi", "y", "n"), (np.full(len(blocks[0]), part[0], np.int32), *blocks)))),
                                         preserve_index=False)


def _pool_blocks(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("lo")
    blocks = pooled(*(g[c].to_numpy() for c in ("lo", "hi", "y", "n")))
    return pd.DataFrame(dict(zip(("part", "lo", "hi", "y", "n"), (np.full(len(blocks[0]), int(g["part"].iloc[0]) // FAN, np.int32), *blocks))))


class IsotonicModel:
    """Monotone steps with straight lines between them, constant beyond the ends."""

    def __init__(self, x: list[float], y: list[float]):
        self.x, self.y = x, y

    def apply(self, df: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
        x, y = np.array(self.x), np.array(self.y)

        def step(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(float), x, y), dtype="float64")
        return df.withColumn(out, F.pandas_udf(step, "double")(F.col(p)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps([self.x, self.y]),)], "steps string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsotonicModel:
        return cls(*json.loads(spark.read.json(path).first()["steps"]))


def fit_isotonic(cal: DataFrame, p: str = "p", label: str = "label", range_rows: int = RANGE_ROWS) -> IsotonicModel:
    rows = cal.select(F.col(p).cast("double").alias("p"), F.col(label).cast("double").alias("y")).filter("p is not null and y is not null")
    parts = -(-rows.count() // range_rows)
    if not parts:
        raise ValueError("no rows to calibrate on")
    spread = rows.repartitionByRange(parts, "p").select(F.spark_partition_id().alias("part"), "p", "y")
    blocks = spread.mapInArrow(_pool_rows, BLOCKS)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_pool_blocks, BLOCKS)
        parts = -(-parts // FAN)
    found = blocks.orderBy("lo").collect()   # the blocks of the result
    x, y = [], []
    for b in found:
        for at in (b["lo"], b["hi"]) if b["hi"] > b["lo"] else (b["lo"],):
            x.append(at)
            y.append(b["y"] / b["n"])
    return IsotonicModel(x, y)
