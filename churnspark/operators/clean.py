"""Raw cleaning as an Estimator/Model pair (CLN1-CLN8).

``CleanEstimator.fit`` decides, in ONE aggregate over the data, which string
columns are really numbers (CLN2: > 80 % of all rows parse) and which are
boolean words (CLN3). The resulting ``CleanModel`` is a frozen plan: applied
to a new batch it makes the same conversions, instead of re-deciding per
batch (the original re-derives them from every upload).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import config as C
from churnspark.functions.exprs import (bool_map_expr, clean_name, clean_names, lenient_target, norm_str,
                                        numeric_string, strict_target, summary_target)

NUMERIC_SHARE = 0.80


@dataclass
class CleanModel:
    numeric_cols: list[str] = field(default_factory=list)   # strings converted to double
    bool_cols: list[str] = field(default_factory=list)      # strings converted to 0/1

    def transform(self, df: DataFrame) -> DataFrame:
        df = clean_names(df)
        out = []
        for c in df.columns:
            if c in self.numeric_cols:
                out.append(numeric_string(F.col(f"`{c}`")).alias(c))
            elif c in self.bool_cols:
                out.append(bool_map_expr(F.col(f"`{c}`")).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)

    def to_json(self) -> str:
        return json.dumps({"numeric_cols": self.numeric_cols, "bool_cols": self.bool_cols})

    @staticmethod
    def from_json(s: str) -> "CleanModel":
        d = json.loads(s)
        return CleanModel(d["numeric_cols"], d["bool_cols"])


def decision_frame(df: DataFrame) -> DataFrame:
    """CLN2/CLN3 statistics of every string column, one aggregate, one row per column.

    (column, n_rows, n_numeric, numeric_share, to_numeric, n_nonnull, all_bool_words, to_bool)
    """
    df = clean_names(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df.sparkSession.createDataFrame(
            [], "column string, n_rows long, n_numeric long, numeric_share double, to_numeric boolean, "
                "n_nonnull long, all_bool_words boolean, to_bool boolean")
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(strings):
        col = F.col(f"`{c}`")
        aggs += [F.count(numeric_string(col)).alias(f"num{i}"),
                 F.count(col).alias(f"nn{i}"),
                 F.bool_and(norm_str(col).isin(C.BOOL_WORDS)).alias(f"bw{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"), F.col(f"num{i}").alias("n_numeric"),
                 F.col(f"nn{i}").alias("n_nonnull"), F.col(f"bw{i}").alias("bw"))
        for i, c in enumerate(strings)
    ])
    x = wide.select(F.explode(rows).alias("r")).select("r.*")
    share = F.col("n_numeric") / F.greatest(F.col("n_rows"), F.lit(1))
    to_num = share > NUMERIC_SHARE
    return x.select(
        "column", "n_rows", "n_numeric", share.alias("numeric_share"), to_num.alias("to_numeric"),
        "n_nonnull", F.coalesce(F.col("bw"), F.lit(False)).alias("all_bool_words"),
        (~to_num & (F.col("n_nonnull") > 0) & F.coalesce(F.col("bw"), F.lit(False))).alias("to_bool"))


class CleanEstimator:
    """CLN1-3: fit the cleaning plan on a batch."""

    def fit(self, df: DataFrame) -> CleanModel:
        rows = decision_frame(df).collect()   # one row per string column
        return CleanModel(numeric_cols=[r["column"] for r in rows if r["to_numeric"]],
                          bool_cols=[r["column"] for r in rows if r["to_bool"]])


def raw_clean(df: DataFrame) -> DataFrame:
    """Fit and apply in one call (what the original does on every batch)."""
    return CleanEstimator().fit(df).transform(df)


def convert_target(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """CLN4 strict target; raises with the number of unrecognised values (null included)."""
    t = clean_name(target) if target not in df.columns else target
    y = strict_target(F.col(f"`{t}`"), df.schema[t].dataType)
    conv = df.withColumn(out, y)
    bad = conv.agg(F.count_if(F.col(out).isNull()).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"Target column has {bad} unrecognised values. Expected: Yes/No, True/False, 1/0.")
    return conv


def target_frame(df: DataFrame, target: str, mode: str = "strict") -> DataFrame:
    """The three target binarisations of the original as one function (CLN4/5/6)."""
    dt = df.schema[target].dataType
    c = F.col(f"`{target}`")
    if mode == "strict":
        return df.withColumn("y", strict_target(c, dt))
    if mode == "lenient":
        return df.withColumn("y", lenient_target(c, dt)).filter(F.col("y").isNotNull())
    if mode == "summary":
        return df.withColumn("y", summary_target(c))
    raise ValueError(mode)


def churn_summary(df: DataFrame, target: str) -> DataFrame:
    """CLN6: churn count and share with the summary word set."""
    y = summary_target(F.col(f"`{target}`"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(y).cast("long").alias("n_churn")).select(
        "n_rows", "n_churn",
        F.when(F.col("n_rows") > 0, F.col("n_churn") / F.col("n_rows")).otherwise(F.lit(0.0)).alias("pct_churn"))


#: Equal rows that one task writes out in a row.
ROW_CHUNK = 10_000


def with_row_id(df: DataFrame, id_col: str | None, out: str = "row_id") -> DataFrame:
    """CLN7: keep the id column, or derive a reproducible id: the md5 of the row and a running number among equal rows.

    Equal rows are interchangeable, so any numbering of them gives the same table: they are counted (partial aggregation,
    one row per split crosses the shuffle) and written out again in chunks dealt over the tasks. On a stream (no ranking)
    equal rows share their hash."""
    if id_col and id_col in df.columns:
        return df.withColumn(out, F.col(f"`{id_col}`"))
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    if df.isStreaming:
        return df.withColumn(out, digest)
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = df.withColumn("__digest", digest).groupBy("__digest", *cols).agg(F.count(F.lit(1)).alias("__n"))
    # rows that differ only in what their JSON leaves out (microseconds) share a digest: they are numbered on
    run = Window.partitionBy("__digest").orderBy(*[c.cast("string") for c in cols])
    counted = counted.withColumn("__skip", F.sum("__n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
    begin = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(ROW_CHUNK).cast("long")))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a given number is not coalesced by the few bytes of the counts
    chunks = counted.withColumn("__from", begin).repartition(tasks, "__digest", "__from")
    number = F.explode(F.sequence("__from", F.least("__n", F.col("__from") + ROW_CHUNK - 1)))
    numbered = chunks.withColumn("__number", number)
    return numbered.select(*cols, F.concat_ws("-", "__digest", F.col("__skip") + F.col("__number")).alias(out))


def prune(df: DataFrame, drop: list[str]) -> DataFrame:
    """CLN8: drop id, target and profiled columns."""
    return df.drop(*[c for c in drop if c in df.columns])
