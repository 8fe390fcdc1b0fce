"""Sampling, stratified split, folds and set operations (SPL1-4, SET1-2, SIG1).

All randomness is a hash of (salt, key): results do not depend on the
partitioning, the number of executors or retries of lost tasks.

Exact stratified take without a per-class window over all rows
---------------------------------------------------------------
Rows are ordered inside each class by (bucket, md5, key) where bucket is a
16-bit hash. A histogram (class, bucket) has at most 2 x 65,536 rows; its
prefix sums locate, per class, the bucket where the wanted count is reached.
Rows below that bucket are taken, rows above are not, and only the rows of
the one boundary bucket per class are ranked. Both small frames are joined by
broadcast (their size is bounded by the bucket count, not by the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark import config as C

BUCKETS = 65536
DEFAULT_SALT = f"{C.RANDOM_STATE}|"


def row_key(df: DataFrame, key_cols: list[str] | None) -> Column:
    """Key for hashing: the id columns, or the whole row as JSON (CLN7)."""
    if key_cols and len(key_cols) == 1:
        return F.col(f"`{key_cols[0]}`").cast("string")
    cols = key_cols or df.columns
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))


def hash_order(key: Column, salt: str) -> tuple[Column, Column]:
    """(bucket, digest) of md5(salt || key); bucket in [0, BUCKETS)."""
    digest = F.md5(F.concat(F.lit(salt), key))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(BUCKETS)).cast("int")
    return bucket, digest


def _take_per_class(df: DataFrame, label: str, key: Column, salt: str, want: Column,
                    flag: str) -> DataFrame:
    """Add boolean ``flag``: the first ``want`` rows of each class in hash order.

    ``want`` is an expression over the class size ``n_c``.
    """
    b, h = hash_order(key, salt)
    x = df.withColumn("__b", b).withColumn("__h", h).withColumn("__k", key)
    hist = x.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("__cum", F.sum("__cnt").over(w))
    tot = hist.groupBy(label).agg(F.sum("__cnt").alias("n_c"))
    hist = hist.join(F.broadcast(tot), label).withColumn("__want", want.cast("long"))
    before = F.col("__cum") - F.col("__cnt")
    boundary = hist.filter((before < F.col("__want")) & (F.col("__cum") >= F.col("__want"))).select(
        label, F.col("__b").alias("__bnd"), (F.col("__want") - before).alias("__need"))
    marked = x.join(F.broadcast(boundary), label, "left")
    outside = marked.filter(F.col("__bnd").isNull() | (F.col("__b") != F.col("__bnd"))).withColumn(
        flag, F.coalesce(F.col("__b") < F.col("__bnd"), F.lit(False)))
    wr = Window.partitionBy(label).orderBy("__h", "__k")
    inside = marked.filter(F.col("__b") == F.col("__bnd")).withColumn(
        flag, F.row_number().over(wr) <= F.col("__need"))
    return outside.unionByName(inside).drop("__b", "__h", "__k", "__bnd", "__need")


def stratified_split(df: DataFrame, label: str, key_cols: list[str] | None = None,
                     test_size: float = C.TEST_SIZE, salt: str = DEFAULT_SALT,
                     split_col: str = "split") -> DataFrame:
    """SPL1: exact stratified split; per class floor(test_size * n_c + 0.5) rows go to test."""
    key = row_key(df, key_cols)
    want = F.floor(F.col("n_c") * test_size + 0.5)
    out = _take_per_class(df, label, key, salt, want, "__test")
    return out.withColumn(split_col, F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def random_split(df: DataFrame, key_cols: list[str] | None = None, test_size: float = C.TEST_SIZE,
                 salt: str = DEFAULT_SALT, split_col: str = "split") -> DataFrame:
    """SPL1 fallback (one class, or no label): the same rule over one pseudo-class."""
    x = df.withColumn("__one", F.lit(0))
    out = stratified_split(x, "__one", key_cols or df.columns, test_size, salt, split_col)
    return out.drop("__one")


def stratified_take(df: DataFrame, label: str, n_per_class: int, key_cols: list[str] | None = None,
                    salt: str = DEFAULT_SALT) -> DataFrame:
    """SIG1: at most ``n_per_class`` rows of each class, exact, hash-ranked."""
    key = row_key(df, key_cols)
    want = F.least(F.col("n_c"), F.lit(int(n_per_class)))
    out = _take_per_class(df, label, key, salt, want, "__keep")
    return out.filter("__keep").drop("__keep")


def stratified_folds(df: DataFrame, label: str, key_cols: list[str] | None = None, k: int = C.CV_FOLDS,
                     salt: str = DEFAULT_SALT, fold_col: str = "fold") -> DataFrame:
    """SPL2: exact stratified k folds: fold = (rank within class - 1) mod k.

    rank = rows of the class in lower buckets (prefix sum over the small
    histogram, broadcast) + rank inside the bucket (a window partitioned by
    (class, bucket), so each window holds ~1/65,536 of a class).
    """
    key = row_key(df, key_cols)
    b, h = hash_order(key, salt)
    x = df.withColumn("__b", b).withColumn("__h", h).withColumn("__k", key)
    hist = x.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("__off", F.sum("__cnt").over(w) - F.col("__cnt")).drop("__cnt")
    wr = Window.partitionBy(label, "__b").orderBy("__h", "__k")
    ranked = x.join(F.broadcast(hist), [label, "__b"]).withColumn(
        "__rank", F.col("__off") + F.row_number().over(wr))
    return ranked.withColumn(fold_col, ((F.col("__rank") - 1) % k).cast("int")).drop(
        "__b", "__h", "__k", "__off", "__rank")


def hash_sample(df: DataFrame, n: int, key_cols: list[str] | None = None, salt: str = DEFAULT_SALT) -> DataFrame:
    """SPL4: simple random sample of n rows = the n smallest hashes (a top-k, not a sort)."""
    key = row_key(df, key_cols)
    _, h = hash_order(key, salt)
    return df.withColumn("__h", h).withColumn("__k", key).orderBy("__h", "__k").limit(int(n)).drop("__h", "__k")


def union_parts(*dfs: DataFrame) -> DataFrame:
    """SET1: put split parts back together by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def align_columns(df: DataFrame, known: list[str], types: dict | None = None) -> DataFrame:
    """SET2: the known training columns, in order; missing ones as typed nulls, extras dropped."""
    present = set(df.columns)
    cols = []
    for c in known:
        if c in present:
            cols.append(F.col(f"`{c}`"))
        else:
            t = (types or {}).get(c, "string")
            cols.append(F.lit(None).cast(t).alias(c))
    return df.select(*cols)
