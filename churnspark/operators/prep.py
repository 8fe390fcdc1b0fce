"""Preprocessing fitted on training rows only (PRE1-PRE7).

numeric + boolean -> median imputation (+ standard scaling with the
population std, for logistic regression); categorical -> most-frequent
imputation -> one-hot with rare categories (< 1 %) collapsed into one
"infrequent" indicator and at most 30 output columns; unseen -> all zeros.

``PrepEstimator.fit`` runs two aggregates over the training rows (medians and
moments; category counts per column); the resulting ``PrepModel`` is a list
of column expressions followed by a ``VectorAssembler``, so transform is a
narrow projection (no shuffle) and the keep-lists travel inside the plan as
literals (their size is bounded by 30 per column).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark import config as C
from churnspark.operators.split import hash_order
from churnspark.session import stored

INFREQUENT = "infrequent_sklearn"


@dataclass
class PrepModel:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)        # column -> frequent categories (sorted)
    has_infrequent: dict = field(default_factory=dict)    # column -> bool
    scale: bool = False
    target_encode: bool = False                           # categorical -> smoothed class-1 rate
    encodings: dict = field(default_factory=dict)         # column -> {value: rate}
    prior: float = 0.0

    def output_names(self) -> list[str]:
        """EXP1: names of the assembled vector slots, in order."""
        names = [f"num__{c}" for c in self.numeric]
        if self.target_encode:
            return names + [f"te__{c}" for c in self.categorical]
        for c in self.categorical:
            names += [f"cat__{c}_{v}" for v in self.categories[c]]
            if self.has_infrequent[c]:
                names.append(f"cat__{c}_{INFREQUENT}")
        return names

    def columns(self) -> list[Column]:
        out = []
        for c in self.numeric:
            x = F.coalesce(number(c), F.lit(float(self.medians[c] or 0.0)))
            if self.scale:
                sd = self.stds.get(c) or 0.0
                x = (x - F.lit(float(self.means[c] or 0.0))) / F.lit(float(sd if sd > 0 else 1.0))
            out.append(x.alias(f"num__{c}"))
        if self.target_encode:
            for c in self.categorical:
                v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c]))
                enc = self.encodings.get(c, {})
                m = F.create_map(*[x for k, r in sorted(enc.items()) for x in (F.lit(k), F.lit(float(r)))]) \
                    if enc else None
                val = F.coalesce(F.element_at(m, v), F.lit(float(self.prior))) if m is not None \
                    else F.lit(float(self.prior))
                out.append(val.alias(f"te__{c}"))
            return out
        for c in self.categorical:
            v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c]))
            cats = self.categories[c]
            for cat in cats:
                out.append((v == F.lit(cat)).cast("double").alias(f"cat__{c}_{cat}"))
            if self.has_infrequent[c]:
                # seen at fit time but rare -> infrequent; never seen -> all zeros
                rare = self.rare_values(c)
                out.append(v.isin(rare).cast("double").alias(f"cat__{c}_{INFREQUENT}"))
        return out

    def rare_values(self, c: str) -> list[str]:
        return self.__dict__.setdefault("_rare", {}).get(c, [])

    def transform(self, df: DataFrame, out: str = "features", keep: list[str] | None = None) -> DataFrame:
        cols = self.columns()
        names = self.output_names()
        base = df.select(*(keep or []), *cols)
        return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(base).select(
            *(keep or []), out)

    def to_json(self) -> str:
        d = dict(self.__dict__)
        return json.dumps(d, default=str)


#: Half width, in ranks, of the bracket around the median; twice the error bound of the probe below.
MEDIAN_BRACKET, MEDIAN_ACCURACY = 2e-5, 100_000


def number(c: str) -> Column:
    """A numeric column as double, NaN as null."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact median per column, by one algorithm at every size.

    Approximate quantiles a little below and above the middle bracket each median (their error bound is half the
    bracket's); values below the bracket are only counted, those inside it (about 0.004 % of the rows, and ties) are
    grouped to distinct values and ranked. Two rows per column reach the driver.
    """
    xs = [number(c) for c in cols]
    probe = df.agg(*[F.percentile_approx(x, [0.5 - MEDIAN_BRACKET, 0.5 + MEDIAN_BRACKET], MEDIAN_ACCURACY).alias(f"q{i}")
                     for i, x in enumerate(xs)], *[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)]).first()
    known = [i for i in range(len(cols)) if probe[f"n{i}"]]
    if not known:
        return dict.fromkeys(cols)
    below = df.agg(*[F.count_if(xs[i] < probe[f"q{i}"][0]).alias(f"b{i}") for i in known]).first()
    inside = F.array(*[F.struct(F.lit(i).alias("i"), F.when(xs[i].between(*probe[f"q{i}"]), xs[i]).alias("x")) for i in known])
    freq = df.select(F.explode(inside).alias("v")).select("v.*").filter("x is not null").groupBy("i", "x").agg(
        F.count(F.lit(1)).alias("n"))
    ranks = F.array(*[F.array(F.lit((probe[f"n{i}"] - 1) // 2 - below[f"b{i}"]), F.lit(probe[f"n{i}"] // 2 - below[f"b{i}"]))
                      if i in known else F.array(F.lit(-1), F.lit(-1)) for i in range(len(cols))])
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("x"))
    at = freq.withColumn("upto", upto).withColumn("r", F.get(ranks, F.col("i")))
    hit = F.filter("r", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    rows = at.select("i", "x", F.size(hit).alias("k")).filter("k > 0").collect()   # at most two per column
    return {c: (sum(r["x"] * r["k"] for r in rows if r["i"] == i) / 2 if i in known else None) for i, c in enumerate(cols)}


class PrepEstimator:
    def __init__(self, numeric: list[str], categorical: list[str], scale: bool = False,
                 target_encode: bool = False,
                 label: str = "label", smoothing: float = 1.0):
        self.numeric = list(numeric)
        self.categorical = list(categorical)
        self.scale = scale
        self.target_encode = target_encode
        self.label = label
        self.smoothing = smoothing

    def fit(self, df: DataFrame) -> PrepModel:
        m = PrepModel(numeric=self.numeric, categorical=self.categorical, scale=self.scale,
                      target_encode=self.target_encode)
        if self.numeric:
            m.medians = exact_medians(df, self.numeric)
            if self.scale:
                # moments of the imputed values (imputation happens before scaling)
                imp = [F.coalesce(number(c), F.lit(float(m.medians[c] or 0.0)))
                       for c in self.numeric]
                row = df.agg(*[F.avg(x).alias(f"mu{i}") for i, x in enumerate(imp)],
                             *[F.stddev_pop(x).alias(f"sd{i}") for i, x in enumerate(imp)]).first()
                m.means = {c: row[f"mu{i}"] for i, c in enumerate(self.numeric)}
                m.stds = {c: row[f"sd{i}"] for i, c in enumerate(self.numeric)}
        if self.categorical:
            plan = category_plan(df, self.categorical).collect()   # one row per category (<= 50 per profiled column)
            for c in self.categorical:
                rows = [r for r in plan if r["column"] == c]
                m.modes[c] = next((r["value"] for r in rows if r["is_mode"]), None)
                m.categories[c] = sorted(r["value"] for r in rows if r["kept"])
                rare = sorted(r["value"] for r in rows if not r["kept"])
                m.has_infrequent[c] = bool(rare)
                m.__dict__.setdefault("_rare", {})[c] = rare
            if self.target_encode:
                _fit_target_encoding(m, df, self.categorical, self.label, self.smoothing)
        return m


def _fit_target_encoding(m: PrepModel, df: DataFrame, cols: list[str], label: str, smoothing: float) -> None:
    """TRN5 preset: each category (after mode imputation) -> (sum y + prior * s) / (n + s); unseen -> prior.

    One unpivoted aggregate; one row per (column, category) reaches the driver (bounded, see category_plan).
    """
    y = F.col(label).cast("double")
    prior = df.agg(F.avg(y).alias("p")).first()["p"] or 0.0
    arr = F.array(*[F.struct(F.lit(c).alias("column"),
                             F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(m.modes[c])).alias("value"))
                    for c in cols])
    rows = df.select(y.alias("__y"), F.explode(arr).alias("kv")).groupBy("kv.column", "kv.value").agg(
        F.sum("__y").alias("s"), F.count(F.lit(1)).alias("n")).collect()   # one row per category
    m.prior = float(prior)
    m.encodings = {c: {} for c in cols}
    for r in rows:
        if r["value"] is not None:
            m.encodings[r["column"]][r["value"]] = (r["s"] + prior * smoothing) / (r["n"] + smoothing)


def ordered_target_stats(df: DataFrame, cols: list[str], modes: dict, prior: float, label: str, key: str, smoothing: float = 1.0,
                         salt: str = f"{C.RANDOM_STATE}|order|", out: str = "te__") -> DataFrame:
    """TRN5: per row and categorical column the smoothed class rate of the rows of its category that come before it in a hashed
    permutation, so that no row's own label goes into its value.

    Prefix sums in two levels: (column, category, hash bucket) totals, at most ``BUCKETS`` rows per category, and ranks inside a bucket; a
    category with a third of all rows is spread over its buckets. Rows whose key repeats follow each other in any fixed order. Both joins merge:
    all rows, or a total per category and bucket, may lie in files so small that the planner would send them through the driver."""
    bucket, digest = hash_order(F.col(f"`{key}`").cast("string"), salt)
    rows = stored(df.withColumn("__rid", F.monotonically_increasing_id()), "ordered-rows")   # joined back below by this number
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(modes[c])).alias("v")) for i, c in enumerate(cols)])
    long = rows.select("__rid", bucket.alias("b"), digest.alias("h"), F.col(label).cast("double").alias("y"), F.explode(values).alias("s")).select(
        "__rid", "b", "h", "y", F.col("s.i").alias("i"), F.coalesce("s.v", F.lit("")).alias("v"))
    totals = long.groupBy("i", "v", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    upto = Window.partitionBy("i", "v").orderBy("b")
    totals = totals.select("i", "v", "b", (F.sum("n").over(upto) - F.col("n")).alias("n_before"), (F.sum("s").over(upto) - F.col("s")).alias("s_before"))
    inside = Window.partitionBy("i", "v", "b").orderBy("h", "__rid")
    x = long.join(totals.hint("merge"), ["i", "v", "b"])
    before = (F.col("s_before") + F.sum("y").over(inside) - F.col("y") + F.lit(prior * smoothing)) / (
        F.col("n_before") + F.row_number().over(inside) - 1 + F.lit(smoothing))
    found = x.select("__rid", "i", before.alias("te")).groupBy("__rid").agg(F.map_from_entries(F.collect_list(F.struct("i", "te"))).alias("__te"))
    return rows.join(found.hint("merge"), "__rid").select(*df.columns, *[F.element_at("__te", F.lit(i)).alias(f"{out}{c}") for i, c in enumerate(cols)])


def category_plan(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRE3/PRE4 keep-list: per column the mode, and which categories get their own indicator.

    Counts are taken after most-frequent imputation (nulls become the mode),
    categories below 1 % are infrequent, and at most 30 output columns remain
    (29 + infrequent when some category is infrequent). One row per distinct
    category reaches the driver: categorical inputs are the profiler's kept
    columns, which have at most 50 distinct values (higher cardinality is
    dropped as "High cardinality"), so the plan is bounded.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(arr).alias("kv")).select("kv.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    nonnull = counts.filter(F.col("value").isNotNull())
    wm = Window.partitionBy("column").orderBy(F.col("cnt").desc(), F.col("value").asc())
    mode = nonnull.withColumn("rk", F.row_number().over(wm)).filter("rk = 1").select(
        "column", F.col("value").alias("mode"))
    nulls = counts.filter(F.col("value").isNull()).select("column", F.col("cnt").alias("n_null"))
    tot = counts.groupBy("column").agg(F.sum("cnt").alias("n"))
    adj = (nonnull.join(F.broadcast(mode), "column").join(F.broadcast(nulls), "column", "left")
           .withColumn("cnt", F.col("cnt") + F.when(F.col("value") == F.col("mode"),
                                                       F.coalesce(F.col("n_null"), F.lit(0))).otherwise(0))
           .join(F.broadcast(tot), "column"))
    frequent = F.col("cnt") >= F.col("n") * C.OHE_MIN_FREQUENCY
    w = Window.partitionBy("column").orderBy(F.col("cnt").desc(), F.col("value").asc())
    ranked = adj.withColumn("is_frequent", frequent).withColumn("rk", F.row_number().over(w))
    per = ranked.groupBy("column").agg(F.count_if("is_frequent").alias("n_freq"),
                                       F.count(F.lit(1)).alias("n_cats"))
    r = ranked.join(F.broadcast(per), "column")
    any_rare = F.col("n_freq") < F.col("n_cats")
    limit = F.when(any_rare | (F.col("n_freq") > C.OHE_MAX_CATEGORIES), C.OHE_MAX_CATEGORIES - 1).otherwise(
        C.OHE_MAX_CATEGORIES)
    kept = F.col("is_frequent") & (F.col("rk") <= limit)
    out = r.select("column", "value", "cnt", kept.alias("kept"), (F.col("value") == F.col("mode")).alias("is_mode"),
                   "rk")
    return out.drop("rk")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """PRE6/PRE7 from one 2-row aggregate: balanced weights n/(2 n_c) and the positive weight round(neg/pos, 2)."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(1))
    n = F.sum("n_c").over(w)
    pos = F.sum(F.when(F.col("label") == 1, F.col("n_c"))).over(w)
    neg = F.sum(F.when(F.col("label") == 0, F.col("n_c"))).over(w)
    return c.select("label", "n_c", (n / (2.0 * F.col("n_c"))).alias("balanced_weight"),
                    F.when(pos > 0, F.round(neg / pos, 2)).otherwise(F.lit(1.0)).alias("scale_pos_weight"))


def with_weights(df: DataFrame, mode: str | None, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach a weight column: 'balanced' (PRE6), 'pos' (PRE7) or 1.0."""
    if mode is None:
        return df.withColumn(out, F.lit(1.0))
    cw = F.broadcast(class_weights(df, label))   # two rows
    j = df.join(cw.withColumnRenamed("label", "__l"), F.col(label) == F.col("__l"))
    if mode == "balanced":
        w = F.col("balanced_weight")
    else:
        w = F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))
    return j.withColumn(out, w.cast("double")).drop("__l", "n_c", "balanced_weight", "scale_pos_weight")
