"""Predictive-signal assessment (SIG1-SIG18).

How strongly does each column separate churners from the others, before any
model is fitted? Numeric columns get Cohen's d, |point-biserial r| and a binned
mutual information; categorical columns (and numeric ones with at most two
distinct values) get bias-corrected Cramer's V, the chi-square test and an
information gain. Scores, tiers, sentences and one summary row follow.

Physical plan
-------------
* the input is projected to the feature columns and the class and persisted
  (MEMORY_AND_DISK; ``SignalReport.release()`` frees it): the passes below
  read it instead of re-deriving it.
* numeric moments: one unpivot to (feature, y, x) and ``groupBy(feature)``
  with conditional aggregates; partial aggregation makes the shuffle one row
  per feature per input split, whatever the number of rows or distinct values
  (shipping every distinct value of a continuous column, as a value-frequency
  table would, costs a shuffle as large as the data).
* numeric bins: the same unpivot joined to the per-feature min/max (one row
  per column, broadcast: bounded by the column count), ``groupBy(feature, bin)``;
  the same pass counts values strictly between min and max (binary test).
* categorical: unpivot to (feature, value, y), ``groupBy(feature, value)``
  with both class counts as columns (so empty cells need no cross join). The
  top-30 cap of high-cardinality columns is ``row_number() <= k`` over the
  feature, which Spark runs as a partial group limit before the shuffle, so no
  task holds more than k rows per feature per input split.
* everything after that is one row per feature; the summary sorts features
  (a window over #columns rows, not over data rows).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import config as C
from churnspark.functions.exprs import clean_name, clean_names, fill, lenient_target
from churnspark.functions.chi2 import chi2_isf
from churnspark.functions.stats import chi2_pvalue
from churnspark.operators.split import stratified_take

MI_BINS = 16
EPS = 1e-9
MAX_DOF = C.SIGNAL_MAX_CATS - 1          # two classes: dof = categories - 1 <= 49


def _critical(alpha: float) -> Column:
    """chi-square critical values for dof 1..49 as a literal map (computed once on the driver)."""
    pairs = []
    for dof in range(1, MAX_DOF + 1):
        pairs += [F.lit(dof), F.lit(chi2_isf(alpha, dof))]
    return F.create_map(*pairs)


Y = "__y"

FEATURE_SCHEMA = (
    "feature string, pos int, type string, n_valid long, n_categories int, signal double, "
    "tier string, mean_diff double, d double, r double, mi double, cramers_v double, "
    "chi2 double, dof int, p_value double, ig double, explanation string"
)


@dataclass
class SignalReport:
    features: DataFrame      # one row per assessed feature
    summary: DataFrame       # one row
    routing: DataFrame       # one row per candidate column: counts and the path taken
    contingency: DataFrame   # (feature, value, n_neg, n_pos) after the cardinality cap
    numeric_bins: DataFrame  # (feature, bin, n_neg, n_pos)
    cached: tuple = ()       # frames persisted for the passes; see release()

    def release(self) -> None:
        """Unpersist the input projection and the per-column statistics."""
        for d in self.cached:
            d.unpersist()


def _unpivot(df: DataFrame, cols: list[str], value: Column | None = None, cast: str = "double",
             positions: dict[str, int] | None = None) -> DataFrame:
    """(y, feature, pos, x) rows for the given columns; nulls/NaN removed."""
    positions = positions or {c: i for i, c in enumerate(cols)}
    arr = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(positions[c]).alias("pos"),
                 F.col(f"`{c}`").cast(cast).alias("x"))
        for c in cols
    ])
    out = df.select(Y, F.explode(arr).alias("kv")).select(Y, "kv.feature", "kv.pos", "kv.x")
    keep = F.col("x").isNotNull()
    if cast == "double":
        keep = keep & ~F.isnan("x")
    return out.filter(keep)


def _round6(c: Column) -> Column:
    return F.round(c, 6)


def _tier(signal: Column) -> Column:
    return (F.when(signal >= C.SIGNAL_STRONG, "Strong")
            .when(signal >= C.SIGNAL_MEDIUM, "Medium").otherwise("Weak"))


def _explanation(feature: Column, tier: Column, ftype: Column, mean_diff: Column, n_cats: Column) -> Column:
    label = F.initcap(F.trim(F.regexp_replace(feature, "_", " ")))
    low = F.lower(label)
    up = mean_diff > 0
    num = ftype == "Numerical"
    return (
        F.when(tier == "Weak", fill(C.SIG_WEAK, label=label))
        .when(num & (tier == "Strong") & up, fill(C.SIG_NUM_STRONG_UP, low=low))
        .when(num & (tier == "Strong"), fill(C.SIG_NUM_STRONG_DOWN, low=low))
        .when(num & up, fill(C.SIG_NUM_MEDIUM_UP, low=low))
        .when(num, fill(C.SIG_NUM_MEDIUM_DOWN, low=low))
        .when((tier == "Strong") & (n_cats == 2), fill(C.SIG_CAT_STRONG_TWO, low=low))
        .when(tier == "Strong", fill(C.SIG_CAT_STRONG, low=low))
        .when(n_cats == 2, fill(C.SIG_CAT_MEDIUM_TWO, low=low))
        .otherwise(fill(C.SIG_CAT_MEDIUM, low=low))
    )


def _numeric_stats(base: DataFrame, numeric: list[str], positions: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Per numeric feature: class moments, d, r, binned MI, and the mid-value count."""
    spark = base.sparkSession
    if not numeric:
        empty = spark.createDataFrame([], "feature string, pos int")
        return empty, spark.createDataFrame([], "feature string, bin int, n_neg long, n_pos long")
    long = _unpivot(base, numeric, positions=positions)
    y1 = F.col(Y) == 1
    mom = long.groupBy("feature", "pos").agg(
        F.count("x").alias("n_valid"),
        F.count_if(~y1).alias("n0"),
        F.count_if(y1).alias("n1"),
        F.avg(F.when(~y1, F.col("x"))).alias("m0"),
        F.avg(F.when(y1, F.col("x"))).alias("m1"),
        F.var_samp(F.when(~y1, F.col("x"))).alias("v0"),
        F.var_samp(F.when(y1, F.col("x"))).alias("v1"),
        F.corr(F.col("x"), F.col(Y).cast("double")).alias("corr"),
        F.min("x").alias("mn"),
        F.max("x").alias("mx"),
    )
    # min/max per feature is one row per column: a bounded broadcast
    rng = F.broadcast(mom.select("feature", "mn", "mx"))
    width = F.col("mx") - F.col("mn")
    binned = long.join(rng, "feature").select(
        "feature", Y,
        F.when(width > 0, F.least(F.floor((F.col("x") - F.col("mn")) / width * MI_BINS), F.lit(MI_BINS - 1)))
         .otherwise(F.lit(0)).cast("int").alias("bin"),
        ((F.col("x") > F.col("mn")) & (F.col("x") < F.col("mx"))).cast("int").alias("mid"),
    )
    bins = binned.groupBy("feature", "bin").agg(
        F.count_if(F.col(Y) == 0).alias("n_neg"),
        F.count_if(F.col(Y) == 1).alias("n_pos"),
        F.sum("mid").alias("n_mid"),
    )
    per = bins.groupBy("feature").agg(
        F.sum("n_neg").alias("t0"), F.sum("n_pos").alias("t1"), F.sum("n_mid").alias("n_mid"),
        F.count_if((F.col("n_neg") + F.col("n_pos")) > 0).alias("b_nonempty"),
    )
    cells = bins.join(F.broadcast(per.select("feature", "t0", "t1")), "feature")
    n = F.col("t0") + F.col("t1")
    bt = F.col("n_neg") + F.col("n_pos")

    def term(o: Column, tot: Column) -> Column:
        return F.when(o > 0, (o / n) * F.log(o * n / (bt * tot)))

    mi_raw = cells.groupBy("feature").agg(
        F.coalesce(F.sum(term(F.col("n_neg"), F.col("t0"))), F.lit(0.0)).alias("mi0"),
        F.coalesce(F.sum(term(F.col("n_pos"), F.col("t1"))), F.lit(0.0)).alias("mi1"),
    )
    stats = mom.join(per, "feature").join(mi_raw, "feature")
    k = (F.col("t0") > 0).cast("int") + (F.col("t1") > 0).cast("int")
    # Miller-Madow: the plug-in MI is biased up by (B-1)(K-1)/(2N); remove it and clip at 0
    mi = F.greatest(F.lit(0.0), F.col("mi0") + F.col("mi1")
                    - (F.col("b_nonempty") - 1) * (k - 1) / (2.0 * F.col("n_valid")))
    pooled = (((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"))
              / (F.col("n1") + F.col("n0") - 2))
    d = (F.when((F.col("n1") < 2) | (F.col("n0") < 2), F.lit(0.0))
         .when(pooled <= 0, F.lit(0.0))
         .otherwise(F.abs(F.col("m1") - F.col("m0")) / F.sqrt(pooled)))
    r = F.coalesce(F.abs(F.col("corr")), F.lit(0.0))
    r = F.when(F.isnan(r), F.lit(0.0)).otherwise(r)
    stats = stats.select(
        "feature", "pos", "n_valid", "n0", "n1", "n_mid",
        d.alias("d"), r.alias("r"), mi.alias("mi"),
        (F.col("m1") - F.col("m0")).alias("mean_diff"),
    )
    return stats, bins.select("feature", "bin", "n_neg", "n_pos")


def _categorical_stats(base: DataFrame, cats: list[str], positions: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    spark = base.sparkSession
    if not cats:
        return (spark.createDataFrame([], "feature string, pos int"),
                spark.createDataFrame([], "feature string, value string, n_neg long, n_pos long"))
    long = _unpivot(base, cats, cast="string", positions=positions)
    vf = long.groupBy("feature", "pos", F.col("x").alias("value")).agg(
        F.count_if(F.col(Y) == 0).alias("n_neg"),
        F.count_if(F.col(Y) == 1).alias("n_pos"),
    ).withColumn("cnt", F.col("n_neg") + F.col("n_pos"))
    per = vf.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"),
                                    F.sum("cnt").alias("n_all"))
    # top values per feature: a group limit (partial before the shuffle)
    w = Window.partitionBy("feature").orderBy(F.col("cnt").desc(), F.col("value").asc())
    ranked = vf.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= C.SIGNAL_MAX_CATS)
    capped = (ranked.join(F.broadcast(per), "feature")
              .filter((F.col("n_distinct") <= C.SIGNAL_MAX_CATS) | (F.col("rn") <= C.SIGNAL_TOP_CATS)))
    tot = capped.groupBy("feature", "pos").agg(
        F.sum("n_neg").alias("t0"), F.sum("n_pos").alias("t1"), F.count(F.lit(1)).alias("n_rows"),
        F.first("n_distinct").alias("n_distinct"), F.first("n_all").alias("n_all"),
    )
    n = F.col("t0") + F.col("t1")
    k = (F.col("t0") > 0).cast("int") + (F.col("t1") > 0).cast("int")
    dof = (F.col("n_rows") - 1) * (k - 1)
    cells = capped.select("feature", "value", "n_neg", "n_pos", "cnt").join(
        F.broadcast(tot.select("feature", "t0", "t1", n.alias("n"), dof.alias("dof"))), "feature")

    def chi_term(o: Column, t: Column) -> Column:
        e = F.col("cnt") * t / F.col("n")
        diff = F.abs(o - e)
        adj = F.when(F.col("dof") == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
        return F.when(t > 0, adj * adj / e)

    def mi_term(o: Column, t: Column) -> Column:
        return F.when(o > 0, (o / F.col("n")) * F.log(o * F.col("n") / (F.col("cnt") * t)))

    agg = cells.groupBy("feature").agg(
        F.sum(F.coalesce(chi_term(F.col("n_neg"), F.col("t0")), F.lit(0.0))
              + F.coalesce(chi_term(F.col("n_pos"), F.col("t1")), F.lit(0.0))).alias("chi2_raw"),
        F.sum(F.coalesce(mi_term(F.col("n_neg"), F.col("t0")), F.lit(0.0))
              + F.coalesce(mi_term(F.col("n_pos"), F.col("t1")), F.lit(0.0))).alias("mi_nats"),
    )
    st = tot.join(agg, "feature").select(
        "feature", "pos", "n_distinct", "n_all", "n_rows", "t0", "t1",
        n.alias("n"), k.alias("k"), dof.cast("int").alias("dof"),
        F.when(dof > 0, F.col("chi2_raw")).otherwise(F.lit(0.0)).alias("chi2"),
        F.col("mi_nats"),
    )
    nn = F.col("n").cast("double")
    rr = F.col("n_rows").cast("double")
    kk = F.col("k").cast("double")
    phi2c = F.greatest(F.lit(0.0), F.col("chi2") / nn - (kk - 1) * (rr - 1) / (nn - 1))
    rc = rr - (rr - 1) * (rr - 1) / (nn - 1)
    kc = kk - (kk - 1) * (kk - 1) / (nn - 1)
    denom = F.least(kc - 1, rc - 1)
    v = F.when(denom > 0, F.sqrt(phi2c / denom)).otherwise(F.lit(0.0))
    p1 = F.col("t1") / nn
    h = -p1 * F.log2(p1 + EPS) - (1 - p1) * F.log2(1 - p1 + EPS)
    ig = F.col("mi_nats") / (h + EPS)
    st = st.select("*", v.alias("cramers_v"), ig.alias("ig"))
    contingency = capped.select("feature", "value", "n_neg", "n_pos")
    return st, contingency


def assess_signal(df: DataFrame, target: str, id_col: str | None = None,
                  max_rows: int | None = None) -> SignalReport:
    """SIG1-SIG18 on a raw customer frame.

    ``max_rows``: when set, a sample of at most max_rows // 2 rows per class,
    whatever the size (exact, hash-ranked; SIG1). Default: every row.
    """
    spark = df.sparkSession
    df = clean_names(df)
    t = clean_name(target)
    i = clean_name(id_col) if id_col else None
    if t not in df.columns:
        return _error_report(spark, C.SIG_ERR_NO_TARGET)
    feats0 = [c for c in df.columns if c not in (t, i)]
    labeled = df.withColumn(Y, lenient_target(F.col(f"`{t}`"), df.schema[t].dataType)).filter(F.col(Y).isNotNull())
    if max_rows is not None:  # hash-ranked on the id (or the whole row)
        labeled = stratified_take(labeled, Y, max_rows // 2, key_cols=[i] if i else None)
    # several passes read the frame: keep only the feature columns and the class, once
    base = labeled.select(*[F.col(f"`{c}`") for c in feats0], Y).persist(StorageLevel.MEMORY_AND_DISK)
    class_counts = {r[Y]: r["count"] for r in base.groupBy(Y).count().collect()}
    if len(class_counts) < 2:
        base.unpersist()
        return _error_report(spark, C.SIG_ERR_ONE_CLASS)

    feats = [c for c in df.columns if c not in (t, i)]
    positions = {c: p for p, c in enumerate(feats)}
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in feats if isinstance(types[c], (T.NumericType, T.BooleanType))]
    strings = [c for c in feats if c not in numeric
               and not isinstance(types[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]

    num_stats, bins = _numeric_stats(base, numeric, positions)
    # one row per numeric column: cached, because routing reads it on the driver and the plan reuses it
    num_stats = num_stats.cache() if numeric else num_stats
    route_rows = num_stats.select("feature", "n_valid", "n0", "n1", "n_mid").collect() if numeric else []
    binary_numeric = [r["feature"] for r in route_rows if r["n_valid"] >= C.SIGNAL_MIN_VALID and r["n_mid"] == 0]
    cats = strings + [c for c in numeric if c in set(binary_numeric)]
    cats.sort(key=lambda c: positions[c])
    cat_stats, contingency = _categorical_stats(base, cats, positions)

    num_ok = ((F.col("n_valid") >= C.SIGNAL_MIN_VALID) & (F.col("n_mid") > 0)
              & (F.col("n0") >= C.SIGNAL_MIN_CLASS) & (F.col("n1") >= C.SIGNAL_MIN_CLASS))
    num_sig = F.least(F.greatest(
        0.40 * F.least(F.col("d") / 2.0, F.lit(1.0)) + 0.35 * F.least(F.col("r"), F.lit(1.0))
        + 0.25 * F.least(F.col("mi"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    num_rows = num_stats.filter(num_ok).select(
        "feature", "pos", F.lit("Numerical").alias("type"), F.col("n_valid").cast("long").alias("n_valid"),
        F.lit(0).alias("n_categories"), num_sig.alias("signal"),
        "mean_diff", "d", "r", "mi",
        F.lit(None).cast("double").alias("cramers_v"), F.lit(None).cast("double").alias("chi2"),
        F.lit(None).cast("int").alias("dof"), F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("double").alias("ig"),
    ) if numeric else None

    cat_rows = None
    if cats:
        # p < alpha  <=>  chi2 > critical(alpha, dof): the score stays in the JVM; the p-value
        # itself (a pandas UDF) is only evaluated when the column is selected
        with_p = cat_stats.filter(F.col("n_all") >= C.SIGNAL_MIN_VALID).withColumn(
            "p_value", chi2_pvalue(F.col("chi2"), F.col("dof")))
        x2, dof = F.col("chi2"), F.col("dof")
        bonus = (F.when(dof <= 0, 0.0)
                 .when(x2 > F.element_at(_critical(0.001), dof), 1.0)
                 .when(x2 > F.element_at(_critical(0.01), dof), 0.7)
                 .when(x2 > F.element_at(_critical(0.05), dof), 0.4).otherwise(0.0))
        cat_sig = F.least(F.greatest(
            0.45 * F.least(F.col("cramers_v"), F.lit(1.0)) + 0.40 * F.least(F.col("ig"), F.lit(1.0))
            + 0.15 * bonus, F.lit(0.0)), F.lit(1.0))
        n_cats = F.when(F.col("n_distinct") > C.SIGNAL_MAX_CATS, F.lit(C.SIGNAL_TOP_CATS)).otherwise(
            F.col("n_distinct")).cast("int")
        cat_rows = with_p.select(
            "feature", "pos", F.lit("Categorical").alias("type"), F.col("n_all").cast("long").alias("n_valid"),
            n_cats.alias("n_categories"), cat_sig.alias("signal"),
            F.lit(0.0).alias("mean_diff"), F.lit(None).cast("double").alias("d"),
            F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("mi"),
            "cramers_v", "chi2", "dof", "p_value", "ig",
        )
    parts = [x for x in (num_rows, cat_rows) if x is not None]
    if not parts:
        return _error_report(spark, C.SIG_ERR_NO_FEATURES)
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    tier = _tier(F.col("signal"))
    features = rows.withColumn("tier", tier).withColumn(
        "explanation", _explanation(F.col("feature"), F.col("tier"), F.col("type"),
                                    F.col("mean_diff"), F.col("n_categories")))
    features = features.select(*[c.split(" ")[0] for c in FEATURE_SCHEMA.split(", ")])
    routing = _routing(base, num_stats if numeric else None, cat_stats if cats else None,
                       binary_numeric)
    return SignalReport(features=features, summary=summarize(features), routing=routing,
                        contingency=contingency, numeric_bins=bins,
                        cached=(base, num_stats) if numeric else (base,))


def _routing(base, num_stats, cat_stats, binary_numeric) -> DataFrame:
    parts = []
    if num_stats is not None:
        route = (F.when(F.col("n_valid") < C.SIGNAL_MIN_VALID, "skip: fewer than 30 values")
                 .when(F.col("n_mid") == 0, "categorical")
                 .when((F.col("n0") < C.SIGNAL_MIN_CLASS) | (F.col("n1") < C.SIGNAL_MIN_CLASS),
                       "skip: a class has fewer than 5 rows")
                 .otherwise("numeric"))
        parts.append(num_stats.select("feature", F.lit("numeric").alias("dtype_kind"),
                                      F.col("n_valid").cast("long").alias("n_valid"),
                                      F.col("n0").cast("long").alias("n_neg"),
                                      F.col("n1").cast("long").alias("n_pos"), route.alias("route")))
    if cat_stats is not None:
        cs = cat_stats.filter(~F.col("feature").isin(binary_numeric)) if binary_numeric else cat_stats
        route = F.when(F.col("n_all") < C.SIGNAL_MIN_VALID, "skip: fewer than 30 values").otherwise("categorical")
        parts.append(cs.select("feature", F.lit("string").alias("dtype_kind"),
                               F.col("n_all").cast("long").alias("n_valid"),
                               F.col("t0").cast("long").alias("n_neg"),
                               F.col("t1").cast("long").alias("n_pos"), route.alias("route")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def summarize(features: DataFrame) -> DataFrame:
    """SIG15-SIG17: overall score, potential, tier counts, top-10, weak list, narrative.

    Works on the feature frame (one row per column), never on data rows.
    """
    w = Window.orderBy(F.col("signal").desc(), F.col("pos").asc())
    ranked = features.select("feature", "signal", "tier", F.row_number().over(w).alias("rank"))
    n_total = F.count(F.lit(1))
    n_strong = F.count_if(F.col("tier") == "Strong")
    agg = ranked.agg(
        n_total.alias("n_total"),
        n_strong.alias("n_strong"),
        F.count_if(F.col("tier") == "Medium").alias("n_medium"),
        F.count_if(F.col("tier") == "Weak").alias("n_weak"),
        F.sort_array(F.collect_list(F.struct("rank", "feature", "signal", "tier"))).alias("ordered"),
    )
    top_k = F.greatest(F.lit(1), F.floor(F.col("n_total") * C.SIGNAL_TOP_SHARE).cast("int"))
    top_signals = F.slice(F.transform(F.col("ordered"), lambda s: s["signal"]), 1, top_k)
    raw = F.aggregate(top_signals, F.lit(0.0), lambda acc, x: acc + x) / F.size(top_signals)
    bonus = F.least(F.col("n_strong") / F.greatest(F.col("n_total"), F.lit(1)) * 0.3, F.lit(0.3))
    overall = F.floor(F.least(F.greatest((raw + bonus) * 100, F.lit(0.0)), F.lit(100.0))).cast("int")
    s = agg.select(
        "*", overall.alias("overall_score"),
    ).select(
        "*",
        F.when(F.col("overall_score") >= C.SIGNAL_HIGH, "High")
         .when(F.col("overall_score") >= C.SIGNAL_MEDIUM_SCORE, "Medium").otherwise("Low").alias("potential_label"),
        F.transform(F.slice(F.col("ordered"), 1, 10), lambda x: x["feature"]).alias("top_features"),
        F.transform(F.filter(F.col("ordered"), lambda x: x["tier"] == "Weak"), lambda x: x["feature"])
         .alias("weak_features"),
        F.col("ordered")[0]["feature"].alias("top_name"),
    )
    return s.select(
        "overall_score", "potential_label", "n_strong", "n_medium", "n_weak", "n_total",
        "top_features", "weak_features",
        _narrative().alias("explanation"),
        F.lit(None).cast("string").alias("error"),
    )


def _narrative() -> Column:
    ns, nm, nw, nt = (F.col("n_strong"), F.col("n_medium"), F.col("n_weak"), F.col("n_total"))
    # percent as the original prints it: round half to even
    pct = F.bround(ns / F.greatest(nt, F.lit(1)) * 100.0, 0).cast("long")
    top = F.col("top_name")
    body = (F.when(F.col("potential_label") == "High", fill(C.SIG_HIGH_TEXT, n_strong=ns, n_total=nt, pct=pct, top=top))
            .when(F.col("potential_label") == "Medium",
                  fill(C.SIG_MEDIUM_TEXT, n_strong=ns, n_medium=nm, n_weak=nw, top=top))
            .otherwise(fill(C.SIG_LOW_TEXT, n_strong=ns, n_total=nt, top=top)))
    note = F.when(nw > nt * 0.5, fill(C.SIG_WEAK_NOTE, n_weak=nw)).otherwise(F.lit(""))
    return F.concat(body, note)


def _error_report(spark, msg: str) -> SignalReport:
    """SIG18: typed empty result carrying the reason."""
    feats = spark.createDataFrame([], FEATURE_SCHEMA)
    summary = spark.createDataFrame(
        [(0, "Unknown", 0, 0, 0, 0, [], [], msg, msg)],
        "overall_score int, potential_label string, n_strong long, n_medium long, n_weak long, "
        "n_total long, top_features array<string>, weak_features array<string>, explanation string, "
        "error string")
    empty_r = spark.createDataFrame([], "feature string, dtype_kind string, n_valid long, n_neg long, "
                                        "n_pos long, route string")
    empty_c = spark.createDataFrame([], "feature string, value string, n_neg long, n_pos long")
    empty_b = spark.createDataFrame([], "feature string, bin int, n_neg long, n_pos long")
    return SignalReport(features=feats, summary=summary, routing=empty_r, contingency=empty_c,
                        numeric_bins=empty_b)
