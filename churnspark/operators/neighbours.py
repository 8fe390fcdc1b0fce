"""SIG5 / FEA7: mutual information of a numeric feature and the class by nearest neighbours.

The estimator for a continuous and a discrete variable (Ross, 2014): with r the distance to the k-th nearest neighbour of the row's own class and
m the rows of any class nearer than r (the row itself included), MI = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), at least 0.
Rows of a class with one row are left out; k is at most the class size less one.

Equal values are told apart by a hashed noise of at most ``NOISE`` of the feature's largest value, so nothing depends on the order of the
rows. Where more than k rows of a class still share a value (a double holds about 2^19 noises), r is 0 and m counts the rows of that value.
One dimension needs no index: neighbours are next to each other in the sorted class, and rows nearer than r are a difference of two
ranks. Ranks come from range partitions (``ranks``), neighbours from chunks of ranks with ``k`` border rows lent to the chunks next to
them, so no task holds a class or a feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.operators.ranks import RANGE_ROWS, running_sum
from churnspark.session import stored

NEIGHBOURS = 3
NOISE = 2.0 ** -33
#: Rows of a class that one chunk holds.
CHUNK = 50_000


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1: recurrence to x + 6, then the asymptotic series."""
    x = x.cast("double")
    z = x + 6
    s = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    for i in range(6):
        s = s - 1 / (x + i)
    return s


def long_values(df: DataFrame, names: list[str], label: str, key: str, fill: float | None) -> DataFrame:
    """(feature, key, y, v): one row per feature and value, nulls and NaN left out or filled, equal values told apart."""
    x = [F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")) for n in names]
    x = [F.coalesce(c, F.lit(float(fill))) if fill is not None else c for c in x]
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("x")) for n, c in zip(names, x)])
    long = df.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("y"), F.explode(arr).alias("s")).select(
        "key", "y", "s.*").filter("x is not null and y is not null")
    size = long.groupBy("feature").agg((F.max(F.abs("x")) * F.lit(NOISE)).alias("amp"))    # one row per feature
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("mi"), "feature", "key")), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)
    return long.join(F.broadcast(size), "feature").select("feature", "key", "y", (F.col("x") + (u - F.lit(0.5)) * F.col("amp")).alias("v"))


def neighbour_mi(df: DataFrame, names: list[str], label: str = "label", key: str = "c_custkey", k: int = NEIGHBOURS, fill: float | None = None,
                 chunk: int = CHUNK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(feature, mi) in nats. ``fill`` stands for nulls; without it rows without a value are left out."""
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, mi double")
    long = stored(long_values(df, names, label, key, fill), "mi-values")
    one = F.lit(1).cast("long")
    ranked = running_sum(long, ["feature", "y"], ["v", "key"], one, "pos", "mi-ranks", range_rows)
    sizes = long.groupBy("feature", "y").agg(F.count(one).alias("n_class"))                # one row per feature and class
    ranked = ranked.join(F.broadcast(sizes), ["feature", "y"]).filter("n_class > 1").withColumn("pos", F.col("pos") - 1)
    # border rows go to the chunks next to them as well
    own, at = F.floor(F.col("pos") / chunk), F.col("pos") % chunk
    homes = F.array_compact(F.array(own, F.when(at < k, own - 1), F.when(at >= chunk - k, own + 1)))
    lent = ranked.select("*", own.alias("own"), F.explode(homes).alias("home"))
    w = Window.partitionBy("feature", "y", "home").orderBy("pos")
    near = F.array_compact(F.array(*[f("v", j).over(w) for j in range(1, k + 1) for f in (F.lag, F.lead)]))
    near = F.array_sort(F.transform(near, lambda v: F.struct(F.abs(v - F.col("v")).alias("r"), v.alias("v"))))
    lent = lent.withColumn("near", near).filter("own = home")
    wanted = F.least(F.lit(k), F.col("n_class") - 1)
    kth = lent.withColumn("k", wanted).withColumn("kth", F.element_at("near", wanted.cast("int")))
    right = F.col("kth.v") > F.col("v")
    points = stored(kth.select("feature", "key", "v", "k", "n_class", F.when(right, F.col("v") - F.col("kth.r")).otherwise(F.col("kth.v")).alias("lo"),
                               F.when(right, F.col("kth.v")).otherwise(F.col("v") + F.col("kth.r")).alias("hi")), "mi-points")
    # rows strictly between lo and hi: those below hi less those up to lo; a bound that is the row's own value takes in the rows of that value
    bounds = ((F.col("v"), F.lit(1), 0), (F.greatest("hi", "v"), F.when(F.col("hi") > F.col("v"), 0).otherwise(2), 1),
              (F.least("lo", "v"), F.when(F.col("lo") < F.col("v"), 2).otherwise(0), -1))
    events = F.array(*[F.struct(at.alias("at"), kind.alias("kind"), F.lit(sign).alias("sign")) for at, kind, sign in bounds])
    events = stored(points.select("feature", "key", F.explode(events).alias("e")).select("feature", "key", "e.*"), "mi-events")
    is_point = (F.col("kind") == 1).cast("long")
    counted = running_sum(events, ["feature"], ["at", "kind", "key"], is_point, "upto", "mi-counts", range_rows).filter("kind <> 1")
    inside = counted.groupBy("feature", "key").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    per = points.join(inside, ["feature", "key"]).groupBy("feature").agg(
        F.count(one).alias("n"), F.avg(digamma(F.col("k"))).alias("k"), F.avg(digamma(F.col("n_class"))).alias("c"), F.avg(digamma(F.col("m"))).alias("m"),
        (F.max("n_class") < F.count(one)).alias("classes"))
    spread = df.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    mi = F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("k") - F.col("c") - F.col("m"))
    return spread.join(per, "feature", "left").select("feature", F.when(F.col("classes"), mi).otherwise(0.0).alias("mi"))

