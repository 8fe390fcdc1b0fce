"""Running sums over a global order without a window over a group: range partitions, their totals, and windows inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.session import stored

#: Rows of one range.
RANGE_ROWS = 500_000


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str, tag: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (stored) with ``out``, the sum of ``value`` over the rows of the group up to this one in ``order`` (which must be total)."""
    ranges = -(-rows.count() // range_rows) or 1
    placed = stored(rows.repartitionByRange(ranges, *group, *order).withColumn("__part", F.spark_partition_id()), tag)
    totals = placed.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))      # one row per range and group
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__sum")
    totals = totals.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__part").alias("__p"), before.alias("__before"))
    on = (F.col("__part") == F.col("__p")) & F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.sum(value).over(Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(totals, on).withColumn(out, F.col("__before") + inside).drop("__part", "__p", "__before", *[f"__{c}" for c in group])
