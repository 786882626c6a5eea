"""Running sums and ranks over groups of any size, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, group: list[str], slot: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come earlier by (slot, order).

    A group is dealt out over its slots, so a hot group never meets in one task: one window runs in each
    (group, slot), and the slots' totals, one row each, give every slot its start. ``df`` should be a
    written table, as it is read twice. The columns of ``group`` and ``slot`` must not be null. With no
    group, all rows count as one; only the totals, a row for each slot, then meet in one task.
    """
    keys = [*group, slot]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    out = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.join(starts, keys).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def slots(df: DataFrame) -> int:
    """How many slots to deal a group over: four for each shuffle partition, so that slots grow with the cluster."""
    return 4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
