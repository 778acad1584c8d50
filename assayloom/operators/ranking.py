"""Ranks, first rows and capped groups that hold at any size and skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.shared import stored


def ranked(df: DataFrame, order: dict[str, bool], rank: str = "rank") -> DataFrame:
    """df with the whole frame's row number in the given order (column -> descending); the columns must identify a row.

    The frame is sorted in range partitions, whose sizes give each one the number of rows before it, so no task sees all rows. Nulls come
    last either way.
    """
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order.items()]
    parted = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parted.join(F.broadcast(before), "_part").withColumn(rank, (F.col("_before") + place).cast("long")).drop("_part", "_before")


def first_by(df: DataFrame, group: list[str], order: Column, keep: list[str]) -> DataFrame:
    """The first row of each group in the order of a sortable column: an aggregate with map-side combine, so a hot group costs no more."""
    row = F.min(F.struct(order.alias("_order"), *keep))
    return df.groupBy(*group).agg(row.alias("_row")).select(*group, *[f"_row.{c}" for c in keep])


def capped(df: DataFrame, group: list[str], order: list[Column], most: int, spread: str, salts: int = 64) -> DataFrame:
    """At most `most` rows of each group, the first in the order. A group is thinned in `salts` parts (a hash of column spread) before its
    rows meet, so that at most salts * most rows of it do."""
    part = F.pmod(F.xxhash64(spread), F.lit(salts))
    pre = df.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_place") <= most)
    return pre.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= most).drop("_part", "_place")
