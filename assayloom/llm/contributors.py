"""Problem 3: records per contributor held to a maximum share, the best ones kept.

Counts are reduced first. At most floor(1 / share) contributors can exceed a share, so only the largest counts, that many, and the
total reach the driver, which finds the water level. Only the rows of the capped contributors are ranked: they are sorted in range
partitions by (contributor, quality, row), every partition gets the number of rows before it, and a row's rank is that number plus its
place in the partition. A contributor with a third of all rows thus spreads over as many tasks as its size asks for.
"""

from __future__ import annotations

from math import floor, inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.shared import stored


def water_level(largest: list[int], total: int, share: float, of_output: bool) -> float:
    """The most rows a contributor may keep. largest: the floor(1 / share) largest counts, descending; total: all rows. inf: nobody exceeds.

    Contributors above the level are filled to it, those below keep theirs; with the k largest above, the rest are the other rows. A level is
    consistent if it is not above the share of what the share is taken of: of the output, k * level + rest, so that level = share * rest /
    (1 - share * k); of the input, all rows whatever k is. The k is sought for which the level lies between the k-th and the next count.
    """
    rest = total
    for k in range(len(largest) + 1):
        if not of_output:
            level = share * total
        else:
            level = share * rest / (1 - share * k) if share * k < 1 - 1e-12 else 0.0
        following = largest[k] if k < len(largest) else 0
        if following <= level + 1e-9:
            return inf if k == 0 else floor(level + 1e-9)
        rest -= following
    return 0


def over_limit(df: DataFrame, contributor: Column, quality: list[Column], row_id: str, share: float, of_output: bool = False) -> DataFrame:
    """Rows to drop, (row_id), so that no contributor keeps more than `share` of all rows (of_output: of the rows kept).

    quality: sort columns, best first, with their directions and null order; row_id ends them, ascending. Rows without a contributor
    (null) are kept and count as rows. A share of 1 or more drops nothing; a level below one row drops all of a capped contributor.
    With of_output and so few contributors that no level is consistent, all their rows go. Empty tables give no rows.
    """
    if share < 1e-6:
        raise ValueError("share must be at least one in a million, as 1 / share counts reach the driver")
    rows = df.select(F.col(row_id).alias("row_id"), contributor.alias("_who"), *[q.alias(f"_q{i}") for i, q in enumerate(quality)])
    counts = stored(df.select(contributor.alias("_who")).groupBy("_who").agg(F.count(F.lit(1)).alias("n")), "counts")  # read thrice
    limit = floor(1 / share)
    largest = [r.n for r in counts.where(F.col("_who").isNotNull()).orderBy(F.desc("n")).select("n").limit(limit).collect()]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n
    level = water_level(largest, total, share, of_output)
    if level == inf or not largest or largest[0] <= level:
        return rows.where(F.lit(False)).select("row_id")
    capped = counts.where(F.col("_who").isNotNull() & (F.col("n") > level)).select("_who")  # at most 1 / share rows, as no more can exceed
    keys = ["_who", *[f"_q{i}" for i in range(len(quality))], "row_id"]
    inside = rows.join(F.broadcast(capped), "_who")
    # Stored, because the ranks below need every row to stay in the partition where it was counted.
    parted = stored(inside.repartitionByRange(*keys).select(*keys, F.spark_partition_id().alias("_part")), "ranged")
    sizes = parted.groupBy("_who", "_part").agg(F.count(F.lit(1)).alias("n"))  # contributors x partitions, bounded by partitions + 1 / share
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("_who").orderBy("_part")) - F.col("n")).drop("n")
    mixed = before.where(F.col("_before") < level)
    # Partitions that lie beyond the level as a whole need no order.
    beyond = parted.join(F.broadcast(before.where(F.col("_before") >= level)), ["_who", "_part"], "left_semi").select("row_id")
    place = F.row_number().over(Window.partitionBy("_who", "_part").orderBy(*keys[1:]))
    ranked = parted.join(F.broadcast(mixed), ["_who", "_part"]).withColumn("_rank", F.col("_before") + place)
    return ranked.where(F.col("_rank") > level).select("row_id").unionByName(beyond)
