"""Points within a radius of others, through a grid of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators import skew


def _cell(axes: list[Column], radius: float) -> list[Column]:
    return [F.floor(a / radius).cast("long") for a in axes]


def within(points: DataFrame, probes: DataFrame, axes: list[str], radius: float, others: bool = False) -> DataFrame:
    """(point_id, n_near, least): points (point_id, axes) with a probe (probe_id, axes) at most `radius` away, the number of such probes and
    the least distance. The same id on both sides counts as different points unless `others` is set: then a point is not near itself.

    A probe is sent to the cells around its own, so an equi-join on the cell finds all pairs; points without such a cell never travel on.
    A cell of more points than a task holds is spread by their ids, and its probes are sent to each part. Points with an unknown coordinate
    are near nothing.
    """
    p = points.dropna(subset=axes).select("point_id", *axes, *[c.alias(f"_c{i}") for i, c in enumerate(_cell([F.col(a) for a in axes], radius))])
    q = probes.dropna(subset=axes).select("probe_id", *[F.col(a).alias(f"_{a}") for a in axes])
    for i, a in enumerate(axes):
        c = F.floor(F.col(f"_{a}") / radius).cast("long")
        q = q.withColumn(f"_c{i}", F.explode(F.sequence(c - 1, c + 1)))
    cells = [f"_c{i}" for i in range(len(axes))]
    counts = p.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > skew.ROWS_A_TASK)
    hot = F.broadcast(counts.select(*cells, skew.salts("_n").alias("_salts")))  # at most one cell per ROWS_A_TASK points
    share = F.coalesce("_salts", F.lit(1))
    p = p.join(hot, cells, "left").withColumn("_salt", F.pmod(F.xxhash64("point_id"), share).cast("int")).drop("_salts")
    q = q.join(hot, cells, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), share - 1))).drop("_salts")
    squared = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes])
    pairs = p.join(q, [*cells, "_salt"])
    if others:
        pairs = pairs.where("point_id <> probe_id")
    near = pairs.select("point_id", squared.alias("_d")).where(F.col("_d") <= radius * radius)
    return near.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_near"), F.sqrt(F.min("_d")).alias("least"))
