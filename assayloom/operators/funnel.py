"""Multistage funnels: ordered stages of predicates, counted in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = tuple[str, Column]


def _passed(stages: list[Stage], upto: int) -> Column:
    """Stages 0..upto hold; an unknown predicate does not pass."""
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for _, p in stages[: upto + 1]], F.lit(True))


def funnel_counts(df: DataFrame, stages: list[Stage], distinct: str) -> DataFrame:
    """(ord, stage, remaining): distinct values of a column that are left after each stage, the start included.

    Each value's furthest stage is found first, so the frame is read once and one shuffle by value serves all stages.
    """
    names = ["start", *[n for n, _ in stages]]
    reach = reduce(lambda a, k: a + _passed(stages, k).cast("int"), range(len(stages)), F.lit(0))
    furthest = df.where(F.col(distinct).isNotNull()).groupBy(distinct).agg(F.max(reach).alias("reach"))
    counts = furthest.agg(*[F.count_if(F.col("reach") >= k).alias(f"n{k}") for k in range(len(names))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), F.lit(n).alias("stage"), F.col(f"n{k}").alias("remaining")) for k, n in enumerate(names)]))
    return counts.select(rows.alias("r")).select("r.*")


def survivors(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Rows that pass all stages. The predicates stay bare, so that Catalyst can push their comparisons into the scan."""
    for _, predicate in stages:
        df = df.where(predicate)
    return df
