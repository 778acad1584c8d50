"""Problem 2: duplicates hidden by formatting, collapsed through dictionaries of integers.

Each distinct value is canonicalised once (a dictionary), its parts get integer identifiers (a second dictionary), a value becomes the
sorted tuple of its parts' identifiers, and equal tuples are one group. Rows are rewritten by a lookup that spreads hot values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.spelling import smiles_parts
from assayloom.operators.skew import salted_lookup
from assayloom.shared import stored


def encode(df: DataFrame, row_id: str, value: str, parts: Callable[[], Callable[[str], list[str]]] = smiles_parts) -> DataFrame:
    """The value dictionary: value, n_rows, tuple (sorted identifiers of its parts), first_row_id and copies of the tuple's group.

    Null and blank values are in no group. The identifiers are stored before use, so that a lost executor cannot change them.
    """

    @F.pandas_udf("array<string>")
    def canonical(values: pd.Series) -> pd.Series:
        f = parts()
        return values.map(f)

    canonical = canonical.asNondeterministic()  # filtered by its result; so it is computed once
    distinct = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(row_id).alias("first"))
    spelled = distinct.select("*", canonical("value").alias("parts")).where(F.size("parts") > 0)
    spelled = stored(spelled.withColumn("value_id", F.monotonically_increasing_id()), "values")
    exploded = spelled.select("value_id", F.explode("parts").alias("part"))
    # A part can be as frequent as a third of all values: it is counted first, and its lookup is spread.
    ids = stored(exploded.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part_id", F.monotonically_increasing_id()), "parts")
    encoded = salted_lookup(exploded, ids, "part", "value_id").groupBy("value_id").agg(F.sort_array(F.collect_list("part_id")).alias("tuple"))
    values = spelled.join(encoded, "value_id").select("value", "n_rows", "first", "tuple")
    groups = values.groupBy("tuple").agg(F.sum("n_rows").alias("copies"), F.min("first").alias("first_row_id"))
    return values.drop("first").join(groups, "tuple")


def tagged_parts() -> Callable[[str], list[str]]:
    """Parts of values of several columns at once: a value is tag, NUL, text, and its parts keep the tag, so no two columns share a tuple."""
    parts = smiles_parts()

    def tagged(value: str) -> list[str]:
        tag, _, text = value.partition("\0")
        return [f"{tag}\0{p}" for p in parts(text)]

    return tagged


def copies(df: DataFrame, row_id: str, value: str, keep: list[str] = (), **how) -> DataFrame:
    """(first_row_id, row_id) of each row that copies an earlier one, with the columns `keep`; unaltered repeats count. Other columns of df
    are not read."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(value).alias("value"), *keep)
    shared = stored(encode(rows, "row_id", "value", **how).where(F.col("copies") > 1).select("value", "n_rows", "first_row_id"), "copies")  # read thrice
    return salted_lookup(rows, shared, "value", "row_id").where(F.col("row_id") != F.col("first_row_id")).select(*keep, "first_row_id", "row_id")


def collapse(df: DataFrame, row_id: str, value: str, **how) -> DataFrame:
    """One record per group: first_row_id, value (of its most frequent spelling), copies, spellings."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(value).alias("value"))
    best = F.struct("n_rows", "value")
    out = encode(rows, "row_id", "value", **how).groupBy("tuple").agg(
        F.first("first_row_id").alias("first_row_id"), F.max(best)["value"].alias("value"), F.first("copies").alias("copies"), F.count(F.lit(1)).alias("spellings")
    )
    return out.drop("tuple")
