"""Lookups that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes. A key with more is spread over as many tasks as that asks for, at any size of the table. At most one
#: key per so many rows of the table can be hot, which bounds the list that is broadcast to a millionth of the table.
ROWS_A_TASK = 1_000_000


def salts(count: str | Column) -> Column:
    """How many tasks the rows of a key are spread over."""
    n = F.col(count) if isinstance(count, str) else count
    return F.greatest(F.lit(1), F.ceil(n / F.lit(ROWS_A_TASK))).cast("int")


def salted_lookup(rows: DataFrame, counted: DataFrame, key: str, spread: str, count: str = "n_rows") -> DataFrame:
    """Inner join of rows with counted (one row per key, its number of rows in column count).

    Keys of more than ROWS_A_TASK rows are spread by a hash of column spread, their lookup row is repeated as often. Null keys match nothing.
    """
    hot = F.broadcast(counted.where(F.col(count) > ROWS_A_TASK).select(F.col(key).alias("_hot_key"), salts(count).alias("_salts")))
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")
    left = rows.join(hot, rows[key] == hot["_hot_key"], "left").withColumn("_salt", salt).drop("_hot_key", "_salts")
    right = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts(count) - 1)))
    return left.join(right, [key, "_salt"]).drop("_salt")


def within_groups(members: DataFrame, group: str, item: str, count: str) -> DataFrame:
    """(group, item_a, item_b), item_a < item_b: all pairs of a group's items, whose number is in column count. They are the result, so there
    are as many; a group is spread over one task per so many of its rows as make ROWS_A_TASK pairs."""
    n = F.greatest(F.lit(1), F.ceil(F.col(count) * F.col(count) / F.lit(ROWS_A_TASK))).cast("int")
    part = F.pmod(F.xxhash64(item), n).cast("int")
    a = members.select(group, F.col(item).alias("item_a"), part.alias("_salt"))
    b = members.select(group, F.col(item).alias("item_b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_salt"))
    return a.join(b, [group, "_salt"]).where("item_a < item_b").select(group, "item_a", "item_b")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of about `least` rows or more that never cut a group, from batches in which equal keys are neighbours."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if batch.empty:
            continue
        held.append(batch)
        n += len(batch)
        if n < least:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(last[::-1].argmin() if not last.all() else len(frame))
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
        n = len(frame) - cut
    if held and n:
        yield pd.concat(held, ignore_index=True)
