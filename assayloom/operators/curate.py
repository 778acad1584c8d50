"""Consolidation of labelled rows and lineage of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.expr import four_digits, known, label_flags

#: Packed fields of a product's rows, and the names of their counts.
LINEAGE = {"methods": "n_methods", "parent_ids": "n_parents", "transforms": "n_transforms"}


def consolidate(df: DataFrame, key: Column, value: str, code: str, row_id: str) -> DataFrame:
    """One row per key: the median of its measured rows if there are any, else of all; where it came from, conflicts and counts.

    Rows without a key or a known value are left out. The median is exact; its state is the number of distinct values of the key, and it
    is combined before the shuffle. conflict: more than one value over all rows. first_row is the smallest row_id.
    """
    rows = df.select(key.alias("key"), known(value).alias("v"), F.coalesce(F.col(code) > 0, F.lit(False)).alias("m"), F.col(row_id).alias("r"))
    rows = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull())
    groups = rows.groupBy("key").agg(
        F.median(F.when(F.col("m"), F.col("v"))).alias("measured"), F.median("v").alias("any"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if("m").alias("n_measured"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("r").alias("first_row"),
    )
    conflict = F.col("low") < F.col("high")
    origin = F.when(F.col("n_measured") == 0, "assigned_median").when(F.col("n_measured") < F.col("n_rows"), "mixed_duplicate_measured_median")
    return groups.select(
        "key", F.coalesce("measured", "any").alias("target"), origin.otherwise("measured_median").alias("origin"), conflict.alias("has_conflict"),
        "n_rows", "n_measured", (F.col("n_rows") - F.col("n_measured")).alias("n_assigned"), "first_row",
    )


def group_values(df: DataFrame, key: Column, name: str, value: str, code: str, row_id: str) -> DataFrame:
    """One row per key: n_rows, compound_ids, first_id (of the smallest row_id), pic50_values, ic50_values, has_measured, has_active_unmeasured,
    has_inactive.

    Names and values are distinct, in ascending order, joined by ;, values with four digits: a cell is as long as the number of different
    ones, not of rows, which are combined before the shuffle. Null and NaN values are left out; a cell without any is null.
    """
    rows = df.select(key.alias("key"), F.col(name).alias("name"), known(value).alias("v"), F.col(code).alias("c"), F.col(row_id).alias("r")).where("key IS NOT NULL")
    flags = label_flags(F.col("c"))
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("r", "name"))["name"].alias("first_id"), F.bool_or(flags["is_measured"]).alias("has_measured"),
        F.bool_or(flags["is_active_unmeasured"]).alias("has_active_unmeasured"), F.bool_or(flags["is_inactive"]).alias("has_inactive"),
    )
    for column, text, out in (("name", F.col("name"), "compound_ids"), ("v", four_digits("v"), "pic50_values"), ("c", four_digits(F.col("c").cast("double")), "ic50_values")):
        distinct = rows.where(F.col(column).isNotNull()).select("key", column).distinct().withColumn("_t", text)
        joined = F.transform(F.sort_array(F.collect_list(F.struct(column, "_t"))), lambda x: x["_t"])
        groups = groups.join(distinct.groupBy("key").agg(F.array_join(joined, ";").alias(out)), "key", "left")
    return groups


def lineage(values: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row per key: its first row and parent, and what each of its packed fields (LINEAGE) holds: the distinct values, sorted and joined,
    and how many there are (null and 0 where there are none).

    rows: (row_id, key, parent, is_original); values: (row_id, field_name, value) as unpacked. Values are made distinct per key before
    they are joined, so a cell is as long as the number of different values, not of rows.
    """
    first = rows.groupBy(key).agg(
        F.min(F.struct("row_id", "parent")).alias("x"), F.count(F.lit(1)).alias("n_rows"), F.bool_or("is_original").alias("is_original")
    )
    distinct = values.join(rows.select("row_id", key), "row_id").select(key, "field_name", "value").distinct()
    joined = distinct.groupBy(key, "field_name").agg(F.array_join(F.sort_array(F.collect_list("value")), ";").alias("joined"), F.count(F.lit(1)).alias("n"))
    wide = joined.groupBy(key).pivot("field_name", list(LINEAGE)).agg(F.first("joined").alias("joined"), F.first("n").alias("n"))
    cells = [c for f, n in LINEAGE.items() for c in (F.col(f"{f}_joined").alias(f), F.coalesce(f"{f}_n", F.lit(0)).cast("long").alias(n))]
    return first.join(wide, key, "left").select(key, F.col("x.row_id").alias("first_row"), F.col("x.parent").alias("first_parent"), "n_rows", "is_original", *cells)
