"""Library enumeration by site: string transforms from a table, applied at each place where their pattern stands, one product per place.

Transforms are rows (label, pattern, replacement) of plain text, not reactions: the products are strings of which only the spelling is
changed, which is right for exchanges of one terminal token by another. Anything that needs a molecule's graph takes a table of products.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.ranking import first_by
from assayloom.shared import stored

Transform = tuple[str, str, str]


def apply_transforms(parents: DataFrame, transforms: list[Transform]) -> DataFrame:
    """(parent, label, site, product) for parents (parent): sites count from 1 in the string; a product equal to its parent is left out."""
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pattern"), F.lit(c).alias("replacement")) for a, b, c in transforms]))
    pieces = parents.select("parent", kinds.alias("t")).select("parent", "t.*").withColumn("pieces", F.split("parent", F.concat(F.lit(r"\Q"), "pattern", F.lit(r"\E"))))
    sites = pieces.where(F.size("pieces") > 1).withColumn("site", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)))
    rest = F.size("pieces") - F.col("site")
    product = F.concat(F.array_join(F.slice("pieces", F.lit(1), F.col("site")), "\0"), F.lit("\1"), F.array_join(F.slice("pieces", F.col("site") + 1, rest), "\0"))
    product = F.replace(F.replace(product, F.lit("\1"), F.col("replacement")), F.lit("\0"), F.col("pattern"))
    return sites.select("parent", "label", F.col("site").cast("long").alias("site"), product.alias("product")).where("product <> parent")


def first_products(products: DataFrame) -> DataFrame:
    """One row per (label, product), that of the smallest parent and site."""
    return first_by(products, ["label", "product"], F.struct("parent", "site"), ["parent", "site"])


def levels(parents: DataFrame, transforms: list[Transform], depth: int, longest: int | None = None) -> DataFrame:
    """(product, depth, root): what up to `depth` transforms make of parents (parent), each product once at its first depth with its smallest
    root. Only where `longest` is given, longer products are left out, and what lies beyond them. Every level is aggregated, checked against
    the levels before it by an anti join and stored, so what is reached does not depend on the order of rows."""
    seen = stored(parents.select(F.col("parent").alias("product"), F.lit(0).cast("long").alias("depth"), F.col("parent").alias("root")), "level")
    front, out = seen, [seen]
    for d in range(1, depth + 1):
        made = apply_transforms(front.select(F.col("product").alias("parent")), transforms).select("parent", "product").distinct()
        made = made.join(front.select(F.col("product").alias("parent"), "root"), "parent")
        if longest is not None:
            made = made.where(F.length("product") <= longest)
        made = made.groupBy("product").agg(F.min("root").alias("root"))
        front = made.join(reduce(DataFrame.unionByName, out).select("product"), "product", "left_anti").select("product", F.lit(d).cast("long").alias("depth"), "root")
        front = stored(front, "level")  # read by every level behind it
        out.append(front)
    return reduce(DataFrame.unionByName, out[1:])
