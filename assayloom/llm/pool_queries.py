"""Queries of problems 3 and 6 over the product pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.compound_queries import id_key
from assayloom.llm.contributors import over_limit
from assayloom.llm.variety import text_features, varied_subset
from assayloom.shared import stored, table

SHARE = 0.02
WANTED = 1_000


def _dropped(pool: DataFrame, of_output: bool) -> DataFrame:
    score = F.nanvl("pred_pIC50", F.lit(None).cast("double"))
    quality = [F.coalesce(-score, F.lit(float("inf")))]  # ascending; null and NaN last
    return over_limit(pool, id_key("primary_parent_id"), quality, "row_id", SHARE, of_output)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dropped(table(spark, sf_dir, "lead_selection_relaxed_pool"), of_output=False)


def p3_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with no parent above 2 percent of what is left: rows kept by parent, and their lowest score."""
    pool = table(spark, sf_dir, "lead_selection_relaxed_pool").select("row_id", "primary_parent_id", "pred_pIC50")
    kept = pool.join(_dropped(pool, of_output=True), "row_id", "left_anti")
    score = F.nanvl("pred_pIC50", F.lit(None).cast("double"))
    return kept.groupBy(id_key("primary_parent_id").alias("parent")).agg(
        F.count(F.lit(1)).alias("n_kept"), F.min(score).alias("least_pic50"), F.sum("row_id").alias("id_sum")
    )


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, scaffold) of the first row of each product; rows without a product have no structure to be varied in."""
    pool = table(spark, sf_dir, "lead_selection_relaxed_pool").where(F.trim("product_smiles") != "")
    return pool.groupBy("product_smiles").agg(F.min(F.struct("row_id", "scaffold")).alias("x")).select("x.row_id", "x.scaffold", "product_smiles")


def p6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WANTED products that cover the scaffolds and structures of the pool, in the order of selection."""
    products = stored(_products(spark, sf_dir), "products")
    slots, weights = text_features(F.col("scaffold"), "product_smiles")
    chosen = varied_subset(products.select(F.col("row_id").alias("rec_id"), slots.alias("slots"), weights.alias("weights")), WANTED)
    return products.join(F.broadcast(chosen), products["row_id"] == chosen["rec_id"]).select("row_id", "place", "scaffold", "product_smiles")  # WANTED rows


def p6_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p6_subset: as many different products as are wanted or there are, in places from 1 on, all of them of the pool."""
    chosen = p6_subset(spark, sf_dir)
    pool = table(spark, sf_dir, "lead_selection_relaxed_pool").select("row_id", F.col("product_smiles").alias("_product"), F.col("scaffold").alias("_scaffold"))
    same = F.col("_product").eqNullSafe(F.col("product_smiles")) & F.col("_scaffold").eqNullSafe(F.col("scaffold"))
    return chosen.join(pool, "row_id").agg(
        F.count(F.lit(1)).alias("n_chosen"), F.count_distinct("product_smiles").alias("n_products"), F.count_distinct("place").alias("n_places"), F.max("place").alias("last_place"),
        F.count_if(~same).alias("n_altered"),
    )


def p6_by_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scaffold's products in the pool, and how many of them were chosen."""
    chosen = p6_subset(spark, sf_dir).groupBy("scaffold").agg(F.count(F.lit(1)).alias("n_chosen"))
    pool = _products(spark, sf_dir).groupBy("scaffold").agg(F.count(F.lit(1)).alias("n_products"))
    both = pool.join(chosen.withColumnRenamed("scaffold", "_s"), F.col("scaffold").eqNullSafe(F.col("_s")), "left")
    return both.select("scaffold", "n_products", F.coalesce("n_chosen", F.lit(0)).cast("long").alias("n_chosen"))


_RANKED = """
WITH p AS (
  SELECT row_id, nullif(upper(regexp_replace(primary_parent_id, '[^A-Za-z0-9]', '', 'g')), '') AS parent,
    CASE WHEN pred_pIC50::VARCHAR = 'nan' THEN NULL ELSE pred_pIC50 END AS score FROM lead_selection_relaxed_pool
), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC NULLS LAST, row_id) AS place FROM p)"""
SQL = {
    "p6_sound": f"""
SELECT n AS n_chosen, n AS n_products, n AS n_places, n AS last_place, 0::BIGINT AS n_altered
FROM (SELECT least({WANTED}, count(DISTINCT product_smiles)) AS n FROM lead_selection_relaxed_pool WHERE trim(product_smiles) <> '')""",
    "p3_found": _RANKED + f"SELECT row_id FROM r WHERE parent IS NOT NULL AND place > floor({SHARE} * (SELECT count(*) FROM p))",
    "p3_capped": _RANKED
    + f""", c AS (SELECT count(*) AS n FROM p GROUP BY parent), n AS (SELECT count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY parent),
levels AS (SELECT l.range AS c FROM range(1, 1 + (SELECT count(*) FROM p)) l),
best AS (SELECT coalesce(max(c), 0) AS level FROM levels WHERE c <= 1e-9 + {SHARE} * ((SELECT sum(least(n, c)) FROM n) + (SELECT count(*) FROM p WHERE parent IS NULL)))
SELECT parent, count(*) AS n_kept, min(score) AS least_pic50, sum(row_id)::BIGINT AS id_sum FROM r
WHERE parent IS NULL OR place <= (SELECT level FROM best) GROUP BY parent""",
}
QUERIES = {"p3_found": p3_found, "p3_capped": p3_capped, "p6_subset": p6_subset, "p6_by_scaffold": p6_by_scaffold, "p6_sound": p6_sound}
