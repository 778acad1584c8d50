"""Neighbours, regression, geometry and enumeration."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.functions.spelling import canonical_sql, with_molecule
from assayloom.operators import models as M
from assayloom.operators.enumerate import apply_transforms, first_products, levels
from assayloom.operators.geometry import within
from assayloom.operators.portfolio import greedy_portfolio
from assayloom.operators.ranking import ranked
from assayloom.operators.regress import grouped_ridge, loo_means, metrics
from assayloom.operators.similarity import against_all, nearest, sign_words, vector_neighbours, words
from assayloom.shared import stored, table

BITS = [f"fp_{i}" for i in range(512)]
#: Searches take as queries every row whose id is divisible by this.
EVERY = 100
TRANSFORMS = [("chloro_to_fluoro", "Cl", "F"), ("ester_to_amide", "C(=O)O", "C(=O)N"), ("ether_to_thioether", "OC", "SC"), ("nitrile_to_acid", "C#N", "C(=O)O")]
r6 = lambda c: F.round(c, 6)


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(words(table(spark, sf_dir, "feature_set_morgan_512"), "row_id", BITS), "words")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir)
    return against_all(rows.where(F.col("row_id") % EVERY == 0).withColumnRenamed("row_id", "query_id"), rows, 8)


def a14_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(_search(spark, sf_dir))
    return found.withColumns({c: r6(c) for c in ("max_similarity", "mean_similarity")})


def a17_similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows fall in each band of similarity to each query."""
    s = F.col("similarity")
    bands = {"n_85": s >= 0.85, "n_70": (s >= 0.70) & (s < 0.85), "n_55": (s >= 0.55) & (s < 0.70), "n_below": s < 0.55}
    return _search(spark, sf_dir).groupBy("query_id").agg(*[F.count_if(v).alias(k) for k, v in bands.items()])


def f25_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within a window of similarity to a query."""
    return _search(spark, sf_dir).where(F.col("similarity").between(0.55, 0.95)).select("query_id", "row_id", r6("similarity").alias("similarity"))


def j12_max_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's largest similarity to a reference set, and which reference that is (the smallest id of equals)."""
    best = F.max(F.struct("similarity", (-F.col("query_id")).alias("_id")))
    found = _search(spark, sf_dir).groupBy("row_id").agg(best.alias("b"))
    return found.select("row_id", (-F.col("b._id")).alias("reference_id"), r6(F.col("b.similarity")).alias("similarity"))


def _labelled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of the feature matrix with a label and a molecule: row_id, molecule, pIC50 and columns. Spellings of one molecule are one."""
    rows = E.without_nan(table(spark, sf_dir, "final_model_feature_matrix").select("row_id", "canonical_smiles", "pIC50", *columns)).where("pIC50 IS NOT NULL")
    return with_molecule(rows, "canonical_smiles", "row_id").drop("canonical_smiles")


def _loo(rows: DataFrame, key: str) -> DataFrame:
    out = loo_means(rows, F.col(key), "pIC50").where("others_mean IS NOT NULL")
    return out.select(F.col("key").alias(key), F.col("value").alias("pic50"), "n_same", r6("others_mean").alias("others_mean"))


def m01_loo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean label of a SMILES string's other rows; of the molecule's, however spelled: m01_loo_mean_molecule."""
    return _loo(E.without_nan(table(spark, sf_dir, "final_model_feature_matrix").select("canonical_smiles", "pIC50")), "canonical_smiles")


def m01_loo_mean_molecule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean label of a molecule's other rows, in whatever spelling."""
    return _loo(_labelled(spark, sf_dir), "molecule")


def m07_memoriser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model that memorises SMILES strings scores in sample: each row predicted by its string's mean."""
    rows = E.without_nan(table(spark, sf_dir, "final_model_feature_matrix").select("canonical_smiles", "pIC50")).where("pIC50 IS NOT NULL AND canonical_smiles IS NOT NULL")
    return _memorised(rows, "canonical_smiles")


def m07_memoriser_molecule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model that memorises molecules scores in sample: each row predicted by its molecule's mean over all spellings."""
    return _memorised(_labelled(spark, sf_dir), "molecule")


def _memorised(rows: DataFrame, key: str) -> DataFrame:
    cells = rows.groupBy(key, "pIC50").agg(F.count(F.lit(1)).alias("n"))
    means = cells.groupBy(key).agg((F.sum(F.col("pIC50") * F.col("n")) / F.sum("n")).alias("mean"))
    e = F.col("pIC50") - F.col("mean")
    sums = cells.join(means, key).agg(
        F.sum("n").alias("n"), F.sum(F.abs(e) * F.col("n")).alias("a"), F.sum(e * e * F.col("n")).alias("s"), F.sum(F.col("pIC50") * F.col("n")).alias("y"), F.sum(F.col("pIC50") * F.col("pIC50") * F.col("n")).alias("yy")
    )
    total = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return sums.select("n", r6(F.col("a") / F.col("n")).alias("mae"), r6(F.sqrt(F.col("s") / F.col("n"))).alias("rmse"), r6(1 - F.col("s") / total).alias("r2"))


def a11_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each product's stated prediction agrees with its parent's activity, by number of unique methods."""
    pool = E.without_nan(table(spark, sf_dir, "lead_selection_relaxed_pool").select(E.key_of("primary_parent_id").alias("k"), "pred_pIC50", "n_unique_methods"))
    cells = pool.groupBy("k", "n_unique_methods", "pred_pIC50").agg(F.count(F.lit(1)).alias("n"))  # a hot parent is as large as its different predictions
    parents = table(spark, sf_dir, "ranked_compounds").select(E.key_of("representative_id").alias("k"), "target_pIC50")
    joined = cells.join(parents, "k").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = metrics(joined, "target_pIC50", "pred_pIC50", ["n_unique_methods"])
    return out.withColumns({c: F.round(c, 10) for c in ("mae", "rmse", "r2")})


def m05_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of each query and their labels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    queries = rows.where(F.col("row_id") % EVERY == 0).select(F.col("row_id").alias("query_id"), "vector")
    found = vector_neighbours(queries, rows, 5)
    return found.join(rows.select("row_id", "label"), "row_id").select("query_id", "row_id", F.col("place").cast("long").alias("place"), F.round("squared", 5).alias("squared"), "label")


def m10_tanimoto_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's label guessed by the similarity-weighted mean of its five nearest fingerprints, of the signs of embeddings."""
    rows = stored(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), sign_words("embedding", 64).alias("words"), "label"), "signs")
    pairs = against_all(rows.where(F.col("row_id") % EVERY == 0).select(F.col("row_id").alias("query_id"), "words"), rows.select("row_id", "words"), 1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id"))
    top = pairs.withColumn("place", place).where("place <= 5").join(rows.select("row_id", "label"), "row_id")
    weight = F.col("similarity") + 1e-8
    return top.groupBy("query_id").agg(r6(F.sum(weight * F.col("label")) / F.sum(weight)).alias("prediction"))


def m12_grouped_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of the label on the 17 descriptors, ten folds of whole molecules: error of each penalty over all rows with a label and a molecule.
    Unknown descriptors are filled with the medians of the folds that a model is fitted to."""
    rows = _labelled(spark, sf_dir, *E.DESCRIPTORS)
    return metrics(grouped_ridge(rows, F.col("molecule"), E.DESCRIPTORS, "pIC50", [0.1, 10.0, 1000.0]), "pIC50", "prediction", ["alpha"])


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, pIC50, descriptors, held): a fifth of the molecules is held out."""
    rows = _labelled(spark, sf_dir, *E.DESCRIPTORS)
    return stored(rows.withColumn("held", F.pmod(F.xxhash64("molecule"), F.lit(5)) == 0), "descriptors")


def _fit(ready: DataFrame, estimator) -> PipelineModel:
    return M.fitted(ready.where("NOT held"), E.DESCRIPTORS, "pIC50", estimator)


def m02_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, elastic nets and forests over three folds of whole molecules: errors over all rows with a label, the best first."""
    rows = _labelled(spark, sf_dir, *E.DESCRIPTORS)
    board = M.leaderboard(M.held_out(rows, E.DESCRIPTORS, "pIC50", F.col("molecule"), M.grid()))
    return board.withColumns({c: F.round(c, 10) for c in ("mae", "rmse", "r2")})


def m06_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of 200 trees: predictions of the molecules held out."""
    ready = _prepared(spark, sf_dir)
    return _fit(ready, M.forest()).transform(ready.where("held")).select("row_id", F.col("pIC50").alias("actual"), "prediction")


def m13_ranked_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best elastic net or mean over three folds, fitted to all rows with a label: their predictions, residuals and ranks."""
    rows = stored(_labelled(spark, sf_dir, *E.DESCRIPTORS), "labelled")
    models = {k: m for k, m in M.grid().items() if m is not None and k.startswith("elastic")}
    best = M.leaderboard(M.held_out(rows, E.DESCRIPTORS, "pIC50", F.col("molecule"), models)).limit(1).collect()[0].model
    made = M.fitted(rows, E.DESCRIPTORS, "pIC50", models[best]).transform(rows.withColumns({c: E.known(c) for c in E.DESCRIPTORS}))
    made = made.select("row_id", "pIC50", "prediction", (F.col("pIC50") - F.col("prediction")).alias("residual"), F.lit(best).alias("model"))
    return ranked(made, {"prediction": True, "row_id": False})


def m14_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models together on the molecules held out, two forests (with and without bootstrap), boosted trees and an elastic net: mean and
    spread of their predictions, the mean as a concentration, and the distance to the molecules that they were fitted to."""
    ready = _prepared(spark, sf_dir)
    out = ready.where("held")
    for name, estimator in (("forest", M.forest()), ("extra", M.forest(bootstrap=False)), ("boosted", M.boosted()), ("elastic", M.elastic(0.01, 0.2))):
        made = _fit(ready, estimator).transform(out.withColumns({c: E.known(c) for c in E.DESCRIPTORS}))
        out = made.withColumn(f"pred_{name}", F.col("prediction")).drop("prediction", "_vector", "_scaled", *[f"_f_{c}" for c in E.DESCRIPTORS])
    models = [F.col(c) for c in out.columns if c.startswith("pred_")]
    out = E.beside(out, E.population(ready.where("NOT held"), E.DESCRIPTORS))
    return out.select(
        "row_id", F.col("pIC50").alias("actual"), E.row_mean(models).alias("mean"), E.row_spread(models).alias("spread"), E.micromolar(E.row_mean(models)).alias("ic50_um"),
        E.distance_to_training(E.DESCRIPTORS).alias("distance"),
    )


def m15_scored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pool row scored by a forest that was fitted to the feature matrix, saved, and loaded again."""
    rows = stored(_labelled(spark, sf_dir, *E.DESCRIPTORS), "labelled")
    path = M.saved(M.fitted(rows, E.DESCRIPTORS, "pIC50", M.forest()), rows, "forest")
    return M.scored(table(spark, sf_dir, "lead_selection_relaxed_pool").select("row_id", *E.DESCRIPTORS), path, E.DESCRIPTORS, rows)


def m16_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's weight of each descriptor."""
    weights = _fit(_prepared(spark, sf_dir), M.forest()).stages[-1].featureImportances.toArray().tolist()  # one number per descriptor
    return spark.createDataFrame(list(zip(E.DESCRIPTORS, weights)), "descriptor string, importance double").orderBy(F.desc("importance"), "descriptor")


def j15_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, taken as points of their first three values, with a query point of another id nearby."""
    axes = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *axes)
    found = within(points, points.where(F.col("point_id") % EVERY == 0).withColumnRenamed("point_id", "probe_id"), ["x", "y", "z"], 0.1, others=True)
    return found.select("point_id", "n_near", r6("least").alias("least"))


def j15_within_radius_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, taken as points of their first three values, with another point nearby: all points are probes."""
    axes = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *axes)
    found = within(points, points.withColumnRenamed("point_id", "probe_id"), ["x", "y", "z"], 0.1, others=True)
    return found.select("point_id", "n_near", r6("least").alias("least"))


def g10_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the largest quantity of each return flag side by side."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity")).withColumnsRenamed({"A": "most_a", "N": "most_n", "R": "most_r"})


def _diverse(spark: SparkSession, sf_dir: str, wanted: int, caps: dict[str, int], ceiling: float, exempt: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"), sign_words("embedding", 64).alias("words"))
    return greedy_portfolio(stored(rows, "signs"), [("score", True), ("vec_id", False)], wanted, caps, "label", "words", ceiling, exempt).select("vec_id", "place")


def d02_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 embeddings in the order of their first value, at most 2 of a label; after 3, of a new label or less than 0.45 similar to those chosen
    by the signs of 64 dimensions; what is left free is filled in order."""
    return _diverse(spark, sf_dir, 12, {"label": 2}, 0.45, 3)


def d03_diverse_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 embeddings as in d02_diverse, at most 3 of a label; after 4, of a new label or less than 0.40 similar."""
    return _diverse(spark, sf_dir, 30, {"label": 3}, 0.40, 4)


def d04_diverse_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 embeddings as in d02_diverse without a cap; after 4, of a new label or less than 0.35 similar."""
    return _diverse(spark, sf_dir, 30, {}, 0.35, 4)


def e08_site_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each transform at each site of the feature matrix's molecules, the first parent of each kept."""
    parents = table(spark, sf_dir, "final_model_feature_matrix").select(E.tidy("canonical_smiles").alias("parent")).where("parent IS NOT NULL").distinct()
    return first_products(apply_transforms(parents, TRANSFORMS)).select("label", "product", "parent", "site")


def o02_sorted_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of e08_site_transforms in the order of label and product, each with its place and a label that names the site."""
    products = ranked(e08_site_transforms(spark, sf_dir), {"label": False, "product": False}, "place")
    return products.select("place", "product", F.concat("label", F.lit("_at_"), "site").alias("label"))


def e16_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two rounds of transforms reach from the feature matrix's molecules, all of them and at any length."""
    parents = table(spark, sf_dir, "final_model_feature_matrix").select(E.tidy("canonical_smiles").alias("parent")).where("parent IS NOT NULL").distinct()
    return levels(parents, TRANSFORMS, 2)


def e16_levels_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rounds of transforms reach from the feature matrix's molecules, all of them and at any length."""
    parents = table(spark, sf_dir, "final_model_feature_matrix").select(E.tidy("canonical_smiles").alias("parent")).where("parent IS NOT NULL").distinct()
    return levels(parents, TRANSFORMS, 3)


def _sites_sql(source: str, column: str) -> str:
    one = []
    for label, pattern, replacement in TRANSFORMS:
        one.append(f"""SELECT {column} AS parent, '{label}' AS label, i AS site, array_to_string(p[:i], '{pattern}') || '{replacement}' || array_to_string(p[i + 1:], '{pattern}') AS product
    FROM (SELECT {column}, string_split({column}, '{pattern}') AS p, unnest(range(1, len(string_split({column}, '{pattern}')))) AS i FROM {source})""")
    return "(SELECT * FROM (" + " UNION ALL ".join(one) + ") WHERE product <> parent)"


_TIDY = r"nullif(regexp_replace(canonical_smiles, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '')"
_FM = "(SELECT canonical_smiles, CASE WHEN pIC50::VARCHAR = 'nan' THEN NULL ELSE pIC50 END AS y FROM final_model_feature_matrix)"
_MOLECULES = f"(SELECT nullif({canonical_sql('canonical_smiles')}, '') AS molecule, CASE WHEN pIC50::VARCHAR = 'nan' THEN NULL ELSE pIC50 END AS y FROM final_model_feature_matrix)"
_PAIRS = (
    "WITH s AS (SELECT row_id, (" + " || ".join(f"(coalesce({b}, 0) = 1)::INT::VARCHAR" for b in BITS) + ")::BIT AS bits FROM feature_set_morgan_512), b AS (SELECT *, bit_count(bits) AS n FROM s),"
    f""" pairs AS (SELECT q.row_id AS query_id, r.row_id, bit_count(q.bits & r.bits)::DOUBLE / nullif(q.n + r.n - bit_count(q.bits & r.bits), 0) AS similarity
    FROM b q JOIN b r ON q.row_id % {EVERY} = 0 AND q.row_id <> r.row_id)"""
)
_SIGNS = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END" for i in range(64))


def _near_sql(probes: str) -> str:
    return f"""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT p.vec_id AS point_id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d FROM p JOIN p q ON q.vec_id <> p.vec_id {probes})
SELECT point_id, count(*) AS n_near, round(sqrt(min(d)), 6) AS least FROM d WHERE d <= 0.1 * 0.1 GROUP BY 1"""


def _loo_sql(source: str, key: str) -> str:
    return f"""
WITH c AS (SELECT {key}, y, count(*) AS n_same FROM {source} WHERE y IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(n_same) OVER (PARTITION BY {key}) AS n, sum(y * n_same) OVER (PARTITION BY {key}) AS s FROM c)
SELECT {key}, y AS pic50, n_same, round((s - y) / (n - 1), 6) AS others_mean FROM t WHERE n > 1"""


def _memoriser_sql(source: str, key: str) -> str:
    return f"""
WITH r AS (SELECT y, avg(y) OVER (PARTITION BY {key}) AS p FROM {source} WHERE y IS NOT NULL AND {key} IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM r"""


def _levels_sql(depth: int) -> str:
    """Level by level: what a level makes that no level before it has."""
    out = f"WITH l0 AS (SELECT DISTINCT {_TIDY} AS s, {_TIDY} AS root FROM final_model_feature_matrix WHERE {_TIDY} IS NOT NULL)"
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT s FROM l{k}" for k in range(d))
        out += f""", l{d} AS (SELECT product AS s, min(root) AS root FROM {_sites_sql(f'l{d - 1}', 's')} JOIN l{d - 1} ON l{d - 1}.s = parent
  WHERE product NOT IN ({before}) GROUP BY 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT s AS product, {d}::BIGINT AS depth, root FROM l{d}" for d in range(1, depth + 1))


def _diverse_sql(wanted: int, cap: int | None, ceiling: float, exempt: int) -> str:
    """The greedy choice among the embeddings, by their labels and the signs of 64 dimensions."""
    capped = f"n < {wanted}" + (f" AND len(list_filter(labels, lambda v: v = r.label)) < {cap}" if cap else "")
    far = f"bit_count(v & r.w) >= {ceiling} * (bit_count(v) + bit_count(r.w) - bit_count(v & r.w))"
    new = f"(n < {exempt} OR NOT list_contains(labels, r.label) OR len(list_filter(ws, lambda v: {far})) = 0)"

    def step(cond: str, t: str) -> str:
        return f"""SELECT r.i, n + {cond}::INT, CASE WHEN {cond} THEN list_append(ids, r.vec_id) ELSE ids END, CASE WHEN {cond} THEN list_append(labels, r.label) ELSE labels END,
  CASE WHEN {cond} THEN list_append(ws, r.w) ELSE ws END FROM {t} JOIN o r ON r.i = {t}.i + 1 WHERE n < {wanted}"""

    return f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT vec_id, label, {_SIGNS} AS w, row_number() OVER (ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS i FROM embeddings),
a(i, n, ids, labels, ws) AS (SELECT 0::BIGINT, 0, []::BIGINT[], []::INT[], []::UBIGINT[] UNION ALL {step(f'({capped} AND {new})', 'a')}),
b(i, n, ids, labels, ws) AS (SELECT * FROM (SELECT 0::BIGINT, n, ids, labels, ws FROM a ORDER BY i DESC LIMIT 1)
  UNION ALL {step(f'({capped} AND NOT list_contains(ids, r.vec_id))', 'b')})
SELECT unnest(ids) AS vec_id, unnest(range(1, len(ids) + 1)) AS place FROM (SELECT ids FROM b ORDER BY i DESC LIMIT 1)"""


_SITES = f"""
WITH m AS (SELECT DISTINCT {_TIDY} AS s FROM final_model_feature_matrix WHERE {_TIDY} IS NOT NULL), e AS {_sites_sql('m', 's')}
SELECT label, product, parent, site FROM e QUALIFY row_number() OVER (PARTITION BY label, product ORDER BY parent, site) = 1"""
SQL = {
    "a14_nearest": _PAIRS
    + """SELECT query_id, row_id AS nearest_id, round(similarity, 6) AS max_similarity, mean_similarity, n_compared FROM (
  SELECT *, round(avg(similarity) OVER (PARTITION BY query_id), 6) AS mean_similarity, count(similarity) OVER (PARTITION BY query_id) AS n_compared,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, row_id) AS k FROM pairs) WHERE k = 1""",
    "a17_similarity_bands": _PAIRS
    + """SELECT query_id, count_if(similarity >= 0.85)::BIGINT AS n_85, count_if(similarity >= 0.70 AND similarity < 0.85)::BIGINT AS n_70,
  count_if(similarity >= 0.55 AND similarity < 0.70)::BIGINT AS n_55, count_if(similarity < 0.55)::BIGINT AS n_below FROM pairs GROUP BY 1""",
    "f25_window": _PAIRS + "SELECT query_id, row_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity BETWEEN 0.55 AND 0.95",
    "j12_max_to_reference": _PAIRS
    + """SELECT row_id, query_id AS reference_id, round(similarity, 6) AS similarity FROM pairs
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC NULLS LAST, query_id) = 1""",
    "m01_loo_mean": _loo_sql(_FM, "canonical_smiles"),
    "m01_loo_mean_molecule": _loo_sql(_MOLECULES, "molecule"),
    "m07_memoriser": _memoriser_sql(_FM, "canonical_smiles"),
    "m07_memoriser_molecule": _memoriser_sql(_MOLECULES, "molecule"),
    "a11_metrics": """
WITH p AS (SELECT nullif(upper(regexp_replace(primary_parent_id, '[^A-Za-z0-9]', '', 'g')), '') AS k, n_unique_methods, pred_pIC50 AS p FROM lead_selection_relaxed_pool
  WHERE pred_pIC50 IS NOT NULL AND NOT pred_pIC50::VARCHAR = 'nan'),
r AS (SELECT n_unique_methods, target_pIC50 AS y, p FROM p JOIN ranked_compounds ON k = nullif(upper(regexp_replace(representative_id, '[^A-Za-z0-9]', '', 'g')), '') WHERE target_pIC50 IS NOT NULL)
SELECT n_unique_methods, count(*) AS n, round(avg(abs(y - p)), 10) AS mae, round(sqrt(avg((y - p) * (y - p))), 10) AS rmse,
  round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 10) AS r2 FROM r GROUP BY 1""",
    "m05_neighbours": f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % {EVERY} = 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, e.label, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i]))) AS s
  FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS place, round(s, 5) AS squared, label FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) <= 5""",
    "m10_tanimoto_mean": f"""
WITH e AS (SELECT vec_id, label, {_SIGNS} AS w FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, e.label, bit_count(q.w & e.w)::DOUBLE / nullif(bit_count(q.w) + bit_count(e.w) - bit_count(q.w & e.w), 0) AS s
  FROM e q JOIN e ON q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, row_id) <= 5)
SELECT query_id, round(sum((s + 1e-8) * label) / sum(s + 1e-8), 6) AS prediction FROM t GROUP BY 1""",
    "j15_within_radius": _near_sql(f"AND q.vec_id % {EVERY} = 0"),
    "j15_within_radius_all": _near_sql(""),
    "d02_diverse": _diverse_sql(12, 2, 0.45, 3),
    "d03_diverse_capped": _diverse_sql(30, 3, 0.40, 4),
    "d04_diverse_uncapped": _diverse_sql(30, None, 0.35, 4),
    "g10_pivot": """
SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS most_a, max(l_quantity) FILTER (l_returnflag = 'N') AS most_n, max(l_quantity) FILTER (l_returnflag = 'R') AS most_r FROM lineitem GROUP BY 1""",
    "e08_site_transforms": _SITES,
    "o02_sorted_library": f"SELECT row_number() OVER (ORDER BY label, product) AS place, product, label || '_at_' || site AS label FROM ({_SITES})",
    "e16_levels": _levels_sql(2),
    "e16_levels_all": _levels_sql(3),
}
#: Models are fitted in several passes, which SQL cannot say; they are tested on held-out molecules.
WITHOUT_SQL = ["m12_grouped_ridge", "m02_grid", "m06_forest", "m13_ranked_fit", "m14_consensus", "m15_scored_pool", "m16_importances"]
QUERIES = {k: globals()[k] for k in [*SQL, *WITHOUT_SQL]}
