"""Labels, scores, funnels and pools over the compound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.functions import smiles as S
from assayloom.operators.funnel import funnel_counts, survivors
from assayloom.shared import table

POOL = "lead_selection_relaxed_pool"
HIGH = ["HIA_Hou", "Bioavailability_Ma", "Solubility_AqSolDB"]
LOW = ["AMES", "hERG", "ClinTox", "DILI"]


def r6(c):
    return F.round(c, 6)


def expr_p03_label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_compounds")
    flags = E.label_flags(F.col("ic50"))
    origin = F.when(flags["is_measured"], "measured").when(flags["is_active_unmeasured"], "active_no_ic50").when(flags["is_inactive"], "inactive")
    return raw.select("row_id", E.tidy("id").alias("source_id"), E.number("pIC50").alias("pic50"), *[v.alias(k) for k, v in flags.items()], origin.alias("label_origin"))


def expr_p06_four_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_compounds")
    return raw.select("row_id", E.four_digits(E.known("pIC50")).alias("pic50_text"), E.four_digits(F.col("ic50").cast("double")).alias("ic50_text"))


def expr_p07_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, POOL)
    tests = [E.known("mw") > 500, E.known("logp") > 5, E.known("hbd") > 5, E.known("hba") > 10]
    return pool.select("row_id", E.violations(*tests).alias("n_violations"), (E.violations(*tests) == F.col("lipinski_violations")).alias("as_stated"))


def expr_p08_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, POOL)
    both = E.beside(pool, E.population(pool, ["qed", "AMES"]))
    return both.select("row_id", r6(E.higher("qed")).alias("qed_norm"), r6(E.lower("AMES")).alias("ames_norm"), r6(E.closeness("tpsa", 90.0, 40.0)).alias("tpsa_close"))


def expr_p08_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised within each lab: the group statistics are aggregated first and joined back."""
    raw = E.without_nan(table(spark, sf_dir, "raw_compounds").select("row_id", "lab", "pIC50")).where("pIC50 IS NOT NULL")
    stats = raw.groupBy("lab").agg(F.min("pIC50").alias("min_pIC50"), F.max("pIC50").alias("max_pIC50"))
    return raw.join(stats, "lab").select("row_id", r6(E.higher("pIC50")).alias("norm"))


def expr_p11_micromolar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, POOL).select("row_id", F.round(E.micromolar(E.known("pred_pIC50")), 4).alias("ic50_um"))


def expr_p26_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole per cents of a similarity rounded half to even, beside half up."""
    cents = F.round(E.known("max_similarity_to_existing") * 1000) / 10
    return table(spark, sf_dir, POOL).select("row_id", F.bround(cents).alias("half_even"), F.round(cents).alias("half_up"))


def expr_p13_row_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [E.known(c) for c in ("chi0v", "chi1v", "chi2v", "kappa1")]
    return table(spark, sf_dir, POOL).select("row_id", r6(E.row_mean(cols)).alias("mean"), r6(E.row_spread(cols)).alias("spread"))


def expr_p14_training_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the pool's products to the population of the feature matrix."""
    stats = E.population(table(spark, sf_dir, "final_model_feature_matrix"), E.DESCRIPTORS)
    return E.beside(table(spark, sf_dir, POOL), stats).select("row_id", r6(E.distance_to_training(E.DESCRIPTORS)).alias("distance"))


def expr_p19_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of terms normalised over the whole pool; a product with a missing term has no score."""
    pool = table(spark, sf_dir, POOL)
    both = E.beside(pool, E.population(pool, [*HIGH, *LOW, "qed", "pred_pIC50", "max_similarity_to_existing"]))
    admet = E.weighted(*[(1 / 7, E.higher(c)) for c in HIGH], *[(1 / 7, E.lower(c)) for c in LOW])
    shape = [E.closeness("mw", 400.0, 150.0), E.closeness("logp", 3.0, 2.0), E.closeness("tpsa", 90.0, 45.0), E.closeness("rot", 5.0, 5.0)]
    scored = both.select("row_id", admet.alias("a"), E.weighted(*[(0.2, c) for c in [*shape, E.higher("qed")]]).alias("p"), E.higher("pred_pIC50").alias("q"), E.lower("max_similarity_to_existing").alias("n"))
    total = E.weighted((0.4, F.col("q")), (0.2, F.col("a")), (0.2, F.col("p")), (0.2, F.col("n")))
    return scored.select("row_id", r6("a").alias("admet_score"), r6("p").alias("property_score"), r6(total).alias("composite"))


def expr_p18_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlikeness to known compounds and to references, normalised over the whole pool before any of it is set aside."""
    pool = table(spark, sf_dir, POOL)
    both = E.beside(pool, E.population(pool, ["max_similarity_to_existing", "max_similarity_to_znf_reference"]))
    return both.select("row_id", r6(E.weighted((0.55, E.lower("max_similarity_to_existing")), (0.45, E.lower("max_similarity_to_znf_reference")))).alias("novelty"))


def expr_p25_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three normalised terms: prediction, nearness to the training data and drug-likeness."""
    pool = table(spark, sf_dir, POOL)
    both = E.beside(pool, E.population(pool, ["pred_pIC50", "descriptor_ad_distance", "qed"]))
    return both.select("row_id", r6((E.higher("pred_pIC50") + E.lower("descriptor_ad_distance") + E.higher("qed")) / 3).alias("support"))


def expr_p26_four_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity rounded to four decimals, half to even."""
    return table(spark, sf_dir, POOL).select("row_id", F.bround(E.known("max_similarity_to_existing"), 4).alias("similarity"))


def f24_valid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows whose product is one component without an open site."""
    return table(spark, sf_dir, POOL).where(S.one_molecule(F.col("product_smiles"))).select("row_id")


def stages():
    return [
        ("potency", E.at_least("pred_pIC50", 4.6) & E.at_most("descriptor_ad_distance", 4.5)), ("alerts", F.col("pains_brenk_alerts") == 0),
        ("properties", (F.col("lipinski_violations") <= 1) & F.col("tpsa").between(40, 140) & F.col("mw").between(250, 550) & E.at_most("rot", 10)),
        ("admet", E.at_most("AMES", 0.6) & E.at_most("hERG", 0.7) & E.at_least("HIA_Hou", 0.3)), ("novelty", E.at_most("max_similarity_to_existing", 0.85)),
    ]


def f03_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, POOL)
    return funnel_counts(pool, stages(), "product_smiles")


def f06_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, POOL)
    return survivors(pool, stages()).select("row_id", "product_smiles")


def f21_overlapping_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in pools that overlap: none is the complement of another."""
    reference, existing = E.known("max_similarity_to_znf_reference"), E.known("max_similarity_to_existing")
    tests = {"strict": ~F.col("is_original_positive") & (reference < 0.30) & (existing <= 0.85), "relaxed": reference < 0.35, "set_aside": (reference >= 0.40) | (existing > 0.85) | F.col("is_original_positive")}
    return table(spark, sf_dir, POOL).select("row_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in tests.items()])


def f28_numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown values by column of the feature matrix, in one scan."""
    cols = ["pIC50", *E.DESCRIPTORS]
    sums = table(spark, sf_dir, "final_model_feature_matrix").agg(*[F.count_if(E.known(c).isNull()).alias(c) for c in cols])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_unknown")) for c in cols])).alias("x")).select("x.*")


def c09_smiles_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy atoms, rings, charge, components and heavy weight that can be read off each product's SMILES."""
    s = F.col("product_smiles")
    counts = {"n_heavy": S.heavy_atoms(s), "n_rings": S.rings(s), "charge": S.charge(s), "n_components": S.components(s), "heavy_weight": F.round(S.heavy_weight(s), 3)}
    return table(spark, sf_dir, POOL).where(s.isNotNull()).select("row_id", *[v.alias(k) for k, v in counts.items()])


def _k(c: str) -> str:
    return f"CASE WHEN {c}::VARCHAR = 'nan' THEN NULL ELSE {c} END"


def _higher(c: str, over: str = "") -> str:
    low, high = f"min({c}) OVER ({over})", f"max({c}) OVER ({over})"
    return f"CASE WHEN abs({high} - {low}) <= 1e-9 * greatest(abs({high}), abs({low})) THEN {c} * 0 + 1.0 ELSE ({c} - {low}) / nullif({high} - {low}, 0) END"


def _close(c: str, target: float, tolerance: float) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(0.0, least(1.0, 1 - abs({c} - {target}) / {tolerance})) END"


def _pool(*cols: str) -> str:
    return f"(SELECT * REPLACE ({', '.join(f'{_k(c)} AS {c}' for c in cols)}) FROM lead_selection_relaxed_pool)"


_CHI = ["chi0v", "chi1v", "chi2v", "kappa1"]
_N = "nullif(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _CHI) + ", 0)"
_MEAN = "(" + " + ".join(f"coalesce({c}, 0)" for c in _CHI) + f") / {_N}"
_SCORED = ["mw", "logp", "tpsa", "rot", "qed", "pred_pIC50", "max_similarity_to_existing", *HIGH, *LOW]
_STAGES = [
    "pred_pIC50 >= 4.6 AND descriptor_ad_distance <= 4.5", "pains_brenk_alerts = 0", "lipinski_violations <= 1 AND tpsa BETWEEN 40 AND 140 AND mw BETWEEN 250 AND 550 AND rot <= 10",
    "AMES <= 0.6 AND hERG <= 0.7 AND HIA_Hou >= 0.3", "max_similarity_to_existing <= 0.85",
]
_STAGED = _pool("pred_pIC50", "descriptor_ad_distance", "tpsa", "mw", "rot", "AMES", "hERG", "HIA_Hou", "max_similarity_to_existing")
_Z = [f"((p.{c} - s.{c}_m) / coalesce(nullif(s.{c}_s, 0), 1))" for c in E.DESCRIPTORS]
_ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOSPFIbcnosp]"
SQL = {
    "expr_p03_label_flags": r"""
SELECT row_id, nullif(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS source_id, CASE WHEN pIC50::VARCHAR = 'nan' THEN NULL ELSE pIC50 END AS pic50,
  coalesce(ic50 > 0, false) AS is_measured, coalesce(ic50 = 0, false) AS is_active_unmeasured, coalesce(ic50 = -1, false) AS is_inactive, coalesce(ic50 IN (0, -1), false) AS is_assigned,
  CASE WHEN ic50 > 0 THEN 'measured' WHEN ic50 = 0 THEN 'active_no_ic50' WHEN ic50 = -1 THEN 'inactive' END AS label_origin FROM raw_compounds""",
    "expr_p06_four_digits": f"SELECT row_id, format('{{:.4g}}', {_k('pIC50')}) AS pic50_text, format('{{:.4g}}', ic50::DOUBLE) AS ic50_text FROM raw_compounds",
    "expr_p07_violations": f"""
SELECT row_id, n_violations, n_violations = lipinski_violations AS as_stated FROM (SELECT *, (coalesce(mw > 500, false)::BIGINT + coalesce(logp > 5, false)::BIGINT
  + coalesce(hbd > 5, false)::BIGINT + coalesce(hba > 10, false)::BIGINT) AS n_violations FROM {_pool('mw', 'logp', 'hbd', 'hba')})""",
    "expr_p08_normalize": f"SELECT row_id, round({_higher('qed')}, 6) AS qed_norm, round(1 - ({_higher('AMES')}), 6) AS ames_norm, round({_close('tpsa', 90, 40)}, 6) AS tpsa_close FROM {_pool('qed', 'AMES', 'tpsa')}",
    "expr_p08_per_group": f"SELECT row_id, round({_higher('pIC50', 'PARTITION BY lab')}, 6) AS norm FROM raw_compounds WHERE lab IS NOT NULL AND pIC50 IS NOT NULL AND NOT pIC50::VARCHAR = 'nan'",
    "expr_p11_micromolar": f"SELECT row_id, round(power(10, 6 - pred_pIC50), 4) AS ic50_um FROM {_pool('pred_pIC50')}",
    "expr_p26_half_even": f"""
SELECT row_id, round_even(c, 0) AS half_even, round(c) AS half_up FROM (SELECT row_id, round(max_similarity_to_existing * 1000) / 10 AS c FROM {_pool('max_similarity_to_existing')})""",
    "expr_p13_row_consensus": f"""
SELECT row_id, round(m, 6) AS mean, round(sqrt(({' + '.join(f'coalesce(({c} - m) * ({c} - m), 0)' for c in _CHI)}) / {_N}), 6) AS spread FROM (SELECT *, {_MEAN} AS m FROM {_pool(*_CHI)})""",
    "expr_p14_training_distance": f"""
WITH s AS (SELECT {', '.join(f'avg({_k(c)}) AS {c}_m, stddev_pop({_k(c)}) AS {c}_s' for c in E.DESCRIPTORS)} FROM final_model_feature_matrix)
SELECT row_id, round(sqrt(({' + '.join(f'coalesce({z} * {z}, 0)' for z in _Z)}) / nullif({' + '.join(f'({z} IS NOT NULL)::INT' for z in _Z)}, 0)), 6) AS distance FROM {_pool(*E.DESCRIPTORS)} p, s""",
    "expr_p19_composite": f"""
WITH t AS (SELECT row_id, ({' + '.join(f'({_higher(c)}) / 7' for c in HIGH)} + {' + '.join(f'(1 - ({_higher(c)})) / 7' for c in LOW)}) AS a,
  0.2 * ({_close('mw', 400, 150)} + {_close('logp', 3, 2)} + {_close('tpsa', 90, 45)} + {_close('rot', 5, 5)} + ({_higher('qed')})) AS p,
  {_higher('pred_pIC50')} AS q, 1 - ({_higher('max_similarity_to_existing')}) AS n FROM {_pool(*_SCORED)})
SELECT row_id, round(a, 6) AS admet_score, round(p, 6) AS property_score, round(0.4 * q + 0.2 * a + 0.2 * p + 0.2 * n, 6) AS composite FROM t""",
    "expr_p18_novelty": f"""
SELECT row_id, round(0.55 * (1 - ({_higher('max_similarity_to_existing')})) + 0.45 * (1 - ({_higher('max_similarity_to_znf_reference')})), 6) AS novelty
FROM {_pool('max_similarity_to_existing', 'max_similarity_to_znf_reference')}""",
    "expr_p25_support": f"""
SELECT row_id, round((({_higher('pred_pIC50')}) + 1 - ({_higher('descriptor_ad_distance')}) + ({_higher('qed')})) / 3, 6) AS support FROM {_pool('pred_pIC50', 'descriptor_ad_distance', 'qed')}""",
    "expr_p26_four_decimals": f"SELECT row_id, round_even(max_similarity_to_existing, 4) AS similarity FROM {_pool('max_similarity_to_existing')}",
    "f24_valid_products": """
SELECT row_id FROM lead_selection_relaxed_pool WHERE length(trim(product_smiles)) > 0 AND NOT contains(product_smiles, '.') AND NOT contains(product_smiles, '*')""",
    "f03_funnel_counts": "\nUNION ALL ".join(
        f"SELECT {k}::BIGINT AS ord, '{n}' AS stage, count(DISTINCT product_smiles) AS remaining FROM {_STAGED} WHERE " + (" AND ".join(f"({s})" for s in _STAGES[:k]) or "true")
        for k, n in enumerate(["start", "potency", "alerts", "properties", "admet", "novelty"])
    ),
    "f06_survivors": f"SELECT row_id, product_smiles FROM {_STAGED} WHERE " + " AND ".join(f"({s})" for s in _STAGES),
    "f21_overlapping_pools": f"""
SELECT row_id, coalesce(NOT is_original_positive AND r < 0.30 AND x <= 0.85, false) AS strict, coalesce(r < 0.35, false) AS relaxed,
  coalesce(r >= 0.40 OR x > 0.85 OR is_original_positive, false) AS set_aside
FROM (SELECT *, {_k('max_similarity_to_znf_reference')} AS r, {_k('max_similarity_to_existing')} AS x FROM lead_selection_relaxed_pool)""",
    "f28_numeric_guard": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL OR {c}::VARCHAR = 'nan')::BIGINT AS n_unknown FROM final_model_feature_matrix" for c in ["pIC50", *E.DESCRIPTORS]
    ),
    "c09_smiles_counts": rf"""
WITH s AS (SELECT row_id, product_smiles AS s, regexp_extract_all(product_smiles, '{_ATOM}') AS atoms, regexp_extract_all(product_smiles, '\[[^\]+\-]*([+\-]+\d*)\]', 1) AS marks
  FROM lead_selection_relaxed_pool WHERE product_smiles IS NOT NULL),
e AS (SELECT row_id, sum(w) AS heavy_weight, count(*) AS n, count(w) AS known FROM (
  SELECT row_id, CASE upper(symbol[1]) || symbol[2:] {' '.join(f"WHEN '{k}' THEN {w}" for k, w in S.WEIGHTS.items())} END AS w
  FROM (SELECT row_id, regexp_extract(a, '^\[?\d*(Br|Cl|[A-Z][a-gi-z]?|[a-z])', 1) AS symbol FROM (SELECT row_id, unnest(atoms) AS a FROM s))) GROUP BY row_id),
q AS (SELECT row_id, sum(CASE WHEN m[1] = '-' THEN -z ELSE z END)::BIGINT AS charge FROM (
  SELECT row_id, m, coalesce(try_cast(nullif(regexp_extract(m, '(\d+)$', 1), '') AS INT), length(m)) AS z FROM (SELECT row_id, unnest(marks) AS m FROM s)) GROUP BY row_id)
SELECT row_id, len(list_filter(atoms, lambda a: NOT regexp_matches(a, '^\[\d*H[+\-\d]*\]$'))) AS n_heavy,
  len(regexp_extract_all(regexp_replace(s, '\[[^\]]*\]', '', 'g'), '%\d\d|\d')) // 2 AS n_rings, coalesce(charge, 0) AS charge,
  len(list_filter(string_split(s, '.'), lambda p: p <> '')) AS n_components, CASE WHEN n IS NULL THEN 0.0::DOUBLE WHEN n = known THEN round(heavy_weight::DOUBLE, 3) END AS heavy_weight
FROM s LEFT JOIN e USING (row_id) LEFT JOIN q USING (row_id)""",
}
QUERIES = {k: globals()[k] for k in SQL}
