"""Queries of problems 1 and 2 over the compound tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.spelling import canonical_sql
from assayloom.llm.bundles import Bundle, Dependency, Level, best_record, best_rows
from assayloom.llm.spellings import collapse, copies, tagged_parts
from assayloom.shared import table

TABLES = {"raw_compounds": "smiles", "final_model_feature_matrix": "canonical_smiles"}


def id_key(c: str) -> Column:
    """Upper case letters and digits only; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def label_trust() -> list[Level]:
    """Measured before assigned before codes without meaning; then the latest report, in microseconds from the year 1 of its own clock."""
    return [
        (F.when(F.col("ic50") > 0, 2).when(F.col("ic50").isin(0, -1), 1).otherwise(0), 1),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '0001-01-01 00:00:00', reported_at)"), 18),
    ]


HAS_POTENCY = lambda: F.col("pIC50").isNotNull() & ~F.isnan("pIC50")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field is a bundle of its own and no rule ties them: rows of one group name one compound, so that any choice of rows is
    consistent. The root of the search, each field's most trusted row, is the answer; nothing is branched."""
    rows = table(spark, sf_dir, "raw_compounds")
    fields = [Bundle("id", ("id",)), Bundle("pIC50", ("pIC50",), HAS_POTENCY()), Bundle("ic50", ("ic50",))]
    best = best_rows(rows, id_key("id"), fields, label_trust(), "row_id").where(F.col("n_rows") >= 2)
    cases = F.explode(F.array(*[F.struct(F.lit(b.name).alias("field_name"), F.col(b.name).alias("row_id")) for b in fields]))
    return best.select("id_key", cases.alias("x")).select("id_key", "x.*").where(F.col("row_id").isNotNull())


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per compound: id and SMILES from one row; the label code must determine the potency (pIC50 = 9 - log10 of nM)."""
    rows = table(spark, sf_dir, "raw_compounds").withColumn("id_key", id_key("id"))
    code = F.col("ic50")
    expected = F.when(code > 0, F.round(9 - F.log10(code.cast("double")), 1)).when(code == 0, 4.5).when(code == -1, 3.0)
    bundles = [Bundle("identity", ("id", "smiles")), Bundle("label", ("ic50",)), Bundle("potency", ("pIC50",), HAS_POTENCY())]
    rule = Dependency("label", "potency", expected, F.round("pIC50", 1))
    best = best_record(rows, F.col("id_key"), bundles, label_trust(), "row_id", [rule])
    return best.select(
        "id_key", "n_rows", "identity.id", "identity.smiles", F.col("identity.row_id").alias("identity_row_id"), "label.ic50",
        F.col("label.row_id").alias("label_row_id"), "potency.pIC50", F.col("potency.row_id").alias("potency_row_id"),
    )


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, value) of both tables, each value with its table's name, so that one dictionary serves both."""
    rows = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "row_id", F.concat(F.lit(f"{t}\0"), c).alias("value")) for t, c in TABLES.items()]
    return rows[0].unionByName(rows[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(_spelled(spark, sf_dir), "row_id", "value", ["table_name"], parts=tagged_parts)
    return found.select("table_name", "first_row_id", "row_id")


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per molecule and table, with its number of copies and of spellings."""
    found = collapse(_spelled(spark, sf_dir), "row_id", "value", parts=tagged_parts)
    named = F.split("value", "\0", 2)
    return found.select(named[0].alias("table_name"), "first_row_id", named[1].alias("smiles"), "copies", "spellings")


_COPIES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, row_id, {c} AS raw, k FROM (SELECT row_id, {c}, {canonical_sql(c)} AS k FROM {t}) WHERE k <> ''" for t, c in TABLES.items()
)
_KEY = "nullif(upper(regexp_replace(id, '[^A-Za-z0-9]', '', 'g')), '')"
SQL = {
    "p1_found": f"""
WITH r AS (
  SELECT {_KEY} AS id_key, *, CASE WHEN ic50 > 0 THEN 0 WHEN ic50 IN (0, -1) THEN 1 ELSE 2 END AS class FROM raw_compounds
), g AS (SELECT * FROM r WHERE id_key IS NOT NULL AND id_key IN (SELECT id_key FROM r GROUP BY 1 HAVING count(*) > 1)),
c AS (
  SELECT id_key, 'id' AS field_name, row_id, class, reported_at FROM g WHERE id IS NOT NULL
  UNION ALL SELECT id_key, 'pIC50', row_id, class, reported_at FROM g WHERE pIC50 IS NOT NULL AND NOT pIC50::VARCHAR = 'nan'
  UNION ALL SELECT id_key, 'ic50', row_id, class, reported_at FROM g WHERE ic50 IS NOT NULL)
SELECT id_key, field_name, row_id FROM c
QUALIFY row_number() OVER (PARTITION BY id_key, field_name ORDER BY class, reported_at DESC NULLS LAST, row_id) = 1""",
    "p1_consistent": f"""
WITH r AS (
  SELECT {_KEY} AS id_key, *, CASE WHEN ic50 > 0 THEN 0 WHEN ic50 IN (0, -1) THEN 1 ELSE 2 END AS class,
    CASE WHEN ic50 > 0 THEN round(9 - log10(ic50), 1) WHEN ic50 = 0 THEN 4.5 WHEN ic50 = -1 THEN 3.0 END AS expected
  FROM raw_compounds
), o AS (
  SELECT *, coalesce(epoch_us(reported_at), -99999999999999999999::HUGEINT)::HUGEINT AS stamp FROM r WHERE id_key IS NOT NULL
), n AS (SELECT id_key, count(*) AS n_rows FROM o GROUP BY 1),
i AS (SELECT * FROM o WHERE id IS NOT NULL OR smiles IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_key ORDER BY class, stamp DESC, row_id) = 1),
l AS (SELECT id_key, row_id, ic50, expected, 2 - class AS t1, stamp AS t2 FROM o WHERE ic50 IS NOT NULL
      UNION ALL SELECT id_key, NULL, NULL, NULL, -1000, 0 FROM n),
p AS (SELECT id_key, row_id, pIC50, round(pIC50, 1) AS k, 2 - class AS t1, stamp AS t2 FROM o WHERE pIC50 IS NOT NULL AND NOT pIC50::VARCHAR = 'nan'
      UNION ALL SELECT id_key, NULL, NULL, NULL, -1000, 0 FROM n),
b AS (
  SELECT l.id_key, l.row_id AS label_row_id, l.ic50, p.row_id AS potency_row_id, p.pIC50 FROM l JOIN p ON l.id_key = p.id_key AND coalesce(l.expected = p.k, TRUE)
  QUALIFY row_number() OVER (PARTITION BY l.id_key ORDER BY l.t1 + p.t1 DESC, l.t2 + p.t2 DESC, coalesce(l.row_id, 0) + coalesce(p.row_id, 0), l.row_id IS NULL) = 1)
SELECT n.id_key, n.n_rows, i.id, i.smiles, i.row_id AS identity_row_id, b.ic50, b.label_row_id, b.pIC50, b.potency_row_id
FROM n JOIN b USING (id_key) LEFT JOIN i USING (id_key)""",
    "p2_found": f"""
SELECT * FROM (SELECT table_name, min(row_id) OVER (PARTITION BY table_name, k) AS first_row_id, row_id FROM ({_COPIES})) WHERE row_id <> first_row_id""",
    "p2_collapsed": f"""
WITH v AS (SELECT table_name, k, raw, count(*) AS n, min(row_id) AS first FROM ({_COPIES}) GROUP BY ALL)
SELECT table_name, min(first) AS first_row_id, max({{'n': n, 'raw': raw}}).raw AS smiles, sum(n)::BIGINT AS copies, count(*) AS spellings FROM v GROUP BY table_name, k""",
}
QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent, "p2_found": p2_found, "p2_collapsed": p2_collapsed}
