"""Queries of problem 5 over the fingerprint bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.llm.similar_sets import pairs_between, similar_classes, similar_pairs
from assayloom.shared import stored, table

SIMILAR = 0.8
BITS = [f"fp_{i}" for i in range(512)]


def bit_sets(df: DataFrame, row_id: str, bits: list[str]) -> DataFrame:
    """(rec_id, tokens): the places of the bits that are 1, ascending. A null bit is not set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.stack([batch.column(b).fill_null(0).to_numpy(zero_copy_only=False) == 1 for b in bits], axis=1)
            ends = np.concatenate(([0], np.cumsum(on.sum(axis=1)))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(on)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(row_id), tokens], ["rec_id", "tokens"])

    return df.select(row_id, *bits).mapInArrow(run, "rec_id long, tokens array<int>")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = bit_sets(table(spark, sf_dir, "feature_set_morgan_512"), "row_id", BITS)
    return similar_pairs(sets, SIMILAR).select(F.col("rec_id_a").alias("row_id_a"), F.col("rec_id_b").alias("row_id_b"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fingerprint: its class (the least row of the same set), the copies and the number of similar other classes."""
    sets = bit_sets(table(spark, sf_dir, "feature_set_morgan_512"), "row_id", BITS)
    pairs, members = similar_classes(sets, SIMILAR)
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("class_a").alias("class")).unionByName(pairs.select(F.col("class_b").alias("class")))
    links = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "class", "left").select(F.col("rec_id").alias("row_id"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _runs(rows: DataFrame, rec_id: str, text: str) -> DataFrame:
    """(rec_id, tokens): the different runs of four characters of a text; a shorter one is one run. Null and blank texts have none."""
    t = E.tidy(text)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 3))
    runs = F.array_distinct(F.transform(at, lambda i: F.substr(t, i, F.lit(4))))
    return rows.where(t.isNotNull()).select(F.col(rec_id).cast("long").alias("rec_id"), runs.alias("tokens"))


def p5_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw_compounds and of the feature matrix whose SMILES have at least 0.8 of their runs of four characters in common."""
    raw = _runs(table(spark, sf_dir, "raw_compounds"), "row_id", "smiles")
    rows = _runs(table(spark, sf_dir, "final_model_feature_matrix"), "row_id", "canonical_smiles")
    found = pairs_between(raw, rows, SIMILAR)
    return found.select(F.col("rec_id_a").alias("raw_row_id"), F.col("rec_id_b").alias("row_id"), F.round("similarity", 6).alias("similarity"))


_TIDY = r"nullif(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_RUNS = "list_distinct(list_transform(range(1, greatest(1, length(s) - 3) + 1), lambda i: substr(s, i, 4)))"
_SETS = "WITH s AS (SELECT row_id, (" + " || ".join(f"(coalesce({b}, 0) = 1)::INT::VARCHAR" for b in BITS) + ")::BIT AS bits FROM feature_set_morgan_512),"
_SETS += f" n AS (SELECT *, bit_count(bits) AS n FROM s WHERE bit_count(bits) > 0), c AS (SELECT min(row_id) AS class, bits, any_value(n) AS n FROM n GROUP BY bits),"
_SETS += f""" l AS (SELECT a.class AS x, b.class AS y FROM c a JOIN c b ON a.class <> b.class AND a.n >= {SIMILAR} * b.n AND b.n >= {SIMILAR} * a.n
 AND 10 * bit_count(a.bits & b.bits) >= 8 * (a.n + b.n - bit_count(a.bits & b.bits)))"""
SQL = {
    "p5_between": f"""
WITH u AS (SELECT s, {_RUNS} AS x FROM (SELECT DISTINCT {_TIDY.format('smiles')} AS s FROM raw_compounds) WHERE s IS NOT NULL),
v AS (SELECT s, {_RUNS} AS y FROM (SELECT DISTINCT {_TIDY.format('canonical_smiles')} AS s FROM final_model_feature_matrix) WHERE s IS NOT NULL),
l AS (SELECT u.s AS a, v.s AS b, len(x) + len(y) AS n, len(list_intersect(x, y)) AS c FROM u JOIN v ON len(x) >= 0.8 * len(y) AND len(y) >= 0.8 * len(x))
SELECT r.row_id AS raw_row_id, f.row_id, round(c / (n - c), 6) AS similarity
FROM l JOIN raw_compounds r ON a = {_TIDY.format('r.smiles')} JOIN final_model_feature_matrix f ON b = {_TIDY.format('f.canonical_smiles')} WHERE 10 * c >= 8 * (n - c)""",
    "p5_found": _SETS
    + """ SELECT p.row_id AS row_id_a, q.row_id AS row_id_b FROM l JOIN c a ON l.x = a.class JOIN c b ON l.y = b.class JOIN n p ON p.bits = a.bits JOIN n q ON q.bits = b.bits
 WHERE p.row_id < q.row_id UNION ALL SELECT p.row_id, q.row_id FROM n p JOIN n q ON p.bits = q.bits AND p.row_id < q.row_id""",
    "p5_links": _SETS + " SELECT row_id, class AS class_id, (SELECT count(*) FROM l WHERE l.x = class) AS n_links FROM n JOIN c USING (bits)",
}
QUERIES = {"p5_found": p5_found, "p5_links": p5_links, "p5_between": p5_between}
