"""Joins, aggregates, ranks and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.operators.curate import LINEAGE, consolidate, group_values, lineage
from assayloom.operators.packed import unpack
from assayloom.operators.portfolio import greedy_portfolio
from assayloom.operators.ranking import capped, first_by, ranked
from assayloom.operators.skew import salted_lookup
from assayloom.plans.packed_queries import values_sql
from assayloom.shared import shared_folder, stored, table
from assayloom.sources.readers import read_csv, read_smiles_list, write_csv, write_matrix
from assayloom.streaming.rolling import append_closed, drain, windowed_counts

POOL = "lead_selection_relaxed_pool"
r6 = lambda c: F.round(c, 6)


def s01_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back by schema, with the required columns checked."""
    raw = table(spark, sf_dir, "raw_compounds").select("row_id", "id", "pIC50", "ic50", "lab")
    raw = raw.withColumn("id", E.tidy("id"))  # whitespace at the ends and empty strings do not survive CSV
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(raw, path)
    return E.without_nan(read_csv(spark, path, raw.schema, ["id", "pIC50", "ic50"]))


def a01_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_compounds")
    out = consolidate(raw, E.key_of("id"), "pIC50", "ic50", "row_id")
    return out.withColumn("target", r6("target")).withColumnRenamed("key", "id_key")


def a01_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each compound's rows hold: its spellings and values, joined, the first row's spelling, and which kinds of label occur."""
    return group_values(table(spark, sf_dir, "raw_compounds"), E.key_of("id"), "id", "pIC50", "ic50", "row_id").withColumnRenamed("key", "id_key")


def a02_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's first row and parent, and the parents, methods and transforms of all its rows: distinct, sorted, joined and counted."""
    pool = table(spark, sf_dir, POOL).where("product_smiles IS NOT NULL")
    rows = pool.select("row_id", "product_smiles", F.col("primary_parent_id").alias("parent"), F.col("is_original_positive").alias("is_original"))
    return lineage(unpack(pool, "row_id", list(LINEAGE)), rows, "product_smiles")


def a03_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products of each method."""
    pool = table(spark, sf_dir, POOL).select("row_id", "product_smiles", "methods")
    values = unpack(pool, "row_id", ["methods"]).select("row_id", F.col("value").alias("method"))
    return values.join(pool.select("row_id", "product_smiles"), "row_id").groupBy("method").agg(F.count_distinct("product_smiles").alias("n_products"), F.count(F.lit(1)).alias("n_uses"))


def a04_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, POOL).withColumn("parent", E.key_of("primary_parent_id"))
    return pool.groupBy("parent").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("product_smiles").alias("n_products"), F.count_distinct("scaffold").alias("n_scaffolds"))


def a06_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each scaffold; null is a value."""
    return table(spark, sf_dir, POOL).groupBy("scaffold").agg(F.count(F.lit(1)).alias("n_rows"))


def a09_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_compounds").withColumn("k", E.key_of("id")).withColumn("v", E.known("pIC50"))
    by_key = raw.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ic50") > 0).alias("m"), F.count_if(F.col("ic50").isin(0, -1)).alias("a"), F.min("v").alias("low"), F.max("v").alias("high"))
    named = F.col("k").isNotNull()
    return by_key.agg(
        F.sum("n").alias("n_rows"), F.count_if(named).alias("n_compounds"), F.count_if(named & (F.col("n") > 1)).alias("n_duplicate_groups"), F.sum("m").alias("n_measured"),
        F.sum("a").alias("n_assigned"), F.count_if(named & (F.col("low") < F.col("high"))).alias("n_conflicts"),
    )


def a10_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose SMILES occurs more than once, all copies: the counts are aggregated and looked up, hot values spread."""
    rows = table(spark, sf_dir, "raw_compounds").select("row_id", "smiles")
    counts = rows.where("smiles IS NOT NULL").groupBy("smiles").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return salted_lookup(rows, counts, "smiles", "row_id").select("row_id", F.col("n_rows").alias("n_copies"))


def a12_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent scaffold of each number of unique methods; the smallest of equals."""
    counts = table(spark, sf_dir, POOL).where("scaffold IS NOT NULL").groupBy("n_unique_methods", "scaffold").agg(F.count(F.lit(1)).alias("n"))
    return first_by(counts, ["n_unique_methods"], F.struct(-F.col("n"), F.col("scaffold")), ["scaffold", "n"])


def a13_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the two largest prices, the largest and the smallest of each order; the two are found without gathering an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    two = capped(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2, "l_linenumber").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("m"))
    ends = lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("largest"), F.min("l_extendedprice").alias("smallest"))
    return ends.join(two, "l_orderkey").select("l_orderkey", r6("m").alias("top_two_mean"), "largest", "smallest")


def a15_best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event of largest value, the first of equals."""
    return first_by(table(spark, sf_dir, "events"), ["user_id"], F.struct(-F.col("value"), F.col("event_id")), ["event_id", "event_type", "value"])


def a18_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.known("pIC50")
    by = table(spark, sf_dir, "raw_compounds").groupBy(F.coalesce(F.signum(F.col("ic50").cast("double")), F.lit(9.0)).cast("long").alias("label"))
    return by.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min(x).alias("low"), F.max(x).alias("high"), r6(F.avg(x)).alias("mean"), r6(F.median(x)).alias("median"))


def j01_parents_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranked compound with what the pool made of it: the pool is aggregated before the join."""
    made = table(spark, sf_dir, POOL).groupBy(E.key_of("primary_parent_id").alias("k")).agg(F.count(F.lit(1)).alias("n_products"), r6(F.max(E.known("pred_pIC50"))).alias("best"))
    parents = table(spark, sf_dir, "ranked_compounds").withColumn("k", E.key_of("representative_id"))
    return parents.join(made, "k", "left").select("representative_id", "target_pIC50", F.coalesce("n_products", F.lit(0)).cast("long").alias("n_products"), "best")


def j03_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def j04_parent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with its parent's activity; products of one parent can be a third of all rows, so the lookup is spread."""
    pool = table(spark, sf_dir, POOL).select("row_id", E.key_of("primary_parent_id").alias("k"))
    parents = table(spark, sf_dir, "ranked_compounds").select(E.key_of("representative_id").alias("k"), "target_pIC50", "n_measured_rows")
    counted = pool.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).join(parents, "k")
    return salted_lookup(pool, counted, "k", "row_id").select("row_id", "target_pIC50", (F.col("n_measured_rows") > 0).alias("parent_measured"), F.col("n_rows").alias("n_siblings"))


def j05_one_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that cannot fan out: the right side is made unique first (latest report of each SMILES)."""
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1900-01-01 00:00:00', reported_at)")  # of its own clock, whatever the session's zone
    latest = F.struct(-F.coalesce(since, F.lit(0)), F.col("row_id"))
    right = first_by(table(spark, sf_dir, "raw_compounds").where("smiles IS NOT NULL"), ["smiles"], latest, ["row_id", "lab"]).withColumnRenamed("row_id", "raw_row_id")
    left = table(spark, sf_dir, "final_model_feature_matrix").select("row_id", F.col("canonical_smiles").alias("smiles"))
    return left.join(right, "smiles", "left").select("row_id", "raw_row_id", "lab")


def j07_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames matched by their rows' places, which are made explicit in both."""
    a = ranked(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": True, "s_suppkey": False}, "place")
    b = ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": True, "c_custkey": False}, "place")
    return a.join(b, "place").select("place", "s_suppkey", "c_custkey")


def f22_without_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders (anti join)."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def w01_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranked(orders, {"o_totalprice": True, "o_orderkey": False})


def o05_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 products of highest score (the report's length)."""
    pool = table(spark, sf_dir, POOL).select("row_id", "product_smiles", E.known("orthogonal_composite_score").alias("score"))
    return pool.orderBy(F.desc_nulls_last("score"), "row_id").limit(12)


def o08_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 products of each scaffold, in the order of their score."""
    pool = table(spark, sf_dir, POOL).select("row_id", "scaffold", E.known("pred_pIC50").alias("score"))
    return capped(pool, ["scaffold"], [F.desc_nulls_last("score"), F.asc("row_id")], 40, "row_id").select("row_id", "scaffold")


def u01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool and ranked compounds as one table of lineage, counted by method."""
    pool = table(spark, sf_dir, POOL).select(F.col("product_smiles").alias("smiles"), F.lit("pool").alias("method"))
    originals = table(spark, sf_dir, "ranked_compounds").select(F.col("canonical_smiles").alias("smiles"), F.lit("original_positive").alias("method"))
    return pool.unionByName(originals).groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("smiles").alias("n_smiles"))


def u04_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each (product, primary parent)."""
    return first_by(table(spark, sf_dir, POOL), ["product_smiles", "primary_parent_id"], F.col("row_id"), ["row_id"])


def d01_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 leads in the order of score: at most 2 of a parent and 2 of a scaffold; new scaffolds first, the rest filled in order."""
    pool = table(spark, sf_dir, POOL).select("row_id", "scaffold", E.key_of("primary_parent_id").alias("parent"), E.known("orthogonal_composite_score").alias("score"))
    chosen = greedy_portfolio(pool, [("score", True), ("row_id", False)], 40, {"scaffold": 2, "parent": 2}, spread="scaffold")
    return chosen.select("row_id", "place")


def d05_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 backups from what the primary portfolio left, with a cap on parents alone."""
    pool = stored(table(spark, sf_dir, POOL).select("row_id", E.key_of("primary_parent_id").alias("parent"), E.known("orthogonal_composite_score").alias("score")), "pool")
    order = [("score", True), ("row_id", False)]
    primary = greedy_portfolio(pool, order, 20, {"parent": 2})
    backup = greedy_portfolio(pool.join(F.broadcast(primary.select("row_id")), "row_id", "left_anti"), order, 20, {"parent": 3})  # 20 rows
    return primary.select("row_id", "place", F.lit("primary").alias("part")).unionByName(backup.select("row_id", "place", F.lit("backup").alias("part")))


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "row_id", "product_smiles", "scaffold", E.key_of("primary_parent_id").alias("parent"), E.known("orthogonal_composite_score").alias("score")
    return stored(table(spark, sf_dir, POOL).select(*columns), "pool")


def _mode(df: DataFrame, column: str) -> list:
    """The most frequent value, the smallest of equals; none of an empty frame. One row reaches the driver."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), column).limit(1).collect()]


def _not_taken(pool: DataFrame, primary: DataFrame) -> DataFrame:
    """Rows of other products than the chosen ones, of which there are a few."""
    rest = pool.join(F.broadcast(primary.select("row_id")), "row_id", "left_anti")
    return rest.join(F.broadcast(primary.select("product_smiles")), "product_smiles", "left_anti")


def _parts(primary: DataFrame, backup: DataFrame) -> DataFrame:
    return primary.select("row_id", "place", F.lit("primary").alias("part")).unionByName(backup.select("row_id", "place", F.lit("backup").alias("part")))


def d01_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 leads in the order of score, without the products of the ranked compounds: at most 4 of the pool's most frequent scaffold, any
    number of the others, and 2 of a parent; new scaffolds first, the rest filled in order."""
    known = table(spark, sf_dir, "ranked_compounds").select(F.col("canonical_smiles").alias("product_smiles"))
    pool = _leads(spark, sf_dir).join(known, "product_smiles", "left_anti")
    chosen = greedy_portfolio(pool, [("score", True), ("row_id", False)], 40, {"scaffold": 4, "parent": 2}, spread="scaffold", only={"scaffold": _mode(pool, "scaffold")})
    return chosen.select("row_id", "place")


def d06_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 primary leads with at most 4 of the most frequent scaffold, and 6 backups of other products and of other parents than the one most
    frequent among the primary; where there are no such rows, of any parent."""
    pool, order = _leads(spark, sf_dir), [("score", True), ("row_id", False)]
    primary = stored(greedy_portfolio(pool, order, 8, {"scaffold": 4}, spread="scaffold", only={"scaffold": _mode(pool, "scaffold")}), "primary")
    others = pool.where(~F.coalesce(F.col("parent").isin(_mode(primary, "parent")), F.lit(False)))
    source = pool if others.isEmpty() else others
    return _parts(primary, greedy_portfolio(_not_taken(source, primary), order, 6, {}, spread="scaffold"))


def d05_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 primary leads, at most 2 of a parent and 2 of a scaffold, and 6 backups of other products, at most 2 of a parent; in both, new
    scaffolds first, the rest filled in order."""
    pool, order = _leads(spark, sf_dir), [("score", True), ("row_id", False)]
    primary = stored(greedy_portfolio(pool, order, 8, {"scaffold": 2, "parent": 2}, spread="scaffold"), "primary")
    return _parts(primary, greedy_portfolio(_not_taken(pool, primary), order, 6, {"parent": 2}, spread="scaffold"))


def f22_backup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows whose product is none of an original positive's (anti membership); rows without a product stay."""
    pool = table(spark, sf_dir, POOL).select("row_id", "product_smiles", "is_original_positive")
    taken = pool.where("is_original_positive AND product_smiles IS NOT NULL").select("product_smiles").distinct()
    return pool.join(taken, "product_smiles", "left_anti").select("row_id")


def f02_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds with a measured row or one that is active without a number."""
    groups = group_values(table(spark, sf_dir, "raw_compounds"), E.key_of("id"), "id", "pIC50", "ic50", "row_id")
    return groups.where("has_measured OR has_active_unmeasured").select(F.col("key").alias("id_key"), "has_measured")


def j09_rank_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pool row with its parent's rank and prediction, null where the parent is not ranked. The ranks are a fixed small table, which the
    optimizer broadcasts by its size."""
    ranks = table(spark, sf_dir, "ranked_compounds").select(E.key_of("representative_id").alias("k"), F.col("rank").alias("parent_rank"), "full_fit_prediction")
    pool = table(spark, sf_dir, POOL).select("row_id", E.key_of("primary_parent_id").alias("k"))
    return pool.join(ranks, "k", "left").select("row_id", "parent_rank", "full_fit_prediction")


def k02_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each alert count and number of rule violations, written as a matrix with row labels and read back."""
    pool = table(spark, sf_dir, POOL).select(F.coalesce(F.col("pains_brenk_alerts").cast("string"), F.lit("none")).alias("alerts"), F.coalesce(F.col("lipinski_violations").cast("string"), F.lit("none")).alias("v"))
    cells = pool.groupBy("alerts", F.concat(F.lit("v"), "v").alias("violations")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    write_matrix(cells, "alerts", "violations", "n", path)
    wide = spark.read.option("header", True).csv(path)
    columns = [c for c in wide.columns if c != "alerts"]
    long = wide.select("alerts", F.explode(F.array(*[F.struct(F.lit(c).alias("violations"), F.col(c).try_cast("long").alias("n")) for c in columns])).alias("x"))
    return long.select("alerts", "x.*").where("n IS NOT NULL")


def s09_smiles_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix's SMILES written as lists, blank ones as blank lines, and read back: lines and different strings."""
    lines = table(spark, sf_dir, "final_model_feature_matrix").select(F.coalesce(E.tidy("canonical_smiles"), F.lit("")).alias("value"))
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    lines.write.text(path)
    got = read_smiles_list(spark, path)
    return got.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("smiles").alias("n_smiles"), F.count_distinct("file", "name").alias("n_names"))


def k03_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a folder for each lab; a filter on the lab then reads that folder alone."""
    raw = table(spark, sf_dir, "raw_compounds").select("row_id", "pIC50", F.coalesce("lab", F.lit("none")).alias("lab"))
    path = f"{shared_folder(spark)}/by-lab-{uuid.uuid4().hex}"
    raw.repartition("lab", F.pmod(F.xxhash64("row_id"), F.lit(8))).write.partitionBy("lab").parquet(path)
    return E.without_nan(spark.read.parquet(path).where("lab IN ('lumia_hts', 'none')")).select("row_id", "lab", "pIC50")


def a08_similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the stated similarity to known compounds, by number of methods. The median is exact over four decimals."""
    s = E.known("max_similarity_to_existing")
    by = table(spark, sf_dir, POOL).groupBy("n_unique_methods")
    return by.agg(F.count(s).alias("n"), r6(F.avg(s)).alias("mean"), r6(F.median(s)).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"))


def f26_best_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent's product of highest score, the smallest row of equals: an aggregate, however many products a parent has."""
    pool = table(spark, sf_dir, POOL).select("row_id", E.key_of("primary_parent_id").alias("parent"), E.known("orthogonal_composite_score").alias("score"))
    return first_by(pool.where("parent IS NOT NULL AND score IS NOT NULL"), ["parent"], F.struct(-F.col("score"), F.col("row_id")), ["row_id", "score"])


def j02_feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors with what the pool knows of the same molecule beside them; the pool is one row per molecule before the join."""
    known = table(spark, sf_dir, POOL).where("product_smiles IS NOT NULL").groupBy(F.col("product_smiles").alias("s")).agg(r6(F.avg(E.known("qed"))).alias("qed"), F.count(F.lit(1)).alias("n"))
    left = table(spark, sf_dir, "final_model_feature_matrix").select("row_id", E.tidy("canonical_smiles").alias("s"), E.known("mw").alias("mw"))
    return left.join(known, "s", "left").select("row_id", "mw", "qed", F.coalesce("n", F.lit(0)).cast("long").alias("n_in_pool"))


def j18_of_measured_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose parent has a measured row (semi join)."""
    measured = table(spark, sf_dir, "ranked_compounds").where("n_measured_rows > 0").select(E.key_of("representative_id").alias("k"))
    return table(spark, sf_dir, POOL).select("row_id", E.key_of("primary_parent_id").alias("k")).join(measured, "k", "left_semi").select("row_id")


def x01_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: rows, sum and largest value of each six hours and type."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(spark, windowed_counts(events, "ts", ["event_type"], "value", "6 hours", "1 hour"), "events")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream whose windows of six hours and type are appended once they are closed, an hour after their end."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = append_closed(spark, windowed_counts(events, "ts", ["event_type"], "value", "6 hours", "1 hour"), f"{shared_folder(spark)}/closed-{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


_KEY = "nullif(upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"
_ID, _PARENT = _KEY.format("id"), _KEY.format("primary_parent_id")
_NAN = "CASE WHEN {0}::VARCHAR = 'nan' THEN NULL ELSE {0} END"
_CLEAN = "regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"


def _greedy(name: str, source: str, wanted: int, parent: int | None = None, scaffold: int | None = None, spread: bool | None = None, dominant: str | None = None) -> str:
    """The greedy choice in SQL: rows in order, one recursion step each, the chosen ones in lists. dominant: the one scaffold that has a cap."""
    spread = bool(scaffold) if spread is None else spread
    caps = f"len(list_filter(parents, lambda v: v IS NOT DISTINCT FROM r.parent)) < {parent}" if parent else "TRUE"
    if scaffold:
        cap = f"len(list_filter(scaffolds, lambda v: v IS NOT DISTINCT FROM r.scaffold)) < {scaffold}"
        caps += f" AND (r.scaffold IS DISTINCT FROM {dominant} OR {cap})" if dominant else f" AND {cap}"
    new = " AND (n < 3 OR len(list_filter(scaffolds, lambda v: v IS NOT DISTINCT FROM r.scaffold)) = 0)" if spread else ""
    take = f"(n < {wanted} AND {caps}{{0}})"
    columns = "i, n, ids, parents, scaffolds"

    def step(cond: str) -> str:
        return (
            f"SELECT r.i, n + {cond}::INT, CASE WHEN {cond} THEN list_append(ids, r.row_id) ELSE ids END, CASE WHEN {cond} THEN list_append(parents, r.parent) ELSE parents END,"
            f" CASE WHEN {cond} THEN list_append(scaffolds, r.scaffold) ELSE scaffolds END"
        )

    first = f"""{name}_a({columns}) AS (SELECT 0::BIGINT, 0, []::BIGINT[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL {step(take.format(new))} FROM {name}_a JOIN {source} r ON r.i = {name}_a.i + 1 WHERE n < {wanted})"""
    if not spread:
        return first + f", {name} AS (SELECT ids, parents FROM {name}_a ORDER BY i DESC LIMIT 1)"
    fresh = take.format("")[:-1] + " AND NOT list_contains(ids, r.row_id))"
    return first + f""", {name}_b({columns}) AS (SELECT * FROM (SELECT 0::BIGINT, n, ids, parents, scaffolds FROM {name}_a ORDER BY i DESC LIMIT 1)
  UNION ALL {step(fresh)} FROM {name}_b JOIN {source} r ON r.i = {name}_b.i + 1 WHERE n < {wanted}), {name} AS (SELECT ids, parents FROM {name}_b ORDER BY i DESC LIMIT 1)"""


def _behind(where: str) -> str:
    """What is left of the ordered rows, numbered anew."""
    return f"rest AS MATERIALIZED (SELECT * EXCLUDE (i), row_number() OVER (ORDER BY i) AS i FROM o WHERE NOT list_contains((SELECT ids FROM g), row_id) AND {where})"


_PARTS = """SELECT unnest(ids) AS row_id, unnest(range(1, len(ids) + 1)) AS place, 'primary' AS part FROM g
UNION ALL SELECT unnest(ids), unnest(range(1, len(ids) + 1)), 'backup' FROM h"""
_MODE = "(SELECT scaffold FROM o WHERE scaffold IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, scaffold LIMIT 1)"
_TAKEN = "product_smiles IS NULL OR product_smiles NOT IN (SELECT product_smiles FROM o WHERE product_smiles IS NOT NULL AND list_contains((SELECT ids FROM g), row_id))"


_ORDERED = f"""SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, row_id) AS i FROM (
  SELECT row_id, product_smiles, scaffold, {_PARENT} AS parent, {_NAN.format('orthogonal_composite_score')} AS score FROM lead_selection_relaxed_pool)"""
_OF = "(SELECT array_to_string(list_sort(list(DISTINCT value)), ';') AS {0}, count(DISTINCT value) AS {1}, product_smiles FROM v WHERE field_name = '{0}' GROUP BY product_smiles)"
SQL = {
    "a02_lineage": f"""
WITH p AS (SELECT row_id, product_smiles, primary_parent_id, is_original_positive FROM lead_selection_relaxed_pool WHERE product_smiles IS NOT NULL),
v AS (SELECT product_smiles, field_name, value FROM ({values_sql(list(LINEAGE))}) JOIN p USING (row_id)),
f AS (SELECT product_smiles, min(row_id) AS first_row, arg_min_null(primary_parent_id, row_id) AS first_parent, count(*) AS n_rows, bool_or(is_original_positive) AS is_original FROM p GROUP BY 1)
SELECT f.*, {', '.join(f'{c}, coalesce({n}, 0) AS {n}' for c, n in LINEAGE.items())} FROM f {' '.join(f'LEFT JOIN {_OF.format(c, n)} USING (product_smiles)' for c, n in LINEAGE.items())}""",
    "a03_by_method": f"""
SELECT value AS method, count(DISTINCT product_smiles) AS n_products, count(*) AS n_uses
FROM ({values_sql(['methods'])}) JOIN lead_selection_relaxed_pool USING (row_id) GROUP BY 1""",
    "s01_csv_round_trip": f"SELECT row_id, nullif({_CLEAN}, '') AS id, {_NAN.format('pIC50')} AS pIC50, ic50, lab FROM raw_compounds",
    "a01_consolidated": f"""
WITH r AS (SELECT {_ID} AS id_key, pIC50 AS v, coalesce(ic50 > 0, false) AS m, row_id FROM raw_compounds WHERE pIC50 IS NOT NULL AND NOT pIC50::VARCHAR = 'nan')
SELECT id_key, round(coalesce(median(v) FILTER (m), median(v)), 6) AS target, count(DISTINCT v) > 1 AS has_conflict, count(*) AS n_rows, count_if(m)::BIGINT AS n_measured,
  count_if(NOT m)::BIGINT AS n_assigned, min(row_id) AS first_row,
  CASE WHEN count_if(m) = 0 THEN 'assigned_median' WHEN count_if(m) < count(*) THEN 'mixed_duplicate_measured_median' ELSE 'measured_median' END AS origin
FROM r WHERE id_key IS NOT NULL GROUP BY id_key""",
    "a01_group_values": f"""
WITH r AS (SELECT {_ID} AS id_key, id, {_NAN.format('pIC50')} AS v, ic50 AS c, row_id FROM raw_compounds WHERE {_ID} IS NOT NULL)
SELECT id_key, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT id)), ';') AS compound_ids, arg_min_null(id, row_id) AS first_id,
  array_to_string(list_transform(list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)), lambda x: format('{{:.4g}}', x)), ';') AS pic50_values,
  array_to_string(list_transform(list_sort(list(DISTINCT c) FILTER (c IS NOT NULL)), lambda x: format('{{:.4g}}', x::DOUBLE)), ';') AS ic50_values,
  coalesce(bool_or(c > 0), false) AS has_measured, coalesce(bool_or(c = 0), false) AS has_active_unmeasured, coalesce(bool_or(c = -1), false) AS has_inactive
FROM r GROUP BY 1""",
    "a04_by_parent": f"SELECT {_PARENT} AS parent, count(*) AS n_rows, count(DISTINCT product_smiles) AS n_products, count(DISTINCT scaffold) AS n_scaffolds FROM lead_selection_relaxed_pool GROUP BY 1",
    "a06_value_counts": "SELECT scaffold, count(*) AS n_rows FROM lead_selection_relaxed_pool GROUP BY 1",
    "a09_summary": f"""
WITH r AS (SELECT {_ID} AS k, ic50, {_NAN.format('pIC50')} AS v FROM raw_compounds), g AS (SELECT k, count(*) AS n, count(DISTINCT v) AS d FROM r WHERE k IS NOT NULL GROUP BY k)
SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM g) AS n_compounds, (SELECT count(*) FROM g WHERE n > 1) AS n_duplicate_groups,
  (SELECT count_if(ic50 > 0)::BIGINT FROM r) AS n_measured, (SELECT count_if(ic50 IN (0, -1))::BIGINT FROM r) AS n_assigned, (SELECT count(*) FROM g WHERE d > 1) AS n_conflicts""",
    "a10_duplicated": "SELECT row_id, n_copies FROM (SELECT row_id, count(*) OVER (PARTITION BY smiles) AS n_copies FROM raw_compounds WHERE smiles IS NOT NULL) WHERE n_copies > 1",
    "a12_mode": """
SELECT n_unique_methods, scaffold, n FROM (SELECT n_unique_methods, scaffold, count(*) AS n FROM lead_selection_relaxed_pool WHERE scaffold IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY n_unique_methods ORDER BY n DESC, scaffold) = 1""",
    "a13_top_two": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS k FROM lineitem)
SELECT l_orderkey, round(avg(l_extendedprice) FILTER (k <= 2), 6) AS top_two_mean, max(l_extendedprice) AS largest, min(l_extendedprice) AS smallest FROM r GROUP BY 1""",
    "a15_best_event": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS FIRST, event_id) = 1",
    "a18_profile": f"""
SELECT coalesce(sign(ic50), 9)::BIGINT AS label, count(*) AS n_rows, count(DISTINCT id) AS n_ids, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(median(v), 6) AS median
FROM (SELECT *, {_NAN.format('pIC50')} AS v FROM raw_compounds) GROUP BY 1""",
    "j01_parents_of_pool": f"""
WITH m AS (SELECT {_PARENT} AS k, count(*) AS n, round(max({_NAN.format('pred_pIC50')}), 6) AS best FROM lead_selection_relaxed_pool GROUP BY 1)
SELECT representative_id, target_pIC50, coalesce(n, 0) AS n_products, best FROM ranked_compounds LEFT JOIN m ON k = {_KEY.format('representative_id')}""",
    "j03_orders_of_customers": "SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "j04_parent_activity": f"""
WITH p AS (SELECT row_id, {_PARENT} AS k FROM lead_selection_relaxed_pool)
SELECT row_id, target_pIC50, n_measured_rows > 0 AS parent_measured, count(*) OVER (PARTITION BY k) AS n_siblings FROM p JOIN ranked_compounds ON k = {_KEY.format('representative_id')}""",
    "j05_one_row_per_key": """
WITH r AS (SELECT smiles, row_id AS raw_row_id, lab FROM raw_compounds WHERE smiles IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY smiles ORDER BY coalesce(reported_at, TIMESTAMP '1900-01-01') DESC, row_id) = 1)
SELECT row_id, raw_row_id, lab FROM final_model_feature_matrix LEFT JOIN r ON smiles = canonical_smiles""",
    "j07_by_position": """
WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
SELECT place, s_suppkey, c_custkey FROM a JOIN b USING (place)""",
    "f22_without_products": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "w01_rank": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "o05_top": f"SELECT row_id, product_smiles, {_NAN.format('orthogonal_composite_score')} AS score FROM lead_selection_relaxed_pool ORDER BY score DESC NULLS LAST, row_id LIMIT 12",
    "o08_capped": f"""
SELECT row_id, scaffold FROM lead_selection_relaxed_pool
QUALIFY row_number() OVER (PARTITION BY scaffold ORDER BY {_NAN.format('pred_pIC50')} DESC NULLS LAST, row_id) <= 40""",
    "u01_union": """
SELECT method, count(*) AS n_rows, count(DISTINCT smiles) AS n_smiles FROM (
  SELECT product_smiles AS smiles, 'pool' AS method FROM lead_selection_relaxed_pool UNION ALL SELECT canonical_smiles, 'original_positive' FROM ranked_compounds) GROUP BY 1""",
    "u04_first_wins": "SELECT product_smiles, primary_parent_id, min(row_id) AS row_id FROM lead_selection_relaxed_pool GROUP BY ALL",
    "d01_portfolio": f"""
WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}), {_greedy('g', 'o', 40, 2, 2)} SELECT unnest(ids) AS row_id, unnest(range(1, len(ids) + 1)) AS place FROM g""",
    "d05_backup": f"""
WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}), {_greedy('g', 'o', 20, 2)},
  rest AS MATERIALIZED (SELECT * EXCLUDE (i), row_number() OVER (ORDER BY i) AS i FROM o WHERE NOT list_contains((SELECT ids FROM g), row_id)), {_greedy('h', 'rest', 20, 3)}
SELECT unnest(ids) AS row_id, unnest(range(1, len(ids) + 1)) AS place, 'primary' AS part FROM g UNION ALL SELECT unnest(ids), unnest(range(1, len(ids) + 1)), 'backup' FROM h""",
    "d01_dominant": f"""
WITH RECURSIVE o AS MATERIALIZED ({_ORDERED} WHERE product_smiles IS NULL OR product_smiles NOT IN (SELECT canonical_smiles FROM ranked_compounds WHERE canonical_smiles IS NOT NULL)),
  {_greedy('g', 'o', 40, 2, 4, dominant=_MODE)} SELECT unnest(ids) AS row_id, unnest(range(1, len(ids) + 1)) AS place FROM g""",
    "d05_split": f"""
WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}), {_greedy('g', 'o', 8, 2, 2)}, {_behind(f'({_TAKEN})')}, {_greedy('h', 'rest', 6, 2, spread=True)} {_PARTS}""",
    "d06_robust": f"""
WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}), {_greedy('g', 'o', 8, None, 4, dominant=_MODE)},
  d AS (SELECT p FROM (SELECT unnest(parents) AS p FROM g) WHERE p IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p LIMIT 1),
  {_behind(f'({_TAKEN}) AND (parent IS DISTINCT FROM (SELECT p FROM d) OR NOT EXISTS (SELECT 1 FROM o WHERE parent IS DISTINCT FROM (SELECT p FROM d)))')},
  {_greedy('h', 'rest', 6, spread=True)} {_PARTS}""",
    "f22_backup_source": """
SELECT row_id FROM lead_selection_relaxed_pool WHERE product_smiles IS NULL
  OR product_smiles NOT IN (SELECT product_smiles FROM lead_selection_relaxed_pool WHERE is_original_positive AND product_smiles IS NOT NULL)""",
    "f02_positives": f"""
SELECT id_key, bool_or(c > 0) AS has_measured FROM (SELECT {_ID} AS id_key, coalesce(ic50, -9) AS c FROM raw_compounds WHERE {_ID} IS NOT NULL) GROUP BY 1 HAVING bool_or(c >= 0)""",
    "j09_rank_of_parent": f"""
SELECT row_id, rank AS parent_rank, full_fit_prediction FROM lead_selection_relaxed_pool LEFT JOIN ranked_compounds ON {_PARENT} = {_KEY.format('representative_id')}""",
    "k02_matrix": """
SELECT coalesce(pains_brenk_alerts::VARCHAR, 'none') AS alerts, 'v' || coalesce(lipinski_violations::VARCHAR, 'none') AS violations, count(*) AS n FROM lead_selection_relaxed_pool GROUP BY 1, 2""",
    "s09_smiles_list": f"""
SELECT count(*) AS n_lines, count(DISTINCT s) AS n_smiles, count(*) AS n_names FROM (SELECT {_CLEAN.replace('(id,', '(canonical_smiles,')} AS s FROM final_model_feature_matrix) WHERE s <> ''""",
    "k03_partitioned": f"SELECT row_id, coalesce(lab, 'none') AS lab, {_NAN.format('pIC50')} AS pIC50 FROM raw_compounds WHERE lab = 'lumia_hts' OR lab IS NULL",
    "a08_similarity_stats": f"""
SELECT n_unique_methods, count(s) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, min(s) AS least, max(s) AS most
FROM (SELECT n_unique_methods, {_NAN.format('max_similarity_to_existing')} AS s FROM lead_selection_relaxed_pool) GROUP BY 1""",
    "f26_best_of_parent": f"""
SELECT parent, row_id, score FROM (SELECT row_id, {_PARENT} AS parent, {_NAN.format('orthogonal_composite_score')} AS score FROM lead_selection_relaxed_pool)
WHERE parent IS NOT NULL AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY score DESC, row_id) = 1""",
    "j02_feature_union": f"""
WITH p AS (SELECT product_smiles AS s, round(avg({_NAN.format('qed')}), 6) AS qed, count(*) AS n FROM lead_selection_relaxed_pool GROUP BY 1)
SELECT row_id, {_NAN.format('mw')} AS mw, p.qed, coalesce(n, 0) AS n_in_pool FROM final_model_feature_matrix LEFT JOIN p ON s = {_CLEAN.replace('(id,', '(canonical_smiles,')}""",
    "j18_of_measured_parents": f"""
SELECT row_id FROM lead_selection_relaxed_pool WHERE {_PARENT} IN (SELECT {_KEY.format('representative_id')} FROM ranked_compounds WHERE n_measured_rows > 0)""",
    "stream_closed_windows": """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n_rows, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2
HAVING window_start + INTERVAL 6 HOURS <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
    "x01_stream_windows": """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n_rows, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2""",
}
QUERIES = {k: globals()[k] for k in SQL}
