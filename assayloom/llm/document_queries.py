"""Queries of problems 7, 8 and 9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.containers import fill_containers, token_counts
from assayloom.llm.leaks import leaks
from assayloom.llm.spans import links, pairs_sharing, shared_parts
from assayloom.shared import stored, table


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, whole or in pieces, in a container of each capacity."""
    counts = stored(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    packed = fill_containers(counts, table(spark, sf_dir, "container_sizes"))
    return packed.select("size_id", "container_id", "doc_id", "piece", "first_token", "n_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed = p7_packed(spark, sf_dir).where(F.col("container_id").isNotNull())
    sizes = table(spark, sf_dir, "container_sizes").select("size_id", F.col("n_tokens").alias("capacity"))
    sums = packed.groupBy("size_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(sizes, "size_id").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


def p7_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_packed, by capacity: every text is there, none is cut that would fit, every capacity has the same tokens of a text,
    no container is overfull, and there are hardly more containers than the tokens need (3 percent and one)."""
    packed = stored(p7_packed(spark, sf_dir), "packed")
    sizes = table(spark, sf_dir, "container_sizes").select("size_id", F.col("n_tokens").alias("capacity"))
    texts = packed.groupBy("size_id", "doc_id").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("pieces"))
    uneven = texts.groupBy("doc_id").agg((F.min("total") < F.max("total")).alias("uneven"))
    texts = texts.join(uneven, "doc_id").join(F.broadcast(sizes), "size_id").groupBy("size_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("total") <= F.col("capacity"))).alias("n_cut"), F.count_if("uneven").alias("n_uneven")
    )
    filled = packed.where("container_id IS NOT NULL").groupBy("size_id", "container_id").agg(F.sum("n_tokens").alias("filled")).join(F.broadcast(sizes), "size_id")
    filled = filled.groupBy("size_id", "capacity").agg(F.count_if(F.col("filled") > F.col("capacity")).alias("n_overfull"), F.count(F.lit(1)).alias("n"), F.sum("filled").alias("tokens"))
    tight = F.col("n") <= F.ceil(F.col("tokens") / (0.97 * F.col("capacity"))) + 1
    return texts.join(filled, "size_id").select("size_id", "n_texts", "n_cut", "n_uneven", "n_overfull", tight.alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "eval_items"), "item_id").select("doc_id", "item_id")


def p8_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item with the documents that leak it: how many, and the most of its passages found in one of them."""
    items = table(spark, sf_dir, "eval_items")
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", items, "item_id")
    by_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_passages").alias("most_passages"))
    return items.select("item_id", "suite", "lang").join(by_item, "item_id", "left").fillna(0, ["n_docs", "most_passages"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_sharing(table(spark, sf_dir, "documents"), "doc_id")


def p9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that shares a stretch: its class (the least of its copies), the copies and the number of other texts it shares with."""
    return links(table(spark, sf_dir, "documents"), "doc_id")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in others."""
    return shared_parts(table(spark, sf_dir, "documents"), "doc_id")


_GRAMS = """
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT side, id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_passages FROM g d JOIN g i ON d.gram = i.gram AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)"""
SQL = {
    "p7_sound": "SELECT size_id, (SELECT count(*) FROM documents) AS n_texts, 0::BIGINT AS n_cut, 0::BIGINT AS n_uneven, 0::BIGINT AS n_overfull, TRUE AS tight FROM container_sizes",
    "p8_found": _GRAMS + "SELECT doc_id, item_id FROM f",
    "p8_by_item": _GRAMS
    + """SELECT item_id, suite, lang, coalesce(n_docs, 0) AS n_docs, coalesce(most_passages, 0) AS most_passages FROM eval_items
LEFT JOIN (SELECT item_id, count(*) AS n_docs, max(n_passages) AS most_passages FROM f GROUP BY 1) USING (item_id)""",
    "p9_found": """
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_links": """
WITH t AS (SELECT min(doc_id) AS class_id, text, count(*) AS n_copies FROM documents WHERE length(text) >= 300 GROUP BY text),
w AS (SELECT DISTINCT class_id, md5(substr(text, i, 300)) AS h FROM (SELECT class_id, text, unnest(range(1, length(text) - 298)) AS i FROM t)),
l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n_links FROM w a JOIN w b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY 1)
SELECT doc_id, t.class_id, n_copies, coalesce(n_links, 0) AS n_links FROM documents JOIN t USING (text) LEFT JOIN l ON l.class_id = t.class_id
WHERE n_copies > 1 OR n_links > 0""",
    "p9_shared": """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))),
g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)
SELECT doc_id, any_value(length(text)) AS n_chars, count_if(before IS NULL OR i > before + 300) AS n_spans,
  sum(CASE WHEN before IS NULL THEN 300 ELSE least(300, i - before) END)::BIGINT AS shared_chars,
  round(sum(CASE WHEN before IS NULL THEN 300 ELSE least(300, i - before) END) / any_value(length(text)), 6) AS share
FROM g JOIN documents USING (doc_id) GROUP BY doc_id""",
}
QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_sound": p7_sound, "p8_found": p8_found, "p8_by_item": p8_by_item, "p9_found": p9_found, "p9_links": p9_links, "p9_shared": p9_shared}
