"""Tanimoto and vector neighbours of a stated set of queries, in blocks of bounded size, against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at once; more are taken block after block.
QUERY_BLOCK = 4_096


def words(df: DataFrame, row_id: str, bits: list[str]) -> DataFrame:
    """(row_id, words): 0/1 columns packed into 64-bit words; a null bit is not set. Columns of a batch are packed as one matrix, which is
    many times cheaper than an expression of hundreds of terms a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.stack([batch.column(b).fill_null(0).to_numpy(zero_copy_only=False) == 1 for b in bits], axis=1)
            on = np.pad(on, ((0, 0), (0, -len(bits) % 64)))
            flat = np.packbits(on, axis=1, bitorder="little").view("<i8")
            ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], ["row_id", "words"])

    return df.select(row_id, *bits).mapInArrow(run, "row_id long, words array<long>")


def sign_words(vector: str, dims: int) -> Column:
    """Fingerprint of a vector: bit i is set where its i-th value is above 0."""
    bit = lambda i: F.shiftleft((F.coalesce(F.get(F.col(vector), i), F.lit(0.0)) > 0).cast("long"), i % 64)
    return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(k, min(k + 64, dims))]) for k in range(0, dims, 64)])


def ones(packed: str | Column, n_words: int) -> Column:
    packed = F.col(packed) if isinstance(packed, str) else packed
    return reduce(lambda a, b: a + b, [F.bit_count(packed[i]) for i in range(n_words)]).cast("long")


def tanimoto(a: str, b: str, n_words: int, n_a: str, n_b: str) -> Column:
    """Shared over either; null where both are empty."""
    both = reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseAND(F.col(b)[i])) for i in range(n_words)])
    return F.try_divide(both.cast("double"), F.col(n_a) + F.col(n_b) - both)


def blocks(queries: DataFrame, query_id: str, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in hashed parts of about `size` rows."""
    n = max(1, -(-queries.count() // size))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == k) for k in range(n)]


def against_all(queries: DataFrame, rows: DataFrame, n_words: int) -> DataFrame:
    """(query_id, row_id, similarity) of fingerprints (query_id, words) and (row_id, words), the same id left out. Each block of queries is
    broadcast; rows are never exchanged. Meant to be aggregated or filtered at once."""
    target = rows.select("row_id", F.col("words").alias("_b"), ones("words", n_words).alias("_nb"))
    out = []
    for block in blocks(queries, "query_id"):
        q = block.select("query_id", F.col("words").alias("_a"), ones("words", n_words).alias("_na"))
        pairs = target.join(F.broadcast(q), F.col("query_id") != F.col("row_id"))
        out.append(pairs.select("query_id", "row_id", tanimoto("_a", "_b", n_words, "_na", "_nb").alias("similarity")))
    return reduce(DataFrame.unionByName, out)


def nearest(pairs: DataFrame) -> DataFrame:
    """Per query: the nearest row (smallest id of equals), its similarity, and the mean and number of all."""
    best = F.max(F.struct("similarity", (-F.col("row_id")).alias("_id")))
    found = pairs.groupBy("query_id").agg(best.alias("_best"), F.avg("similarity").alias("mean_similarity"), F.count("similarity").alias("n_compared"))
    return found.select("query_id", (-F.col("_best._id")).alias("nearest_id"), F.col("_best.similarity").alias("max_similarity"), "mean_similarity", "n_compared")


def vector_neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, place, squared) of the k rows (row_id, vector) nearest to each query (query_id, vector) by squared distance, the
    same id left out, ties to the smallest id. A partition returns k rows per query; vectors are compared as blocks of matrices."""
    spark = rows.sparkSession
    out = []
    for block in blocks(queries, "query_id", QUERY_BLOCK):
        own = block.select("query_id", "vector").toPandas()  # QUERY_BLOCK rows
        if own.empty:
            continue
        shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), np.stack(own["vector"]).astype(np.float64)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: pd.DataFrame | None = None
            for batch in batches:
                for at in range(0, len(batch), 2_000):
                    part = batch.iloc[at : at + 2_000]
                    x = np.stack(part["vector"]).astype(np.float64)
                    squared = ((x * x).sum(1)[None, :] + (q * q).sum(1)[:, None] - 2 * q @ x.T).clip(min=0)
                    own_ids = part["row_id"].to_numpy()
                    squared[ids[:, None] == own_ids[None, :]] = np.inf
                    order = np.lexsort((np.broadcast_to(own_ids, squared.shape), squared), axis=1)[:, :k]
                    new = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "row_id": own_ids[order].ravel(), "squared": np.take_along_axis(squared, order, 1).ravel()})
                    new = new[np.isfinite(new["squared"])]
                    best = new if best is None else pd.concat([best, new])
                    best = best.sort_values(["query_id", "squared", "row_id"]).groupby("query_id").head(k)
            if best is not None:
                yield best

        out.append(rows.select("row_id", "vector").mapInPandas(scan, "query_id long, row_id long, squared double"))
    if not out:
        return rows.select(F.col("row_id").alias("query_id"), "row_id", F.lit(1).alias("place"), F.lit(0.0).alias("squared")).where(F.lit(False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("squared", "row_id"))
    return reduce(DataFrame.unionByName, out).withColumn("place", place).where(F.col("place") <= k)
