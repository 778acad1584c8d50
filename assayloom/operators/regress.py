"""Regression and its evaluation by aggregates: metrics, group means, grouped cross-validation, forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.expr import known
from assayloom.shared import stored


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """mae, rmse, r2 (1 - residual over total sum of squares, null where the total is 0) and n of each group."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    sums = df.where(y.isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_var")
    )
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    return sums.select(*by, "n", "mae", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), r2.alias("r2"))


def loo_means(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, value, n_same, others_mean): distinct values of each key with the mean of the key's other rows; null where there are none.

    Equal rows have equal results, so they stay one row with their number: a hot key is as large as its distinct values.
    """
    counts = df.select(key.alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND value IS NOT NULL").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n_same"))
    sums = counts.groupBy("key").agg(F.sum("n_same").alias("_n"), F.sum(F.col("value") * F.col("n_same")).alias("_s"))
    return counts.join(sums, "key").select("key", "value", "n_same", F.try_divide(F.col("_s") - F.col("value"), F.col("_n") - 1).alias("others_mean"))


def gram(df: DataFrame, fold: str, features: list[str], target: str, fills: dict[int, list[float]]) -> dict[int, np.ndarray]:
    """Z'Z with Z = (1, features, target) of the rows outside each fold, in one pass: a partition returns one small matrix per fold. What is
    unknown is filled with that fold's fills, so a row with an unknown feature counts anew for each fold."""
    size = len(features) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside: dict[int, np.ndarray] = {}
        out = {f: np.zeros((size, size)) for f in fills}
        for batch in batches:
            z = np.column_stack((np.ones(len(batch)), batch[[*features, target]].to_numpy(np.float64)))
            folds, gaps = batch["fold"].to_numpy(), np.isnan(z).any(axis=1)
            for f in np.unique(folds[~gaps]).tolist():
                x = z[~gaps & (folds == f)]
                inside[f] = inside.get(f, 0) + x.T @ x
            for f, fill in fills.items():
                x = z[gaps & (folds != f)]
                x = np.where(np.isnan(x), np.array([1.0, *fill, 0.0]), x)
                out[f] += x.T @ x
        for f in fills:
            out[f] += sum((m for g, m in inside.items() if g != f), np.zeros((size, size)))
        yield pd.DataFrame({"fold": list(out), "m": [m.ravel() for m in out.values()]})

    parts = df.select(F.col(fold).cast("int").alias("fold"), *features, target).mapInPandas(run, "fold int, m array<double>")
    cells = parts.select("fold", F.posexplode("m").alias("i", "x")).groupBy("fold", "i").agg(F.sum("x").alias("x")).collect()  # folds x size ** 2 rows
    sums = {f: np.zeros(size * size) for f in fills}
    for r in cells:
        sums[r.fold][r.i] = r.x
    return {f: m.reshape(size, size) for f, m in sums.items()}


def ridge(z: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and slopes of the ridge regression on standardised features (population deviation) from Z'Z."""
    n = z[0, 0]
    mean = z[0, 1:-1] / n
    scale = np.sqrt(np.maximum(np.diag(z)[1:-1] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    xx = (z[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    xy = (z[1:-1, -1] - mean * z[0, -1]) / scale
    slopes = np.linalg.solve(xx + alpha * np.eye(len(mean)), xy) / scale
    return np.concatenate(([z[0, -1] / n - slopes @ mean], slopes))


def grouped_ridge(df: DataFrame, group: Column, features: list[str], target: str, alphas: list[float], folds: int = 10) -> DataFrame:
    """df's rows with a target, with alpha, fold and prediction, each fold predicted by the model of the others.

    A fold is a hash of the group, so that duplicates of a molecule never meet across folds. Unknown features (null or NaN) are filled with
    the median over the rows that the model is fitted to, 0 where none is known; so every row with a target is predicted. Medians are those of
    percentile_approx (1 / 10,000 of the rows). All models follow from one pass for the medians and one for Z'Z.
    """
    rows = df.withColumns({c: known(c) for c in [*features, target]}).where(F.col(target).isNotNull())
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")), "folds")  # it is read thrice
    others = rows.select("fold", *features).withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_model <> fold")
    medians = others.groupBy("_model").agg(*[F.percentile_approx(c, 0.5).alias(c) for c in features]).collect()  # one row per fold
    fills = {r["_model"]: [0.0 if r[c] is None else r[c] for c in features] for r in medians}
    models = [(f, a, ridge(z, a).tolist(), fills[f]) for f, z in gram(rows, "fold", features, target, fills).items() for a in alphas]
    spark = df.sparkSession
    table = spark.createDataFrame(models, "fold int, alpha double, _weights array<double>, _fills array<double>")  # folds x alphas rows
    x = sum((F.col("_weights")[i + 1] * F.coalesce(F.col(c), F.col("_fills")[i]) for i, c in enumerate(features)), F.col("_weights")[0])
    return rows.join(F.broadcast(table), "fold").withColumn("prediction", x).drop("_weights", "_fills")
