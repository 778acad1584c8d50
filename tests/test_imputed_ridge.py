import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.operators.regress import grouped_ridge, ridge
from assayloom.plans.model_queries import m12_grouped_ridge


def test_rows_with_unknown_features_are_fitted_and_predicted(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(300, 3)) * [1, 10, 0.1] + [5, 0, 2]
    y = x @ [1.0, 0.2, -3.0] + rnd.normal(size=300) * 0.1
    x[rnd.random(x.shape) < 0.2] = np.nan
    rows = [(i, f"g{i % 41}", *[None if np.isnan(v) and i % 2 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (999, "g1", 1.0, 1.0, 1.0, None)], "i long, g string, a double, b double, c double, y double").repartition(5)
    out = grouped_ridge(df, F.col("g"), ["a", "b", "c"], "y", [0.5, 5.0], folds=4).toPandas()
    assert len(out) == 600 and out["prediction"].notna().all()
    cols = ["a", "b", "c"]
    for (f, alpha), part in out.groupby(["fold", "alpha"]):
        rest = out[(out["fold"] != f) & (out["alpha"] == alpha)]
        fill = {c: np.sort(rest[c].dropna())[int(np.ceil(rest[c].count() / 2)) - 1] for c in cols}
        z = np.column_stack((np.ones(len(rest)), rest[cols].fillna(fill), rest["y"]))
        want = np.column_stack((np.ones(len(part)), part[cols].fillna(fill))) @ ridge(z.T @ z, alpha)
        assert np.allclose(part["prediction"], want)


def test_m12_counts_every_row_with_a_label_and_a_molecule(spark, tmp_path):
    rnd = np.random.default_rng(8)
    frame = pd.DataFrame(rnd.normal(size=(200, 17)), columns=E.DESCRIPTORS)
    frame.loc[::3, "tpsa"] = np.nan
    frame["balaban"] = np.nan
    frame = frame.assign(row_id=range(200), canonical_smiles=[f"C{i // 2}" if i else None for i in range(200)], pIC50=[np.nan if i == 9 else 5 + i / 100 for i in range(200)])
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/final_model_feature_matrix.parquet")
    assert [r.n for r in m12_grouped_ridge(spark, str(tmp_path)).collect()] == [198] * 3
