"""Model grids, saved models and their scores, over data whose labels follow from two features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.operators import models as M

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(3)
    frame = pd.DataFrame(rnd.normal(size=(240, 3)), columns=FEATURES)
    frame["label"] = 5 + frame["x"] - 0.5 * frame["y"] + rnd.normal(size=240) * 0.05
    frame.loc[::40, "z"], frame.loc[7, "label"] = np.nan, np.nan
    return spark.createDataFrame(frame.assign(row_id=range(240), molecule=[i // 2 for i in range(240)])).repartition(3)


def test_the_grid_is_evaluated_on_groups_held_out(spark, rows):
    models = {M.BASELINE: None, "weak": M.elastic(5.0, 0.5), "strong": M.elastic(0.001, 0.2)}
    out = M.held_out(rows, FEATURES, "label", F.col("molecule"), models).toPandas()
    assert len(out) == 3 * 239 and not out["prediction"].isna().any() and set(out.groupby("model")["row_id"].nunique()) == {239}
    board = M.leaderboard(spark.createDataFrame(out)).collect()
    assert [r.place for r in board] == [1, 2, 3] and board[0].model == "strong" and board[0].r2 > 0.95
    assert [r.mae for r in board] == sorted(r.mae for r in board)


def test_equal_errors_go_by_name(spark):
    rows = [(m, 1.0, p) for m in "cab" for p in (0.0, 2.0)]
    board = M.leaderboard(spark.createDataFrame(rows, "model string, actual double, prediction double")).collect()
    assert [r.model for r in board] == ["a", "b", "c"]


def test_a_saved_model_scores_as_the_fitted_one(spark, rows):
    model = M.fitted(rows, FEATURES, "label", M.forest(20, 5))
    path = M.saved(model, rows, "test")
    training = rows.where("label IS NOT NULL")
    new = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, float("nan")), (3, 9.0, 9.0, 9.0)], "row_id long, x double, y double, z double")
    got = {r.row_id: r for r in M.scored(new, path, FEATURES, training).collect()}
    want = {r.row_id: r.prediction for r in model.transform(new).collect()}
    assert {k: r.prediction for k, r in got.items()} == want
    assert got[3].distance > 5 > 1 > got[1].distance and got[2].distance is not None
    assert got[1].ic50_um == pytest.approx(10 ** (6 - got[1].prediction))
    assert M.scored(new.limit(0), path, FEATURES, training).count() == 0
