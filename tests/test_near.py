import numpy as np

from assayloom.operators import skew
from assayloom.operators.geometry import within
from assayloom.plans.model_queries import j15_within_radius_all


def test_all_points_are_probes_but_not_of_themselves(spark, tmp_path):
    rnd = np.random.default_rng(3)
    x = rnd.random((300, 3)) - 0.5
    x[7] = x[8]  # equal points of different ids are near each other
    rows = [(i + 5, [*map(float, v), 9.0]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i + 5: (int((r <= 0.1).sum()), r.min()) for i, r in enumerate(d) if (r <= 0.1).any()}
    got = {r.point_id: (r.n_near, r.least) for r in j15_within_radius_all(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and got[12][1] == got[13][1] == 0
    assert all(got[k][0] == n and abs(got[k][1] - least) < 1e-6 for k, (n, least) in want.items())


def test_dense_cells_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_A_TASK", 20)
    rnd = np.random.default_rng(5)
    x = np.concatenate((rnd.random((150, 2)) * 0.09, rnd.random((50, 2))))  # most of them in one cell
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 0.5)], "point_id long, x double, y double")
    got = {r.point_id: r.n_near for r in within(points, points.withColumnRenamed("point_id", "probe_id"), ["x", "y"], 0.1, others=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {i: int((r <= 0.1).sum()) for i, r in enumerate(d) if (r <= 0.1).any()}
