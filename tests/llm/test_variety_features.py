import numpy as np
from pyspark.sql import functions as F

from assayloom.llm.variety import Masses, gain, text_features, varied_subset


def test_features_far_beyond_a_fixed_vector_do_not_share_mass(spark):
    df = spark.range(120_000).select(F.concat(F.lit("s"), "id").alias("scaffold"), F.lit("CCO").alias("smiles"))
    slots, _ = text_features(F.col("scaffold"), "smiles")
    assert df.select(slots[0].alias("s")).distinct().count() == 120_000


def test_no_gain_is_lost_to_collisions(spark):
    """Records of one feature each, all different: every place gains as much as the first."""
    rows = spark.range(20_000).select(F.col("id").alias("rec_id"), F.array(F.xxhash64("id")).alias("slots"), F.array(F.lit(0.25).cast("float")).alias("weights"))
    got = varied_subset(rows, 3_000).toPandas()
    assert len(got) == 3_000 and np.allclose(got["gain"], 0.5)


def test_masses_are_a_sparse_vector():
    rnd = np.random.default_rng(1)
    dense, mass = np.zeros(400), Masses.none()
    for k in range(60):
        slots, weights = rnd.choice(400, 5, replace=False), rnd.random(5)
        assert abs(gain(mass, slots, weights) - gain(dense, slots, weights)) < 1e-12
        np.add.at(dense, slots, weights)
        mass.add(slots, weights)
        if k % 7 == 0:
            mass = mass.settled()
    assert np.allclose(mass[np.arange(400)], dense)
