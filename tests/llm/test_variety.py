import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assayloom.llm import variety as V
from assayloom.llm.variety import SLOTS, gain, text_features, varied_subset

SCHEMA = "rec_id long, slots array<int>, weights array<float>"


def records(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        group = 0 if i < n // 3 else rnd.randint(1, 60)  # a third is one group
        runs = sorted({rnd.randint(100, 130) if group == 0 else rnd.randint(100, 900) for _ in range(6)})
        out.append((i, [group, *runs], [0.5] + [0.5 / len(runs)] * len(runs)))
    return out


def greedy(rows, wanted):
    mass, left, total = np.zeros(SLOTS), list(rows), 0.0
    for _ in range(min(wanted, len(rows))):
        best = max(left, key=lambda r: gain(mass, np.array(r[1]), np.array(r[2])))
        total += gain(mass, np.array(best[1]), np.array(best[2]))
        np.add.at(mass, best[1], best[2])
        left.remove(best)
    return total


def test_value_is_near_that_of_exact_greedy(spark):
    rows = records(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", place string").repartition(5)
    got = varied_subset(df, 40).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 41)) and len({r.rec_id for r in got}) == 40
    mass = np.zeros(SLOTS)
    for r in got:
        _, slots, weights = rows[r.rec_id]
        assert abs(gain(mass, np.array(slots), np.array(weights)) - r.gain) < 1e-5
        np.add.at(mass, slots, weights)
    assert sum(r.gain for r in got) >= 0.93 * greedy(rows, 40)
    assert Counter(rows[r.rec_id][1][0] for r in got)[0] <= 4  # of a third of all rows


def test_ends_of_the_range(spark):
    rows = records(2, 30)
    df = spark.createDataFrame([*rows, (100, [], []), (101, None, None)], SCHEMA)
    assert {r.rec_id for r in varied_subset(df, 500).collect()} == {*range(30), 100, 101}
    assert varied_subset(df, 0).count() == 0
    assert varied_subset(df.limit(0), 5).count() == 0
    assert len({r.rec_id for r in varied_subset(df, 31).collect()}) == 31


def test_features(spark):
    df = spark.createDataFrame([("s", "CCO"), (None, "CCCCC" * 9000), ("s", "CCNCCN")], "scaffold string, smiles string")
    slots, weights = text_features(F.col("scaffold"), "smiles")
    rows = df.select(slots.alias("s"), weights.alias("w")).collect()
    assert [len(r.s) for r in rows] == [2, 2, 4] and all(abs(sum(r.w) - 1) < 1e-6 and len(r.s) == len(r.w) for r in rows)
    assert rows[0].s[0] == rows[2].s[0] != rows[1].s[0]


def test_additions_are_merged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(V, "FAN_IN", 2)
    rows = records(3, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = varied_subset(df, 30).collect()
    assert len({r.rec_id for r in got}) == 30 and sorted(r.place for r in got) == list(range(1, 31))
    mass = np.zeros(SLOTS)
    for r in sorted(got, key=lambda r: r.place):
        assert abs(gain(mass, np.array(rows[r.rec_id][1]), np.array(rows[r.rec_id][2])) - r.gain) < 1e-5
        np.add.at(mass, rows[r.rec_id][1], rows[r.rec_id][2])
    assert sum(r.gain for r in got) >= 0.93 * greedy(rows, 30)


def test_a_large_part_of_the_records(spark):
    rows = records(4, 400)
    got = varied_subset(spark.createDataFrame(rows, SCHEMA), 200).collect()
    assert len({r.rec_id for r in got}) == 200 and sum(r.gain for r in got) >= 0.95 * greedy(rows, 200)
