import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayloom.llm.contributors import over_limit, water_level


def brute_level(counts, total, share):
    fit = [c for c in range(1, total + 1) if c <= share * (sum(min(n, c) for n in counts) + total - sum(counts)) + 1e-9]
    return max(fit, default=0)


def test_water_level_against_all_levels():
    rnd = random.Random(4)
    for _ in range(300):
        share = rnd.choice([0.05, 0.1, 0.2, 0.34, 0.5])
        counts = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(1, 25))), reverse=True)
        total = sum(counts) + rnd.randint(0, 20)
        got = min(water_level(counts[: int(1 / share)], total, share, True), counts[0])
        assert got == min(brute_level(counts, total, share), counts[0]), (counts, share)
    assert water_level([], 0, 0.5, True) == float("inf")
    for _ in range(100):  # of the input the level is the same whatever is above it
        counts = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(1, 25))), reverse=True)
        total = sum(counts) + rnd.randint(0, 20)
        assert min(water_level(counts[:10], total, 0.1, False), counts[0]) == min(int(0.1 * total + 1e-9), counts[0])


@pytest.mark.parametrize("of_output", [False, True])
def test_drops_the_worst_of_the_hot(spark, of_output):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", None] + list("abcdefghij")), rnd.choice([None, 1.0, 2.0, 2.0]), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, who string, score double, _who string")
    got = {r.row_id for r in over_limit(df, F.col("who"), [F.coalesce(-F.col("score"), F.lit(9.0))], "row_id", 0.1, of_output).collect()}
    counts = Counter(w for _, w, _, _ in rows if w)
    level = brute_level(list(counts.values()), 600, 0.1) if of_output else 60
    want = set()
    for w in counts:
        own = sorted((r for r in rows if r[1] == w), key=lambda r: (-(r[2] or -9), r[0]))
        want |= {r[0] for r in own[level:]}
    assert got == want and got


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "row_id long, who string")
    assert over_limit(df.limit(0), F.col("who"), [], "row_id", 0.1).count() == 0
    assert over_limit(df, F.col("who"), [], "row_id", 0.5).count() == 0
    with pytest.raises(ValueError):
        over_limit(df, F.col("who"), [], "row_id", 0)
