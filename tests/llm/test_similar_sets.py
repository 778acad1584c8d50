import itertools
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from assayloom.llm import similar_sets as S
from assayloom.llm.fingerprint_queries import bit_sets
from assayloom.llm.similar_sets import merge_skip, pairs_between, similar_classes, similar_pairs


def sets(seed, n=150, words=False):
    rnd = random.Random(seed)
    out, tokens = [], [f"t{i}" for i in range(40)] if words else list(range(40))
    weights = [1 / (i + 1) for i in range(40)]
    for i in range(n):
        if out and rnd.random() < 0.6:
            base = set(rnd.choice(out)[1])
            for _ in range(rnd.randint(0, 3)):
                base ^= {rnd.choice(tokens)}
        else:
            base = set(rnd.choices(tokens, weights, k=rnd.choice([0, 1, 2, 3, 5, 12, 25])))
        out.append((i, sorted(base)))
    return out


def brute(a, b, t, same):
    t = Fraction(t).limit_denominator(10**6)
    ok = lambda x, y: x and y and Fraction(len(x & y), len(x | y)) >= t
    return {(i, j) for i, x in a for j, y in b if (not same or i < j) and ok(set(x), set(y))}


SCHEMA = "rec_id long, tokens array<{}>"


@pytest.mark.parametrize(("t", "depth", "block"), [(0.8, 2, 2000), (0.5, 2, 7), (0.25, 1, 2000), (0.8, 3, 5), (1.0, 2, 2000), (0.8, 1, 4000), (0.5, 1, 7), (0.3, 1, 3)])
def test_against_brute_force(spark, monkeypatch, t, depth, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = sets(7)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(999, None, "x")], SCHEMA.format("int") + ", n_rows string")
    got = [(r.rec_id_a, r.rec_id_b) for r in similar_pairs(df, t, depth).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, rows, t, True)


def test_between_tables(spark):
    a, b = sets(1, 80, True), sets(1, 120, True)[60:]
    x, y = (spark.createDataFrame(r, SCHEMA.format("string")) for r in (a, b))
    got = [(r.rec_id_a, r.rec_id_b) for r in pairs_between(x, y, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, b, 0.6, False)


def test_merge_skip_counts():
    rnd = random.Random(0)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(30), rnd.randint(1, 12))) for _ in range(rnd.randint(1, 9))]
        need, low = rnd.randint(1, len(lists)), rnd.choice([0, 0, 7])
        want = {v: c for v in range(low, 30) if (c := sum(v in x for x in lists)) >= need}
        flat = np.array([100 * i + v for i, x in enumerate(lists) for v in x])
        ends = np.cumsum([len(x) for x in lists])
        begins = ends - [len(x) for x in lists]
        two = lambda x: np.array([x, x])
        probe, value, count = merge_skip(flat, two(begins), two(ends), two(100 * np.arange(len(lists))), np.array([low, low]), np.array([need, need]))
        for k in (0, 1):
            assert dict(zip(value[probe == k].tolist(), count[probe == k].tolist())) == want


@pytest.mark.parametrize("t", [0.8, 0.4])
def test_more_tokens_than_are_broadcast(spark, monkeypatch, t):
    monkeypatch.setattr(S, "VOCABULARY", 3)
    monkeypatch.setattr(S, "BLOCK", 9)
    rows = sets(3, 90, True)
    df = spark.createDataFrame(rows, SCHEMA.format("string"))
    got = [(r.rec_id_a, r.rec_id_b) for r in similar_pairs(df, t).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, rows, t, True)


def test_large_numbers_of_tokens():
    rnd = random.Random(5)
    names = sorted(rnd.sample(range(1 << 30), 40))
    rows = [(i, sorted(set(rnd.choices(names[:12], k=6)))) for i in range(60)]
    frame = pd.DataFrame({"part": f"{names[2]}|-|0-0", "class": [i for i, _ in rows], "side": 3, "block": 0, "tokens": [np.array(x) for _, x in rows]})
    frame = frame[[names[2] in x for x in frame["tokens"]]]
    frame = frame.iloc[np.argsort([len(x) for x in frame["tokens"]], kind="stable")].reset_index(drop=True)
    got = {(a, b) for a, b in S.similar_rows(frame, Fraction(1, 2))[["class_a", "class_b"]].itertuples(index=False)}
    sets_ = {i: set(x) for i, x in rows if names[2] in x}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets_), 2) if 2 * len(sets_[a] & sets_[b]) >= len(sets_[a] | sets_[b]) and min(sets_[a] & sets_[b]) == names[2]}
    assert got == want and got


def test_bits_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None, 0), (2, None, None, None), (3, 0, 0, 1)], "row_id long, fp_0 int, fp_1 int, fp_2 int")
    rows = bit_sets(df, "row_id", ["fp_0", "fp_1", "fp_2"])
    assert {(r.rec_id, tuple(r.tokens)) for r in rows.collect()} == {(1, (0,)), (2, ()), (3, (2,))}
    pairs, members = similar_classes(rows.limit(0), 0.8)
    assert pairs.count() == 0 and members.count() == 0
    for threshold in (0, 1.5, 0.1234567891):
        with pytest.raises(ValueError):
            similar_pairs(rows, threshold)


def test_pairs_are_unique_over_all_small_sets(spark):
    rows = [(i, list(c)) for i, c in enumerate(itertools.chain(*[itertools.combinations(range(5), k) for k in range(6)]))]
    df = spark.createDataFrame(rows, SCHEMA.format("int"))
    got = [(r.rec_id_a, r.rec_id_b) for r in similar_pairs(df, 0.75).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, rows, 0.75, True)
