import random

import pytest

from assayloom.operators import portfolio as P


def one_pass(rows, wanted, caps, spread, ceiling):
    chosen = []
    for varied in (True, False):
        for r in rows:
            held = len(chosen) < wanted and r not in chosen and all(sum(c[k] == r[k] for c in chosen) < n for k, n in caps.items())
            new = bool(spread) and all(c[spread] != r[spread] for c in chosen)
            if held and (not varied or len(chosen) < 3 or new or all(P.tanimoto(c["w"], r["w"]) < ceiling for c in chosen)):
                chosen.append(r)
    return [r["row_id"] for r in chosen]


@pytest.mark.parametrize("spread", [None, "s"])
def test_too_similar_rows_stay_with_the_executors(spark, monkeypatch, spread):
    monkeypatch.setattr(P, "BLOCK_ROWS", 5)
    rnd = random.Random(5)
    series = [(1 << 62) - 1, -1]  # one analog series, with a bit changed here and there
    rows = [dict(row_id=i, s="hot", w=[series[0] ^ (1 << rnd.randrange(60)), series[1]]) for i in range(200)]
    rows += [dict(row_id=200 + i, s=rnd.choice(["hot", "new", None]), w=[rnd.getrandbits(63), -rnd.getrandbits(63)]) for i in range(20)] + [dict(row_id=300, s="hot", w=[0, 0])]
    df = spark.createDataFrame([(r["row_id"], r["s"], r["w"]) for r in rows], "row_id long, s string, w array<long>")
    scans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: scans.append(1) or collect(self))
    got = P.greedy_portfolio(df, [("row_id", False)], 8, {"s": 7}, spread, "w", 0.6)
    n = len(scans)
    assert [r.row_id for r in got.orderBy("place").collect()] == one_pass(rows, 8, {"s": 7}, spread, 0.6)
    assert n <= 12  # 40 blocks hold the series
