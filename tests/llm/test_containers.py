import random
from collections import defaultdict
from itertools import combinations
from math import ceil

import pytest

from assayloom.llm import containers as C
from assayloom.llm.containers import best_two_fit, fill_containers, token_counts


def test_replaces_the_smallest_by_two():
    # greedy: 60 then 30 leave a gap of 10; 25 + 15 fill it better than 30
    sizes = [60, 30, 25, 15]
    assert sorted(map(sorted, best_two_fit(sizes, 100))) == [[0, 2, 3], [1]]
    assert sorted(map(sorted, best_two_fit([60, 30, 20, 20], 100))) == [[0, 2, 3], [1]]  # one size twice
    assert sorted(map(sorted, best_two_fit([60, 30, 20], 100))) == [[0, 1], [2]]  # one size once is no pair
    assert best_two_fit([], 10) == []


def optimal(sizes, capacity):
    """Fewest containers, by search over which of them each item joins."""
    best = len(sizes)

    def search(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                loads[k] += sizes[i]
                search(i + 1, loads)
                loads[k] -= sizes[i]
        search(i + 1, [*loads, sizes[i]])

    search(0, [])
    return best


def test_close_to_the_optimum():
    rnd = random.Random(8)
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 20) for _ in range(9)), reverse=True)
        got = best_two_fit(sizes, 20)
        assert sorted(i for b in got for i in b) == list(range(9)) and all(sum(sizes[i] for i in b) <= 20 for b in got)
        assert len(got) <= optimal(sizes, 20) + 1


@pytest.mark.parametrize("block", [10_000, 40])
def test_each_text_once_and_none_split_without_need(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_ITEMS", block)
    rnd = random.Random(3)
    texts = [(i, rnd.choice([rnd.randint(1, 30), rnd.randint(1, 64), 64, 128, rnd.randint(100, 500), 0])) for i in range(400)] + [(7, 20), (7, 20)]
    counts = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, n_tokens long, capacity string")
    sizes = spark.createDataFrame([(1, 64), (2, 256), (3, None)], "size_id long, n_tokens long")
    rows = fill_containers(counts, sizes).collect()
    for size_id, capacity in ((1, 64), (2, 256)):
        own = [r for r in rows if r.size_id == size_id]
        bins, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            if r.container_id is None:
                assert r.n_tokens == 0
                continue
            bins[r.container_id] += r.n_tokens
            pieces[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(bins.values()) <= capacity
        assert sum(bins.values()) == sum(n for _, n in texts) and sum(r.n_tokens == 0 for r in own) == sum(n == 0 for _, n in texts)
        for i, n in texts:
            if n and i != 7:
                assert sorted(pieces[i]) == [(k * capacity, min(capacity, n - k * capacity)) for k in range(ceil(n / capacity))]
        assert sum(bins.values()) / (len(bins) * capacity) > 0.97
    assert fill_containers(counts.limit(0), sizes).count() == 0
    assert fill_containers(counts, sizes.where("size_id = 3")).count() == 0


def test_counts_whole_texts(spark):
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "ж" * 30_000), (5, "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    encode = C.encoder(C.TOKENIZER)
    assert got[2] == got[3] == 0 and all(encode.decode(encode.encode_ordinary(t)) == t and got[i] == len(encode.encode_ordinary(t)) for i, t in texts if t)


def test_pairs_are_the_tightest():
    rnd = random.Random(5)
    for _ in range(100):
        sizes = sorted((rnd.randint(3, 40) for _ in range(12)), reverse=True)
        first = best_two_fit(sizes, 50)[0]
        greedy, gap = [], 50
        for i, s in enumerate(sizes):
            if s <= gap:
                greedy.append(i)
                gap -= s
        if gap:
            left = [s for i, s in enumerate(sizes) if i not in greedy]
            room = gap + sizes[greedy[-1]]
            best = max([sizes[greedy[-1]], *(a + b for a, b in combinations(left, 2) if a + b <= room)])
            assert sum(sizes[i] for i in first) == 50 - room + best
