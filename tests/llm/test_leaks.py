import random
import re

import numpy as np

from assayloom.llm import leaks as L
from assayloom.llm.leaks import leaks, set_sizes


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def grams(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Ёлка", "gróva", "ŁÓDŹ", "4096", "x1", "naïve", "de", "und", "ét"] + [f"w{i}" for i in range(60)]
    sentence = lambda n: "".join(rnd.choice(vocabulary).swapcase() + rnd.choice([" ", ", ", "_", "-\n", " . "]) for _ in range(n))
    items = [(i, sentence(rnd.randint(5, 40))) for i in range(30)] + [(100, None), (101, ""), (102, "  ")]
    items += [(200, items[3][1]), (201, items[4][1][: len(items[4][1]) // 2] + sentence(10))]
    docs = []
    for d in range(200):
        parts = [sentence(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            w = words(rnd.choice(items[:30])[1])
            a = rnd.randint(0, len(w))
            parts += [" ".join(w[a : a + rnd.randint(8, 30)]).upper(), sentence(rnd.randint(0, 20))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, sentence(30_000) + " " + items[5][1] + " " + sentence(50))]
    return docs, items


def check(spark, shingle, passage):
    docs, items = corpus()
    want = {}
    for d, t in docs:
        for i, u in items:
            if t and u and (n := len(grams(t, passage) & grams(u, passage))):
                want[d, i] = n
    docs_df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string")
    got = leaks(docs_df, "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id", shingle=shingle, passage=passage)
    assert {(r.doc_id, r.item_id): r.n_passages for r in got.collect()} == want and want


def test_against_brute_force(spark):
    check(spark, 5, 13)
    check(spark, 2, 6)


def test_join_path(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_KEYS", 3)
    check(spark, 5, 13)
    monkeypatch.setattr(L, "BROADCAST_CHARS", 3)
    check(spark, 5, 13)


def test_set_sizes():
    rnd = random.Random(2)
    for n in (9, 30):
        values = np.array([rnd.randint(0, 9) for _ in range(n)], np.uint64)
        assert set_sizes(values, 9).tolist() == [len(set(values[i : i + 9].tolist())) for i in range(n - 8)]
    assert set_sizes(np.arange(12, dtype=np.uint64), 4).tolist() == [4] * 9


def test_words_that_repeat(spark):
    """Sets of few different shingles are in a partition of their own."""
    docs = [(1, "ha " * 40), (2, "ha ho " * 30), (3, "x " + "ha " * 12 + "y"), (4, "x " + "ha " * 13)]
    items = [(7, "ha " * 13), (8, "ho ha " * 8)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_passages) for r in leaks(d, "doc_id", i, "item_id").collect()} == {(1, 7, 1), (4, 7, 1), (2, 8, 2)}


def test_empty(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(d.limit(0), "doc_id", i, "item_id").count() == 0
    assert leaks(d, "doc_id", i.limit(0), "item_id").count() == 0
