import itertools
import random

import numpy as np
import pandas as pd
import pytest

from assayloom.llm import spans as S
from assayloom.llm.characters import Rolling, code_points
from assayloom.llm.spans import covering, kept_positions, links, pairs_sharing, shared_parts


def corpus(seed):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choices("abcdefgh ёжЯ😀\n", k=n))
    notice, near = noise(28), noise(29)  # frequent, but shorter than a span
    shared = [noise(rnd.randint(30, 90)) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [noise(rnd.randint(0, 40)), rnd.choice([notice, near, "", notice])]
        parts += [noise(rnd.randint(0, 30)), rnd.choice(shared)[rnd.randint(0, 20) :], noise(rnd.randint(0, 10))]
        rnd.shuffle(parts)
        docs.append((i, "".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "ab" * 60), (105, "x" + "ab" * 40), (106, "ab" * 14), (107, shared[0] * 3)]
    docs += [(108, noise(200_000) + shared[1] + noise(10))]
    return docs


def brute(docs, span):
    at = {d: {t[i : i + span] for i in range(len(t) - span + 1)} for d, t in docs if t}
    return {(a, b) for a, b in itertools.combinations(sorted(at), 2) if at[a] & at[b]}


def brute_parts(docs, span):
    holders, out = {}, {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            holders.setdefault(t[i : i + span], set()).add(d)
    for d, t in docs:
        hit = np.zeros(len(t or "") + 1, bool)
        for i in range(len(t or "") - span + 1):
            if len(holders[t[i : i + span]]) > 1:
                hit[i : i + span] = True
        if hit.any():
            out[d] = (len(t), int(hit.sum()), int((hit[:-1] & ~np.concatenate(([False], hit[:-2]))).sum()))
    return out


@pytest.mark.parametrize(("subtree", "piece"), [(128, 1 << 23), (3, 50)])
def test_against_brute_force(spark, monkeypatch, subtree, piece):
    monkeypatch.setattr(S, "SUBTREE", subtree)
    monkeypatch.setattr(S, "PIECE", piece)
    docs = corpus(5)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, key string, n_rows int")
    assert {tuple(r) for r in pairs_sharing(df, "doc_id", span=30).collect()} == brute(docs, 30)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in shared_parts(df, "doc_id", span=30).collect()}
    assert got == {d: (n, s) for d, (n, s, _) in brute_parts(docs, 30).items()}


def test_texts_whose_rolling_hashes_collide(spark):
    """Differences that follow the Thue-Morse sequence vanish in any polynomial modulo 2 ** 64, whatever its base."""
    rnd = random.Random(4)
    opening = "".join(rnd.choices("abcdefgh", k=400))
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in morse), "".join("ba"[b] for b in morse)
    ends = Rolling(code_points(one + two)).stretches(np.array([0, 1024]), np.array([1024, 2048]))
    assert ends[0] == ends[1]  # the trap works
    docs = [(1, opening + one), (2, opening + two), (3, opening + "x" * 50), (4, one), (5, two)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in pairs_sharing(df, "doc_id").collect()} == brute(docs, 300)
    assert {tuple(r) for r in pairs_sharing(df, "doc_id", span=1024).collect()} == brute(docs, 1024)


@pytest.mark.parametrize("span", [300, 1024])
def test_windows_of_split_groups_are_compared_by_digest(spark, monkeypatch, span):
    monkeypatch.setattr(S, "SUBTREE", 2)
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in morse), "".join("ba"[b] for b in morse)
    docs = [(i, f"{i}" * 40 + one + "!" * i) for i in range(4)] + [(10 + i, f"{i}" * 40 + two + "?" * i) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in pairs_sharing(df, "doc_id", span=span).collect()} == brute(docs, span)


def test_links_are_classes_and_their_numbers(spark):
    docs = corpus(8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, text = brute(docs, 30), dict(docs)
    first = {}
    for d, t in sorted(docs):
        first.setdefault(t, d)
    want = {}
    for d, t in docs:
        near = {text[y if x == d else x] for x, y in pairs if d in (x, y)}
        if near:
            want[d] = (first[t], sum(u == t for _, u in docs), len(near - {t}))
    assert {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in links(df, "doc_id", span=30).collect()} == want
    assert links(df.limit(0), "doc_id", span=30).count() == 0


def test_covering():
    assert covering(np.array([3, 4, 9]), 2, 7).tolist() == [1, 2, 3, 4, 7]
    assert len(covering(np.arange(1_000_000), 100, 999_000)) == 999_001


def test_every_window_keeps_a_position():
    rnd = random.Random(2)
    for text in ["".join(rnd.choices("ab", k=3000)), "a" * 500, "ab" * 300]:
        kept = kept_positions(Rolling(code_points(text)), 40)
        assert np.diff(np.concatenate(([-1], kept))).max() <= 40 and kept.max() >= len(text) - 24 - 40


def test_empty(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    assert pairs_sharing(df.limit(0), "doc_id", span=30).count() == 0
    assert shared_parts(df.where("doc_id = 103"), "doc_id", span=30).count() == 0
    with pytest.raises(ValueError):
        pairs_sharing(df, "doc_id", span=5)


def test_suffixes_lie_within_their_text():
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abcd", k=rnd.randint(30, 45))) for _ in range(3000)]
    frame = pd.DataFrame({"doc_id": range(3000), "text": texts})
    out = pd.concat(S._suffixes(30, 24)(iter([frame])))
    sizes = np.array([len(t) for t in texts])
    assert len(out) > 3000 and out["pos"].min() >= 0 and (out["pos"] + 24 <= sizes[out["doc_id"]]).all()
    same = {}
    for key, doc, pos in zip(out["key"], out["doc_id"], out["pos"]):
        assert same.setdefault(key, texts[doc][pos : pos + 24]) == texts[doc][pos : pos + 24]
