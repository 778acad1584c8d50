import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.functions import smiles as S
from assayloom.operators import portfolio as P
from assayloom.operators.enumerate import apply_transforms, levels
from assayloom.operators.funnel import funnel_counts, survivors
from assayloom.operators.geometry import within
from assayloom.operators.portfolio import greedy_portfolio
from assayloom.operators.ranking import capped, first_by, ranked
from assayloom.operators.regress import grouped_ridge, loo_means, metrics, ridge
from assayloom.operators.similarity import against_all, nearest, vector_neighbours, words
from assayloom.operators.skew import salted_lookup, whole_groups


def test_salted_lookup_is_a_join(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", "hot", None, *"abcdefgh"])) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, k string")
    counted = df.where("k IS NOT NULL AND k <> 'a'").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
    got = sorted(tuple(r) for r in salted_lookup(df, counted, "k", "row_id").select("row_id", "k").collect())
    assert got == sorted(r for r in rows if r[1] not in (None, "a"))
    assert salted_lookup(df.limit(0), counted, "k", "row_id").count() == 0


def test_whole_groups_never_cuts():
    keys = sorted(random.Random(2).choices(range(30), k=400))
    frame = pd.DataFrame({"k": keys, "v": range(400)})
    cuts = [frame.iloc[i : i + 7] for i in range(0, 400, 7)]
    out = list(whole_groups(iter(cuts), ["k"], 25))
    assert pd.concat(out)["v"].tolist() == list(range(400)) and len(out) > 3
    seen = [set(f["k"]) for f in out]
    assert sum(map(len, seen)) == len(set(keys))
    assert list(whole_groups(iter([]), ["k"])) == []


def test_ranked_is_the_row_number_of_the_whole(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, score double").repartition(6)
    got = {r.row_id: r.rank for r in ranked(df, {"score": True, "row_id": False}).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert ranked(df.limit(0), {"row_id": False}).count() == 0


def test_first_and_capped(spark):
    rows = [(i, "hot" if i % 3 else None, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, g string, s long")
    got = {(r.g, r.row_id) for r in capped(df, ["g"], [F.desc("s"), F.asc("row_id")], 5, "row_id").collect()}
    want = set()
    for g in ("hot", None):
        want |= {(g, r[0]) for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:5]}
    assert got == want
    assert {tuple(r) for r in first_by(df, ["g"], F.struct(-F.col("s"), "row_id"), ["row_id"]).collect()} == {("hot", 13), (None, 6)}


def test_nan_never_passes_and_counts_fall(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 1.0), (4, 9.0)], "p long, x double")
    stages = [("a", E.known("x") >= 2), ("b", E.known("x") >= 6)]
    assert [tuple(r) for r in funnel_counts(df, stages, "p").orderBy("ord").collect()] == [(0, "start", 4), (1, "a", 2), (2, "b", 1)]
    assert [r.p for r in survivors(df, stages).collect()] == [4]
    assert [r.remaining for r in funnel_counts(df.limit(0), stages, "p").collect()] == [0, 0, 0]
    assert [r.p for r in df.where(E.at_least("x", 2)).collect()] == [1, 4] and [r.p for r in df.where(E.at_most("x", 6)).collect()] == [1, 4]


def test_gates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5.0, 1.0), (2, 1.0, 9.0)], "p long, x double, y double").write.parquet(str(tmp_path / "t"))
    kept = survivors(spark.read.parquet(str(tmp_path / "t")), [("a", E.at_least("x", 2)), ("b", E.at_most("y", 3))]).select("p")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2.0)" in plan and "LessThanOrEqual(y,3.0)" in plan


def test_expressions(spark):
    df = spark.createDataFrame([(6.1, 2.0, 7.0), (10845.0, 2.0, float("nan")), (None, 2.0, 5.0)], "x double, c double, y double")
    assert [r[0] for r in df.select(E.four_digits("x")).collect()] == ["6.1", "1.084e+04", None]
    both = E.beside(df, E.population(df, ["x", "c", "y"]))
    got = both.select(E.higher("c"), E.higher("y"), (E.higher("y") + E.lower("y")).alias("one"), E.closeness("y", 5.0, 4.0)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0, 0.5), (1.0, None, None, None), (1.0, 0.0, 1.0, 1.0)]
    spread = df.select(E.row_mean([F.col("x"), F.col("c")]), E.row_spread([F.col("x"), F.col("c")])).collect()
    assert spread[2] == (2.0, 0.0) and abs(spread[0][1] - 2.05) < 1e-12
    ids = spark.createDataFrame([(" a-1 ",), ("--",), (None,)], "id string").select(E.key_of("id"), E.tidy("id")).collect()
    assert [tuple(r) for r in ids] == [("A1", "a-1"), (None, "--"), (None, None)]


def test_smiles_counts(spark):
    rows = ["CC(=O)Oc1ccccc1C(=O)O", "[NH4+].[Cl-]", "C%12CCCC%12", "[O-][N+](=O)c1ccccc1", "[Ca+2].[13CH4]", "ClCBr", ""]
    s = F.col("s")
    df = spark.createDataFrame([(r,) for r in rows], "s string").select(S.heavy_atoms(s), S.rings(s), S.charge(s), S.components(s), F.round(S.heavy_weight(s), 3))
    assert [tuple(r) for r in df.collect()] == [
        (13, 1, 0, 1, 172.095), (2, 0, 0, 2, 49.457), (5, 1, 0, 1, 60.055), (9, 1, 0, 1, 118.071), (2, 0, 2, 2, None), (3, 0, 0, 1, 127.365), (0, 0, 0, 0, 0.0)
    ]


def greedy(rows, wanted, caps, spread, exempt):
    chosen = []
    for varied in ([True, False] if spread else [False]):
        for r in rows:
            if len(chosen) == wanted:
                break
            held = all(sum(c[k] == r[k] for c in chosen) < n for k, n in caps.items())
            fresh = not varied or len(chosen) < exempt or all(c[spread] != r[spread] for c in chosen)
            if r not in chosen and held and fresh:
                chosen.append(r)
    return [r["row_id"] for r in chosen]


@pytest.mark.parametrize("block", [3, 2000])
@pytest.mark.parametrize("spread", [None, "s"])
def test_portfolio_against_one_pass(spark, monkeypatch, block, spread):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    rnd = random.Random(6)
    rows = [dict(row_id=i, s=rnd.choice([None, "a", "b", "c", "d"]), p=rnd.choice([None, "x", "y", "z"]), score=rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, s string, p string, score double")
    ordered = sorted(rows, key=lambda r: (r["score"] is None, -(r["score"] or 0), r["row_id"]))
    for wanted in (6, 30):
        got = greedy_portfolio(df, [("score", True), ("row_id", False)], wanted, {"s": 3, "p": 4}, spread).orderBy("place").collect()
        assert [r.row_id for r in got] == greedy(ordered, wanted, {"s": 3, "p": 4}, spread, 3)
    assert greedy_portfolio(df.limit(0), [("row_id", False)], 3, {}).count() == 0


def test_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    bits = (rnd.random((60, 70)) < 0.3).astype(int)
    bits[7] = 0
    df = spark.createDataFrame([(i, *map(int, b)) for i, b in enumerate(bits)], ["row_id", *[f"b{j}" for j in range(70)]])
    packed = words(df, "row_id", [f"b{j}" for j in range(70)])
    pairs = against_all(packed.where("row_id % 10 = 0").withColumnRenamed("row_id", "query_id"), packed, 2)
    found = {r.query_id: r for r in nearest(pairs).collect()}
    for q in range(0, 60, 10):
        sims = {j: (bits[q] & bits[j]).sum() / max((bits[q] | bits[j]).sum(), 1) for j in range(60) if j != q}
        best = min(sims, key=lambda j: (-sims[j], j))
        assert found[q].nearest_id == best and abs(found[q].max_similarity - sims[best]) < 1e-12 and abs(found[q].mean_similarity - np.mean(list(sims.values()))) < 1e-12
    vectors = rnd.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "row_id long, vector array<double>").repartition(3)
    got = {(r.query_id, r.place): r.row_id for r in vector_neighbours(rows.where("row_id < 4").withColumnRenamed("row_id", "query_id"), rows, 3).collect()}
    for q in range(4):
        order = sorted((i for i in range(60) if i != q), key=lambda i: ((vectors[i] - vectors[q]) ** 2).sum())
        assert [got[q, k + 1] for k in range(3)] == order[:3]
    assert vector_neighbours(rows.limit(0).withColumnRenamed("row_id", "query_id"), rows, 3).count() == 0


def test_ridge_folds_against_numpy(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(200, 3)) * [1, 10, 0.1] + [5, 0, 2]
    y = x @ [1.0, 0.2, -3.0] + rnd.normal(size=200) * 0.1
    df = spark.createDataFrame([(f"g{i % 37}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "g string, a double, b double, c double, y double")
    out = grouped_ridge(df, F.col("g"), ["a", "b", "c"], "y", [0.5], folds=4).toPandas()
    assert out.groupby("g")["fold"].nunique().max() == 1 and len(out) == 200
    for f, part in out.groupby("fold"):
        rest = out[out["fold"] != f]
        z = np.column_stack((np.ones(len(rest)), rest[["a", "b", "c", "y"]]))
        w = ridge(z.T @ z, 0.5)
        assert np.allclose(part["prediction"], np.column_stack((np.ones(len(part)), part[["a", "b", "c"]])) @ w)
    r2 = metrics(spark.createDataFrame(out), "y", "prediction").collect()[0].r2
    assert r2 > 0.99


def test_loo_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 2.0), (None, 1.0), ("b", None)], "k string, y double")
    got = {(r.key, r.value): (r.n_same, r.others_mean) for r in loo_means(df, F.col("k"), "y").collect()}
    assert got == {("a", 1.0): (2, 2.5), ("a", 4.0): (1, 1.0), ("b", 2.0): (1, None)}


def test_within_radius_against_all_pairs(spark):
    rnd = np.random.default_rng(6)
    a, b = rnd.random((80, 3)) * 4 - 2, rnd.random((30, 3)) * 4 - 2
    schema = "x double, y double, z double"
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(999, None, 0.0, 0.0)], "point_id long, " + schema)
    probes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "probe_id long, " + schema)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want = {i: int((row <= 0.7).sum()) for i, row in enumerate(d) if (row <= 0.7).any()}
    got = within(points, probes, ["x", "y", "z"], 0.7).collect()
    assert {r.point_id: r.n_near for r in got} == want and all(abs(r.least - d[r.point_id].min()) < 1e-9 for r in got)


def test_transforms_and_levels(spark):
    df = spark.createDataFrame([("CClCCl",), ("CC",)], "parent string")
    rules = [("x", "Cl", "F"), ("y", "C", "N")]
    got = {(r.label, r.site, r.product) for r in apply_transforms(df.where("parent <> 'CC'"), rules).collect()}
    assert got == {("x", 1, "CFCCl"), ("x", 2, "CClCF"), ("y", 1, "NClCCl"), ("y", 2, "CNlCCl"), ("y", 3, "CClNCl"), ("y", 4, "CClCNl")}
    reach = {(r.product, r.depth, r.root) for r in levels(spark.createDataFrame([("CC",), ("NC",)], "parent string"), [("y", "C", "N")], 3, 10).collect()}
    assert reach == {("CN", 1, "CC"), ("NN", 1, "NC")}


def test_stored_and_released(spark):
    from assayloom.shared import free_name, release, stored

    release(spark)
    df = stored(spark.range(10), "numbers")
    path = df.inputFiles()[0]
    assert df.count() == 10 and df.dtypes == spark.range(1).dtypes
    assert release(spark) == 1 and release(spark) == 0
    assert not __import__("os").path.exists(path.removeprefix("file://"))
    assert free_name(spark.createDataFrame([(1, 2)], "a int, _A int"), "a") == "__a"


def test_models_on_molecules_held_out(spark, tmp_path):
    """Labels that follow from two descriptors are predicted for molecules that no model saw."""
    from assayloom.plans.model_queries import m06_forest, m12_grouped_ridge, m14_consensus, m16_importances

    rnd = np.random.default_rng(9)
    x = pd.DataFrame(rnd.normal(size=(600, 17)), columns=E.DESCRIPTORS)
    y = 5 + x["mw"] - 0.5 * x["logp"] + rnd.normal(size=600) * 0.1
    x.loc[::50, "tpsa"] = np.nan
    frame = x.assign(row_id=range(600), canonical_smiles=[f"C{i // 2}" for i in range(600)], pIC50=y)
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/final_model_feature_matrix.parquet")
    d = str(tmp_path)
    assert min(r.r2 for r in m12_grouped_ridge(spark, d).where("alpha < 100").collect()) > 0.95
    assert metrics(m06_forest(spark, d), "actual", "prediction").collect()[0].r2 > 0.6
    both = m14_consensus(spark, d)
    assert metrics(both, "actual", "mean").collect()[0].r2 > 0.8 and both.where("spread < 0").count() == 0
    assert [r.descriptor for r in m16_importances(spark, d).limit(2).collect()] == ["mw", "logp"]


def test_numbers_that_must_be_known(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0)], "x double, y double")
    assert E.require_known(df, ["y"]) is df
    with pytest.raises(ValueError, match="'x': 1"):
        E.require_known(df, ["x", "y"])


def test_one_molecule(spark):
    rows = [("CCO",), ("CC.O",), ("[1*]CC",), ("",), (" ",), (None,), ("C*",)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(S.one_molecule(F.col("s"))).collect()] == [True, *[False] * 6]


def test_caps_of_named_values(spark):
    rows = [(i, "hot" if i % 2 else "b", 100.0 - i) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, s string, score double")
    got = greedy_portfolio(df, [("score", True), ("row_id", False)], 8, {"s": 2}, only={"s": ["hot"]}).orderBy("place").collect()
    assert [r.row_id for r in got] == [0, 1, 2, 3, 4, 6, 8, 10]
