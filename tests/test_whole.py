"""Queries and operators that do the whole job, against brute force on small fixtures."""

import random

import numpy as np

from assayloom.functions import expr as E
from assayloom.plans import model_queries
from assayloom.plans.model_queries import TRANSFORMS, _labelled, _prepared, e16_levels_all, m01_loo_mean_molecule, m07_memoriser_molecule


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def reached(parents, depth):
    seen, front, out = set(parents), {p: p for p in parents}, set()
    for d in range(1, depth + 1):
        made = {}
        for parent, root in front.items():
            for _, pattern, replacement in TRANSFORMS:
                pieces = parent.split(pattern)
                for i in range(1, len(pieces)):
                    product = pattern.join(pieces[:i]) + replacement + pattern.join(pieces[i:])
                    if product not in seen:
                        made[product] = min(root, made.get(product, root))
        seen |= set(made)
        out |= {(p, d, r) for p, r in made.items()}
        front = made
    return out


def test_levels_of_all_molecules_at_any_length(spark, tmp_path):
    rnd = random.Random(1)
    smiles = ["".join(rnd.choice(["Cl", "OC", "C#N", "C(=O)O", "CC", "N"]) for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    smiles += ["C" * 130 + "Cl" * 4, "FCl", " ClCl ", None, " "]
    d = written(spark, tmp_path, "final_model_feature_matrix", [(i + 1, s) for i, s in enumerate(smiles)], "row_id long, canonical_smiles string")
    got = [tuple(r) for r in e16_levels_all(spark, d).select("product", "depth", "root").collect()]
    want = reached({s.strip() for s in smiles if s and s.strip()}, 3)
    assert sorted(got) == sorted(want) and {x[1] for x in want} == {1, 2, 3} and any(len(x[0]) > 120 for x in want)


def test_spellings_of_a_molecule_are_one(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(2)
    spelled = ["CCl.OBr{0}", " OBR{0}.CCL", '"OBr{0}.CCl"', "CCl\u00b7Obr{0}", "CCL.OBr{0};", "C Cl.O\u200bBr{0}"]
    labels, rows = {}, []
    for i in range(240):
        molecule, y = i % 40, round(float(rnd.random()) * 9, 1)
        labels.setdefault(molecule, []).append(y)
        rows.append((i, spelled[i // 40].format("N" * molecule), y, *map(float, rnd.random(17))))
    rows += [(900, None, 5.0, *[1.0] * 17), (901, " ", 5.0, *[1.0] * 17), (902, "CCl", None, *[1.0] * 17)]
    schema = "row_id long, canonical_smiles string, pIC50 double, " + ", ".join(f"{c} double" for c in E.DESCRIPTORS)
    d = written(spark, tmp_path, "final_model_feature_matrix", rows, schema)
    assert _labelled(spark, d).count() == 240
    got = sorted((r.molecule, r.pic50, r.n_same, r.others_mean) for r in m01_loo_mean_molecule(spark, d).collect())
    want = {(".".join(sorted(["CCl", "OBr" + "N" * m])), y, ys.count(y), (sum(ys) - y) / (len(ys) - 1)) for m, ys in labels.items() for y in ys}
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=1e-6)
    y, p = (np.array(x) for x in zip(*[(y, np.mean(ys)) for ys in labels.values() for y in ys]))
    want = 240, abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.allclose(tuple(m07_memoriser_molecule(spark, d).collect()[0]), want, atol=1e-6)
    held = _prepared(spark, d).select("row_id", "held").toPandas()
    assert held.groupby(held["row_id"] % 40)["held"].nunique().max() == 1 and held["held"].nunique() == 2
    folds = []

    def spied(*args, f=model_queries.grouped_ridge):
        folds.append(f(*args))
        return folds[0]

    monkeypatch.setattr(model_queries, "grouped_ridge", spied)
    model_queries.m12_grouped_ridge(spark, d)
    folds = folds[0].toPandas()
    assert folds.groupby(folds["row_id"] % 40)["fold"].nunique().max() == 1 and folds["fold"].nunique() > 2
