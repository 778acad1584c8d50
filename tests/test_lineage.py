import random

from assayloom.plans.table_queries import a02_lineage


def test_lineage_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    fields = {"parent_ids": "CHEMBL1 CHEMBL2 frag9 X".split(), "methods": ["r_group", "ring scan", "hop"], "transforms": ["Cl>F", "a b", "n-walk", "z"]}
    rows = []
    for i in range(120):
        held = [rnd.choices(v, k=rnd.randint(0, 3)) for v in fields.values()]
        cells = [rnd.choice([None, "", " "]) if not h else rnd.choice([";", " ; ", "|"]).join(h) for h in held]
        rows.append((i, rnd.choice([None, *"abcdefghij"]), rnd.choice([None, "p", "q"]), rnd.choice([None, True, False, False]), *cells, held))
    rows.append((500, "bare", None, None, None, None, "", [[], [], []]))
    schema = "row_id long, product_smiles string, primary_parent_id string, is_original_positive boolean, parent_ids string, methods string, transforms string"
    spark.createDataFrame([r[:-1] for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/lead_selection_relaxed_pool.parquet")
    want = {}
    for product in {r[1] for r in rows} - {None}:
        mine = [r for r in rows if r[1] == product]
        sets = [sorted({v for r in mine for v in r[-1][k]}) for k in range(3)]
        flags = [r[3] for r in mine if r[3] is not None]
        want[product] = (mine[0][0], mine[0][2], len(mine), any(flags) if flags else None, *[(";".join(s) or None, len(s)) for s in sets])
    got = {
        r.product_smiles: (r.first_row, r.first_parent, r.n_rows, r.is_original, (r.parent_ids, r.n_parents), (r.methods, r.n_methods), (r.transforms, r.n_transforms))
        for r in a02_lineage(spark, str(tmp_path)).collect()
    }
    assert got == want
