import random

from assayloom.plans.table_queries import d05_split
from tests.test_operators import greedy


def test_split_against_one_pass(spark, tmp_path):
    rnd = random.Random(8)
    rows = [dict(row_id=i, product=f"P{rnd.randrange(60)}", s="hot" if i < 30 else rnd.choice("abcde"), p=rnd.choice("UVWXYZ"), score=200.0 - i // 2) for i in range(90)]
    schema = "row_id long, product_smiles string, scaffold string, primary_parent_id string, orthogonal_composite_score double"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).write.parquet(f"{tmp_path}/lead_selection_relaxed_pool.parquet")
    primary = greedy(rows, 8, {"s": 2, "p": 2}, "s", 3)
    taken = {r["product"] for r in rows if r["row_id"] in primary}
    backup = greedy([r for r in rows if r["product"] not in taken], 6, {"p": 2}, "s", 3)
    got = d05_split(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.row_id for r in got if r.part == "primary"] == primary and [r.row_id for r in got if r.part == "backup"] == backup
    assert sum(rows[i]["s"] == "hot" for i in primary) <= 2 and len(got) == 14
