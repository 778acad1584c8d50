import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assayloom.llm import bundles, compound_queries
from assayloom.llm.bundles import Bundle, Dependency, best_record, best_rows
from assayloom.llm.compound_queries import id_key
from assayloom.llm.spellings import collapse, copies, smiles_parts, tagged_parts
from tests.compare import rows_of


def brute(rows, k):
    """Best (a row, b row) by summed trust under key equality, None allowed."""
    out = {}
    for g in {r["g"] for r in rows if r["g"] is not None}:
        own = [r for r in rows if r["g"] == g]
        a = [r for r in own if r["a"] is not None] + [None]
        b = [r for r in own if r["b"] is not None] + [None]
        low = (-(10**25) + 1, -(10**25) + 1)
        vec = lambda r: (r["t"], -r["row_id"]) if r else low
        ok = [(x, y) for x, y in itertools.product(a, b) if not (x and y) or x["a"] % k == y["b"] % k]
        x, y = max(ok, key=lambda p: tuple(map(sum, zip(vec(p[0]), vec(p[1])))))
        out[g] = (x and x["row_id"], y and y["row_id"])
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_search_is_optimal(spark, k):
    rnd = random.Random(k)
    rows = [
        dict(row_id=i, g=rnd.choice(["x", "y", "z", None, "hot", "hot", "hot"]), a=rnd.choice([None, 1, 2, 3, 4]), b=rnd.choice([None, 5, 6, 7, 8]), t=rnd.randint(0, 3))
        for i in range(120)
    ]
    df = spark.createDataFrame([(r["row_id"], r["g"], r["a"], r["b"], r["t"], "extra") for r in rows], "row_id long, g string, a long, b long, t long, _g string")
    rule = Dependency("A", "B", F.col("a") % k, F.col("b") % k)
    got = best_record(df, F.col("g"), [Bundle("A", ("a",)), Bundle("B", ("b",))], [(F.col("t"), 1)], "row_id", [rule])
    found = {r.id_key: (r.A and r.A.row_id, r.B and r.B.row_id) for r in got.collect()}
    assert found == brute(rows, k)


def test_trees_are_searched_apart(spark):
    """Two rules that share no bundle, a chain of rules, null levels and null keys against all choices."""
    rnd = random.Random(8)
    names = "abcd"
    rows = [dict(row_id=i, g=rnd.choice("xyyyy"), t=rnd.choice([None, 0, 1, 2]), **{c: rnd.choice([None, 1, 2, 3, 4]) for c in names}) for i in range(26)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g string, t long, a long, b long, c long, d long")
    key = lambda c, m: F.when(F.col(c) != 4, F.col(c) % m)
    none = lambda v, m: None if v == 4 else v % m
    for pairs in ([("a", "c"), ("b", "d")], [("a", "b"), ("b", "c")], [("a", "b"), ("a", "d")]):
        rules = [Dependency(x, y, key(x, 2), key(y, 3)) for x, y in pairs]
        got = best_rows(df, F.col("g"), [Bundle(c, (c,)) for c in names], [(F.col("t"), 2)], "row_id", rules)
        for r in got.collect():
            own = [x for x in rows if x["g"] == r.id_key]
            vec = lambda x: (-(10**20) + 1 if x["t"] is None else x["t"], -x["row_id"]) if x else (-(10**25) + 1, -(10**25) + 1)
            best = max(
                (
                    tuple(map(sum, zip(*map(vec, p))))
                    for p in itertools.product(*[[x for x in own if x[c] is not None] + [None] for c in names[: 3 if "d" not in sum(pairs, ()) else 4]])
                    for q in [dict(zip(names, p))]
                    if all(not (q[x] and q[y]) or None in (k := (none(q[x][x], 2), none(q[y][y], 3))) or k[0] == k[1] for x, y in pairs)
                ),
            )
            chosen = {c: next((x for x in own if x["row_id"] == r[c]), None) for c in names}
            used = [chosen[c] for c in names[: 3 if "d" not in sum(pairs, ()) else 4]]
            assert tuple(map(sum, zip(*map(vec, used)))) == best
            assert all(not (chosen[x] and chosen[y]) or None in (k := (none(chosen[x][x], 2), none(chosen[y][y], 3))) or k[0] == k[1] for x, y in pairs)


def test_trust_must_fit(spark):
    df = spark.createDataFrame([(1, "g", 7)], "row_id long, g string, a long")
    make = lambda level, i="row_id": best_rows(df, F.col("g"), [Bundle("A", ("a",))], [level], i)
    assert [r.A for r in make((F.lit(98), 2)).collect()] == [1]
    with pytest.raises(ValueError):
        make((F.lit(1), 20))
    for bad in (99, -1):
        with pytest.raises(Exception, match="level of trust"):
            make((F.lit(bad), 2)).collect()


def test_root_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, "g", 7)], "row_id long, g string, a long")
    plan = best_rows(df, F.col("g"), [Bundle("A", ("a",))], [(F.col("a"), 3)], "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan


def test_groups_without_candidates_ties_and_empty(spark):
    df = spark.createDataFrame([(2, "g", None), (1, "g", None), (5, "h", 1.0), (4, "h", 1.0), (9, " - ", 1.0), (8, None, 1.0)], "row_id long, id string, a double")
    make = lambda d: best_record(d, id_key("id"), [Bundle("A", ("a",))], [(F.lit(0), 1)], "row_id")
    got = {r.id_key: r.A and r.A.row_id for r in make(df).collect()}
    assert got == {"G": None, "H": 4}
    assert make(df.limit(0)).count() == 0


@pytest.fixture
def contradicting(spark, tmp_path):
    """Row 3 is the latest measured one but has no potency, and its label contradicts the potency of row 1."""
    day = lambda d: datetime(2025, 1, d)
    rows = [
        (1, "A-1", 7.0, 100, "C", day(1)), (2, "a 1", 3.0, -1, "C", day(3)), (3, "A1", float("nan"), 1000, "CC", day(2)), (4, "B2", 5.0, 0, "N", day(1)),
        (5, "C3", None, 5, None, None), (6, "c-3", None, None, "O", day(1)), (7, None, 6.0, 10, "O", day(1)), (8, " - ", 6.0, 10, "O", day(1)),
    ]
    df = spark.createDataFrame(rows, "row_id long, id string, pIC50 double, ic50 long, smiles string, reported_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/raw_compounds.parquet")
    return str(tmp_path)


def test_fields_are_found_in_one_pass(spark, contradicting):
    found = compound_queries.p1_found(spark, contradicting)
    assert all("/raw_compounds.parquet/" in f for f in found.inputFiles())  # nothing is stored on the way
    assert {tuple(r) for r in found.collect()} == {("A1", "id", 3), ("A1", "pIC50", 1), ("A1", "ic50", 3), ("C3", "id", 5), ("C3", "ic50", 5)}


@pytest.mark.parametrize("name", ["p1_found", "p1_consistent"])
def test_declared_rules_change_the_rows(spark, contradicting, monkeypatch, name):
    declared = []

    def without_rules(df, group, fields, trust, row_id, dependencies=()):
        declared.extend(dependencies)
        return best_rows(df, group, fields, trust, row_id)

    query = compound_queries.QUERIES[name]
    with_rules = rows_of(query(spark, contradicting))
    for module in (bundles, compound_queries):
        monkeypatch.setattr(module, "best_rows", without_rules)
    assert (rows_of(query(spark, contradicting)) != with_rules) == bool(declared)


def test_canonical_parts():
    parts = smiles_parts()
    same = ["CC(=O)O.[Na+].Cl", " [NA+].CC(=O)O.cL;", '<"Cl.C C(=O)​O.[na+]">', "“CC(=O)O.CL.[Na+]”, ", "（CC(=O)O.[Na⁺].Cl）"]
    assert len({tuple(sorted(parts(s))) for s in same}) == 1
    apart = ["c1ccccc1", "C1CCCCC1", "[nH]", "[NH]", "[CH3]", "C.C", "C", "[O-]", "O", "CO", "[Co]", "C[C@H](N)O", "C[C@@H](N)O", "F/C=C/F", "F\\C=C/F", "F/C=C\\F"]
    assert len({tuple(sorted(parts(s))) for s in apart}) == len(apart)
    assert parts("[O−]") == ["[O-]"] and parts("cBR") == ["cBr"] and parts("[13c]cl") == ["[13c]Cl"]
    assert parts(" ​;") == [] and parts("") == []


def test_copies_and_collapse(spark):
    rows = [(7, "CCl.O"), (3, "O.CCL"), (5, "CCl.O"), (1, None), (2, "  "), (4, "C" * 50_000), (6, "C" * 50_000 + ";"), (8, "O")]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "row_id long, smiles string, tuple string")
    assert {tuple(r) for r in copies(df, "row_id", "smiles").collect()} == {(3, 5), (3, 7), (4, 6)}
    assert {(r.first_row_id, r.value, r.copies, r.spellings) for r in collapse(df, "row_id", "smiles").collect()} == {
        (3, "CCl.O", 3, 2), (4, "C" * 50_000 + ";", 2, 2), (8, "O", 1, 1)
    }
    assert copies(df.limit(0), "row_id", "smiles").count() == 0


def test_columns_of_one_dictionary_share_no_tuple(spark):
    rows = [("a", 1, "CCl"), ("a", 2, "C CL"), ("b", 1, "CCl"), ("b", 3, "O"), ("b", 4, None), ("a", 5, " ")]
    df = spark.createDataFrame([(t, i, s and f"{t}\0{s}") for t, i, s in rows], "t string, row_id long, smiles string")
    assert {tuple(r) for r in copies(df, "row_id", "smiles", ["t"], parts=tagged_parts).collect()} == {("a", 1, 2)}
    assert {(r.value, r.copies) for r in collapse(df, "row_id", "smiles", parts=tagged_parts).collect()} == {("a\0CCl", 2), ("b\0CCl", 1), ("b\0O", 1)}
