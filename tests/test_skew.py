import itertools
import random

import pytest
from pyspark.sql import functions as F

from assayloom import shared
from assayloom.functions.spelling import smiles_parts
from assayloom.operators import skew
from assayloom.operators.packed import unpack


def test_a_key_of_most_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_A_TASK", 50)
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.6 else rnd.choice([None, *"abcdefgh"])) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, k string")
    counted = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
    got = skew.salted_lookup(df, counted, "k", "row_id")
    assert sorted((r.row_id, r.k) for r in got.collect()) == sorted(r for r in rows if r[1])
    assert "_salt" not in got.columns and "[k" in got._jdf.queryExecution().toString() and "_salt" in got._jdf.queryExecution().toString()
    n = sum(k == "hot" for _, k in rows)
    assert {r.k: r.s for r in counted.select("k", skew.salts("n_rows").alias("s")).collect()}["hot"] == -(-n // 50)


def test_pairs_within_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_A_TASK", 40)
    groups = {1: range(30), 2: range(30, 32), 3: [99]}
    df = spark.createDataFrame([(g, i, len(v)) for g, v in groups.items() for i in v], "g long, i long, n long")
    got = [tuple(r) for r in skew.within_groups(df, "g", "i", "n").collect()]
    want = [(g, *p) for g, v in groups.items() for p in itertools.combinations(v, 2)]
    assert sorted(got) == sorted(want)
    assert skew.within_groups(df.limit(0), "g", "i", "n").count() == 0


def test_a_list_has_commas_whatever_the_separators(spark):
    df = spark.createDataFrame([(1, '["a","b"]'), (2, "c;d"), (3, "e,f"), (4, '["g"]')], "row_id long, f string")
    got = {(r.row_id, r.pos, r.value) for r in unpack(df, "row_id", ["f"], separators=";", least=2).collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")}


def test_brackets_that_wrap_the_whole_string_are_one_pair():
    parts = smiles_parts()
    assert parts("(C)(N)") == ["(C)(N)"] and parts("(CN)") == ["CN"] and parts("((C)(N))") == ["(C)(N)"]


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
