import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.operators.packed import grammar, unpack

parse = grammar()
values = lambda s: [v[0] for v in parse(s)]


def test_alternatives_and_backtracking():
    assert values("a; b |c,,d;") == ["a", "b", "c", "d"]
    assert values('"pair ""in, out"" swap" / O-to-S / "para;meta"') == ['pair "in, out" swap', "O-to-S", "para;meta"]
    assert values(r'["set \"B\" tails", "[11*]C\\C=C\\C[1*]"]') == ['set "B" tails', r"[11*]C\C=C\C[1*]"]
    assert values(r'"a";"[11*]C\C=C\C[1*]"') == ["a", r"[11*]C\C=C\C[1*]"]
    assert values("5'-capping;2'-deoxy walk") == ["5'-capping", "2'-deoxy walk"]
    assert values("[2*]OCC([6*])C;[3*]C") == ["[2*]OCC([6*])C", "[3*]C"]
    assert [(v[0], v[3]) for v in parse('"open;b')] == [("open", "malformed quote"), ("b", None)]
    assert values("\t a \n\n b ") == ["a", "b"]
    assert parse("") == [] and parse(" ;;, ") == [] and values("[]") == ["[]"][:0]


text = st.text(st.characters(codec="ascii", exclude_characters="\r\n\\", exclude_categories=["Cc"]), min_size=1).filter(lambda s: s.strip() == s and s and s[0] not in "[")


@settings(max_examples=200, deadline=None)
@given(st.lists(text, min_size=1, max_size=6))
def test_round_trips(items):
    assert values(json.dumps(items)) == items
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, delimiter=";", lineterminator="").writerow(items)
    assert values(out.getvalue()) == items


def test_unpack_edge_cases(spark):
    rows = [(1, "a;b", "x"), (2, None, "  "), (3, "solo", '"quoted"'), (4, "a;a;;a", None), (4, "z" * 50_000 + ";y", "")]
    df = spark.createDataFrame(rows, "row_id long, f string, value string")  # `value` clashes with an output name
    got = {tuple(r) for r in unpack(df, "row_id", ["f", "value"], least=2).select("row_id", "field_name", "pos", "value").collect()}
    assert got == {(1, "f", 1, "a"), (1, "f", 2, "b"), (4, "f", 1, "a"), (4, "f", 2, "a"), (4, "f", 3, "a"), (4, "f", 1, "z" * 50_000), (4, "f", 2, "y")}
    assert unpack(df, "row_id", ["f"]).count() == 8
    assert unpack(df.limit(0), "row_id", ["f"]).count() == 0
