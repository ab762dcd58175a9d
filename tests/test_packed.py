"""Packed cells: one row per value."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitagraph.operators.packed import FIELDS, packed_values, split_packed

CASES = [
    ("mesh_terms", "['A, B', 'C']", ["A, B", "C"]),
    ("mesh_terms", '["So-Called \\"Silent\\" Lesion", "X"]', ['So-Called "Silent" Lesion', "X"]),
    ("mesh_terms", '"So-Called ""Silent"" Lesion", Y', ['So-Called "Silent" Lesion', "Y"]),
    ("mesh_terms", 'So-Called "Silent" Lesion; Y', ['So-Called "Silent" Lesion', "Y"]),
    ("mesh_terms", "A, B; C", ["A, B", "C"]),
    ("mesh_terms", "A, B", ["A", "B"]),
    ("mesh_terms", "[A, B [C], D]", ["A", "B [C]", "D"]),
    ("mesh_terms", "• A, b • C", ["A, b", "C"]),
    ("mesh_terms", "A;; ; B;", ["A", "B"]),
    ("mesh_terms", "A\r\nB\r\n", ["A", "B"]),
    ("mesh_terms", "[]", []),
    ("mesh_terms", "", []),
    ("mesh_terms", " \t ", []),
    ("mesh_terms", None, None),
    ("mesh_terms", "A; A", ["A", "A"]),
    ("keywords", "{a; 'b; c'}", ["a", "b; c"]),
    ("keywords", "orlan's sign; b", ["orlan's sign", "b"]),
    ("authors", "Bri, W., Jr.;Dal, F. K. ; ", ["Bri, W., Jr.", "Dal, F. K."]),
    ("authors", "['D'Ost, C.', \"O'Neil, B.\"]", ["D'Ost, C.", "O'Neil, B."]),
    ("authors", "A Bee, C Dee & E Eff", ["A Bee", "C Dee", "E Eff"]),
    ("authors", "A Bee | C Dee Jr.,E Eff and G Gee", ["A Bee", "C Dee Jr.", "E Eff", "G Gee"]),
    ("mesh_terms", 'x,          "a, b",c', ["x", "a, b", "c"]),
    ("mesh_terms", "a\x02b; c\x04", ["a\x02b", "c\x04"]),
    ("mesh_terms", 'x, y; "b, c"', ["x, y", "b, c"]),
    ("mesh_terms", '"b, c"', ["b, c"]),
    ("authors", '"Bri, W." & "Dal, F. K."', ["Bri, W.", "Dal, F. K."]),
    ("attributes", 'a=1, b=2, "note=x, y; z"', ["a=1", "b=2", "note=x, y; z"]),
    ("attributes", '{"a=1"; "b=p|q"}', ["a=1", "b=p|q"]),
]


def test_styles(spark):
    for field, how in FIELDS.items():
        mine = [(c, w) for f, c, w in CASES if f == field]
        rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(mine)], "i int, c string").select("i", packed_values(F.col("c"), **how).alias("v")).collect()
        got = {r.i: r.v for r in rows}
        for i, (cell, want) in enumerate(mine):
            assert got[i] == want, cell


def test_rows_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a; b", "x"), (1, "a; b", "y"), (2, None, "z")], "row_id int, keywords string, pos string")
    rows = split_packed(df, ["row_id"], {"keywords": FIELDS["keywords"]})
    assert rows.columns == ["row_id", "field_name", "pos", "item"]
    assert sorted(map(tuple, rows.collect())) == sorted([(1, "keywords", 1, "a"), (1, "keywords", 2, "b")] * 2)
    assert split_packed(df.limit(0), ["row_id"], {"keywords": FIELDS["keywords"]}).count() == 0


def test_very_long_cell(spark):
    cell = "; ".join(f"term {i}" for i in range(30_000)) + '; "' + "q, " * 30_000 + 'q"'
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(F.size(packed_values(F.col("c")))).first()[0] == 30_001


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc ,;|'x", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_double_quoted_round_trip(spark, values):
    cell = "[" + ", ".join('"' + v + '"' for v in values) + "]"
    assert spark.createDataFrame([(cell,)], "c string").select(packed_values(F.col("c"))).first()[0] == values


@pytest.mark.parametrize("field", ["authors", "mesh_terms"])
def test_null_column(spark, field):
    df = spark.createDataFrame([(1, None)], f"row_id int, {field} string")
    assert split_packed(df, ["row_id"], {field: FIELDS[field]}).count() == 0
