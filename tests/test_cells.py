import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.functions.cells import split_cell
from sievemark.operators.packed import record_cells, unpack

CASES = [
    (None, []),
    ("", []),
    (" \t　", []),
    ("a、b；c/d|e f", ["a", "b", "c", "d", "e", "f"]),
    ("a，，b", ["a", "b"]),
    ('"a,b";c', ["a,b", "c"]),
    ("“x“y,z”w”、q", ["x“y,z”w", "q"]),
    ('["a","b\\"c\\"d","e,f"]', ["a", 'b"c"d', "e,f"]),
    ('"A""B""C"|d', ['A"B"C', "d"]),
    ("it's/can't", ["it's", "can't"]),
    ('"open,a;b', ['"open', "a", "b"]),
    ("a“b,c”d、e", ["a“b,c”d", "e"]),
    ("(a,b)", ["a", "b"]),
    ("(a),(b)", ["(a)", "(b)"]),
    ("「a；b」", ["a；b"]),
    ('""', []),
    ("a\\b, c", ["a\\b", "c"]),
    ("x、x", ["x", "x"]),
]


def test_cases():
    for cell, want in CASES:
        assert split_cell(cell) == want, cell


@given(st.lists(st.text(alphabet='ab,;、" 「」', min_size=1, max_size=6), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(values):
    values = [v for v in values if v.strip()]
    cell = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_cell(cell) == values


@given(st.text(alphabet="a,\"'“”「」[]()\\ 、", max_size=30))
@settings(max_examples=500, deadline=None)
def test_any_text_is_read(cell):
    assert all(v.strip() for v in split_cell(cell))


def test_very_long_cells_take_linear_time():
    began = time.time()
    for cell in ('"' * 300_001, '"a' * 150_001, "“" * 200_000, "“" * 100_000 + "”" * 50_000, "a,b;" * 100_000):
        split_cell(cell)
    assert time.time() - began < 20


def test_rows(spark):
    rows = [("q1", "a、b", 2), ("q1", "a、b", 1), ("q2", None, 1), ("q3", "  ", 1), (None, "x", 1), ("q4", "“a;b”/a", None)]
    df = spark.createDataFrame([(k, c, t, "pos") for k, c, t in rows], "id string, tags string, imported_at int, item_value string")
    df = df.withColumn("imported_at", df.imported_at.cast("timestamp"))
    got = {tuple(r) for r in unpack(record_cells(df, "t", "id", ["tags"])).collect()}
    assert got == {("t", "q1", "tags", 1, "a"), ("t", "q1", "tags", 2, "b"), ("t", "q4", "tags", 1, "a;b"), ("t", "q4", "tags", 2, "a")}
    assert unpack(record_cells(df.limit(0), "t", "id", ["tags"])).collect() == []


def test_random_cells_against_plain_split():
    rng = random.Random(1)
    for _ in range(200):
        values = ["".join(rng.choice("甲乙丙abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]
        assert split_cell(rng.choice("，,、；/|\n\t　").join(values)) == values
