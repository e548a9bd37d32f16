from datetime import datetime

import pytest

from sievemark.operators import joins
from sievemark.operators.references import ForeignKey, Records, direct_orphans, orphan_cascade, orphan_report
from sievemark.operators.records import first_delivery
from pyspark.sql import functions as F


def day(n):
    return datetime(2030, 1, n) if n else None


@pytest.fixture
def graph(spark):
    parent = spark.createDataFrame([("p1", day(1), None), ("p2", day(1), None), ("p2", day(9), day(5)), ("p3", day(20), None)], "pid string, came timestamp, gone timestamp")
    child = spark.createDataFrame(
        [("c1", "p1", day(3)), ("c1", "p1", day(4)), ("c2", "p2", day(4)), ("c3", "p2", day(6)), ("c4", "p3", day(6)), ("c5", "nix", day(6)), ("c6", None, day(6)), ("c7", "", day(6)), ("c8", "p1 ", day(6)), ("c9", "p1", None), (None, "nix", day(6))],
        "cid string, pref string, at timestamp",
    )
    grand = spark.createDataFrame([("g1", "c1", day(7)), ("g2", "c3", day(7)), ("g3", "c5", day(7)), ("g4", "zz", day(7))], "gid string, cref string, at timestamp")
    great = spark.createDataFrame([("x1", "g3", day(8)), ("x2", "g1", day(8))], "xid string, gref string, at timestamp")
    tables = {"parent": Records("parent", parent, "pid", "came", "gone"), "child": Records("child", child, "cid", "at"), "grand": Records("grand", grand, "gid", "at"), "great": Records("great", great, "xid", "at")}
    edges = [ForeignKey("child", "pref", "parent", "at", first=True), ForeignKey("grand", "cref", "child", "at"), ForeignKey("great", "gref", "grand", "at")]
    return tables, edges


def test_direct(graph):
    got = {(r.table_name, r.record_id, r.orphan_kind, r.period_month) for r in direct_orphans(*graph).collect()}
    assert got == {("child", "c3", "deleted", "2030-01"), ("child", "c4", "late", "2030-01"), ("child", "c5", "missing", "2030-01"), ("child", "c8", "missing", "2030-01"), ("grand", "g4", "missing", "2030-01")}


def test_cascade(graph):
    got = {(r.table_name, r.record_id, r.orphan_class, r.steps) for r in orphan_cascade(*graph).collect()}
    assert {x for x in got if x[2] == "inherited"} == {("grand", "g2", "inherited", 1), ("grand", "g3", "inherited", 1), ("great", "x1", "inherited", 2)}
    report = orphan_report(orphan_cascade(*graph)).collect()
    assert sum(r.n_references for r in report) == len(got)


def test_cycle_ends(spark):
    t = spark.createDataFrame([("a", "b", day(1)), ("b", "c", day(1)), ("c", "a", day(1)), ("d", "nix", day(2)), ("e", "d", day(3)), ("f", "e", day(3))], "id string, ref string, at timestamp")
    tables, edges = {"t": Records("t", t, "id", "at")}, [ForeignKey("t", "ref", "t", "at")]
    got = {(r.record_id, r.orphan_class, r.steps) for r in orphan_cascade(tables, edges).collect()}
    assert got == {("d", "direct", 0), ("e", "inherited", 1), ("f", "inherited", 2)}


def test_empty_tables(graph):
    tables, edges = graph
    empty = {n: Records(t.name, t.df.limit(0), t.key, t.arrived, t.deleted) for n, t in tables.items()}
    assert orphan_cascade(empty, edges).count() == 0
    gone = {**tables, "parent": empty["parent"]}
    assert {r.orphan_kind for r in direct_orphans(gone, edges[:1]).collect()} == {"missing"}


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(-1, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("none", 4)], "k string, v int")
    for how in ("left", "inner"):
        got = sorted(map(tuple, joins.salted_join(left, right, ["k"], F.col("i"), how, salts=8, shares=10, least=100).select("i", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=str)
    assert [r.k for r in joins.hot_keys(left, ["k"], 10, 100).collect()] == ["hot"]


def test_first_delivery(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w"), (None, 1, "q"), ("c", 1, "m"), ("c", 1, "k")], "id string, t int, v string").withColumn("t", F.col("t").cast("timestamp"))
    assert {(r.id, r.v) for r in first_delivery(df, "id", "t", "v").collect()} == {("a", "y"), ("b", "w"), ("c", "k")}
