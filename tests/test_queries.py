import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sievemark.queries import evidence

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle import norm  # noqa: E402

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("p1_", "p2_", "p3_", "p6_", "p7_", "p8_"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "field_name", "record_id", "ref_key", "orphan_kind", "period_month"]


def test_evidence_lifts_pairs_over_the_threshold(spark):
    rows = lambda name: {(r.question_id, r.video_id): r.score for r in entry.queries()[name](spark, DATA).collect()}
    plain, whole = rows("family_score_v3"), rows("visual_gate")
    assert len(whole) > len(plain) and all(whole[k] >= s for k, s in plain.items() if k in whole)


@pytest.mark.parametrize("name", ["family_score_v3", "visual_gate"])
def test_pairs_of_the_third_generation_stay_in_their_task(spark, con, name, monkeypatch):
    """Only rows are shuffled, also if cells are small; nothing is joined by the knowledge that rows share."""
    monkeypatch.setattr(evidence, "CELL_VIDEOS", 5)
    monkeypatch.setattr(evidence, "CELL_QUESTIONS", 4)
    df = entry.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "knowledge" not in plan
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), columns)


def test_evidence_is_only_read_where_it_counts(spark, con, monkeypatch):
    def parts(*_):
        raise AssertionError("evidence was read")

    monkeypatch.setattr(evidence, "evidence_parts", parts)
    assert entry.queries()["family_score_v3"](spark, DATA).count() == con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()['family_score_v3']})").fetchone()[0]
