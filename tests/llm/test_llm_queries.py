import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from oracle import norm  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field_name", "id_a", "id_b"], "p2_found": ["field_name", "id_a", "id_b"], "p3_found": ["question_id", "rnk", "video_id"],
    "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject_code"],
}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith(("p1_", "p2_", "p3_", "p6_"))])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), columns)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name] and len(rows) == len(set(rows)) > 0
