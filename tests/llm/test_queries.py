"""The registered queries of this subpackage on the smallest tables; those with SQL agree with it."""

import os

import pytest

from chunkloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": ["incoming_id"], "p2_found": ["file_id"], "p3_found": ["point_a", "point_b"], "p4_found": ["point_id", "function_name"], "p5_found": ["point_id"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert rows and len(rows) == len(set(rows))
    if name in queries.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for file in os.listdir(FOLDER):
            con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
        assert sorted(rows) == sorted(con.sql(queries.oracle_sql()[name]).fetchall())
