import os

import pytest

from lexiforge.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_found_queries_have_the_columns_asked(spark):
    want = {
        "p1_found": "scope word mark", "p2_found": "field row_id pos alt", "p3_found": "id model pos", "p4_found": "set_name class_name",
        "p5_found": "case_id_a case_id_b", "p6_found": "item_id doc_id", "p7_found": "source", "p8_found": "doc_id",
    }
    for name, columns in want.items():
        d = catalog.queries()[name](spark, SF)
        assert d.columns == columns.split(), name
        rows = d.collect()
        assert len(rows) == len(set(rows)), name


def test_sql_gives_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name, sql in catalog.oracle_sql().items():
        d = catalog.queries()[name](spark, SF)
        cur = db.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(d.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in d.collect()))) == sorted(map(repr, cur.fetchall())), name
