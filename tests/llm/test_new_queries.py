import os

import duckdb
import pytest

from labelmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_dual_tree_lloyd", "op12_streaming_infill", "op13_cover_tree_dup"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))
