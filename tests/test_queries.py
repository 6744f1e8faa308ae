import math
import os

import duckdb
import pytest

from labelmill.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return f"{float(x):.6f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(norm(r[k]) for k in at) for r in want.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got.collect()) == expected
    assert expected


def test_rows_only_queries(spark):
    import random

    from labelmill.operators import splits
    from labelmill.sources import adapters

    assert QUERIES["weighted_sample"](spark, SF).count() == 1000
    assert QUERIES["enrich_stub"](spark, SF).where("response is null").count() == 0
    batch = {r.record_id: (round(r.ema, 6), r.cnt) for r in QUERIES["q_ema_replay"](spark, SF).collect()}
    stream = {r.record_id: (round(r.ema, 6), r.cnt) for r in QUERIES["stream_ema"](spark, SF).collect()}
    assert stream == batch
    rows = adapters.records(spark, SF)
    found = {r.id: r.split for r in QUERIES["exact_seed_split"](spark, SF).collect()}
    groups: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.ord):
        groups.setdefault(r.paraphrase_group_id or r.id, []).append(r.id)
    order = list(groups.values())
    random.Random(42).shuffle(order)
    n = len(found)
    want, test, val = {}, 0, 0
    for unit in order:
        split = "test" if test < max(1, int(n * 0.1)) else "val" if val < max(1, int(n * 0.1)) else "train"
        test += len(unit) * (split == "test")
        val += len(unit) * (split == "val")
        want |= dict.fromkeys(unit, split)
    assert found == want
    assert splits.split_records_exactly(rows, stratify_by="source_dataset").groupBy("unit" if "unit" in rows.columns else "id").count().where("count > 1").isEmpty()


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
