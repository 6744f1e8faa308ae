"""What is found in parts, looked up, or stopped: percentiles, records, table functions, failures over all tasks."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import arrays, tables, text
from labelmill.operators import tracker
from labelmill.plans import enrich
from labelmill.sources import readers


@pytest.mark.parametrize("kind", ["spread", "ties", "far apart", "one", "two"])
def test_percentiles_by_counting(spark, kind, monkeypatch):
    monkeypatch.setattr(tracker, "RANGES", 8)
    rng = random.Random(kind)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(2000)],
        "ties": [float(rng.randrange(4)) for _ in range(1001)],
        "far apart": [rng.choice([1e-300, 3e-300, 1.0, 1.0 + 2**-50, 1e300, -1.7e308, 1.7e308]) for _ in range(500)],
        "one": [2.5],
        "two": [1.0, 4.0],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "weight double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    ranked = sorted(values)
    want = []
    for q in shares:
        x = q * (len(ranked) - 1)
        lo, hi = ranked[int(np.floor(x))], ranked[int(np.ceil(x))]
        want.append(lo + (hi - lo) * (x - np.floor(x)))
    assert tracker.exact_percentiles(df, "weight", shares) == want


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "weight double")
    assert tuple(tracker.weight_quantiles(df).first()) == (None,) * 4


def test_table_functions_in_sql(spark):
    said = ["- one\n* two \n3) three\nplain", None, "", "no bullets", "- it's \\\\ 'quoted'\n-   "]
    df = spark.createDataFrame(list(enumerate(said)), "id long, said string")
    tables.with_table_functions(spark)
    got = spark.sql("SELECT d.id, b.pos, b.bullet FROM {df} d, LATERAL bullets(d.said) b", df=df)
    want = df.select("id", F.posexplode(text.mask_bullets(F.col("said"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    outer = spark.sql("SELECT d.id, b.bullet FROM {df} d LEFT JOIN LATERAL bullets(d.said) b ON true", df=df)
    assert {r.id for r in outer.collect()} == set(range(5))
    claims = spark.sql("SELECT d.id, c.pos, c.claim FROM {df} d, LATERAL claim_lines(d.said) c", df=df).collect()
    assert [(r.pos, r.claim) for r in claims if r.id == 0] == [(0, "one"), (1, "two")]
    spans = spark.createDataFrame([(1, 2, 5), (2, 3, 3), (3, 9, 4)], "id int, a long, b long")
    places = spark.sql("SELECT s.id, t.place FROM {spans} s, LATERAL token_places(s.a, s.b) t", spans=spans).collect()
    assert [tuple(r) for r in places] == [(1, 2), (1, 3), (1, 4)]
    same = spans.select("id", F.explode(arrays.positions(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))))
    assert [tuple(r) for r in same.collect()] == [(1, 2), (1, 3), (1, 4)]
    assert [r.candidate for r in spark.sql("SELECT c.candidate FROM VALUES (3), (0) AS v(n), LATERAL candidates(v.n) c").collect()] == [0, 1, 2]


def scanned(df):
    """Rows that the scans of an executed plan gave, after row groups and pages were left out."""
    rows = df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        metric = leaf.metrics().get("numOutputRows")
        out += metric.get().value() if metric.isDefined() else 0
    return rows, out


def test_lookups_by_record_read_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "LOOKUP_BYTES", 64 << 10)
    path = f"{tmp_path}/acts"
    n = 40_000
    ids = F.sha2(F.col("id").cast("string"), 256)
    acts = spark.range(n).select(F.lit("train").alias("split"), (F.col("id") % 2).cast("int").alias("layer"), ids.alias("record_id"), F.array(F.rand(3), F.rand(4)).alias("acts"))
    readers.write_by_record(acts.union(acts.limit(50).withColumn("split", F.lit("val"))), path, distinct=n)
    name = acts.where("layer = 1").select("record_id").orderBy("record_id").first()[0]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, read = scanned(readers.by_record(spark, path, "train", [0, 1], [name]))
        assert len(rows) == 1 and rows[0].record_id == name and read < n // 100
        names = [r[0] for r in acts.select("record_id").orderBy(F.rand(1)).limit(25).collect()]
        assert {r.record_id for r in readers.by_record(spark, path, "train", [0, 1], names).collect()} == set(names)
        rows, read = scanned(readers.by_record(spark, path, "train", [0, 1], ["f" * 64]))
        assert not rows and read < n // 100
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert readers.by_record(spark, path, "train", [0], []).count() == 0
    plan = readers.by_record(spark, path, "train", [0], [name])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "PartitionFilters" in plan


def test_runs_of_failures_join_as_one_sequence():
    rng = random.Random(1)
    for _ in range(300):
        answers = [rng.random() < 0.4 for _ in range(rng.randrange(30))]
        cut = sorted(rng.randrange(len(answers) + 1) for _ in range(3))
        parts = [answers[a:b] for a, b in zip([0, *cut], [*cut, len(answers)], strict=True)]
        joined = enrich.FailureRuns()
        for p in parts:
            joined = joined.then(enrich.FailureRuns.of(p))
        longest = max((len(x) for x in "".join("01"[ok] for ok in answers).split("1")), default=0)
        assert joined == enrich.FailureRuns.of(answers) and joined.longest == longest


def test_failures_over_all_tasks_stop_the_job(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.makedirs(log)

    def client(requests):
        import time
        import uuid

        time.sleep(0.05)
        open(f"{log}/{uuid.uuid4().hex}-{len(requests)}", "w").close()
        return [None if r.startswith("bad") else r.upper() for r in requests]

    bad = spark.createDataFrame([(i, f"bad {i}") for i in range(2000)], "id long, prompt string")
    out = str(tmp_path / "out")
    # no task of eight sees thirty failures by itself
    with pytest.raises(enrich.CircuitOpen):
        enrich.enriched_to(bad, "id", "prompt", client, "answer", out, limit=30, task_rows=8)
    asked = sum(int(f.rsplit("-", 1)[1]) for f in os.listdir(log))
    assert 30 <= asked < 1500
    assert not [f for _, _, names in os.walk(out) for f in names if f.startswith("part-")]
    mixed = spark.createDataFrame([(i, f"bad {i}" if i % 10 == 0 else f"good {i}") for i in range(200)], "id long, prompt string")
    got = {r.id: r.answer for r in enrich.enriched_to(mixed, "id", "prompt", client, "answer", out, limit=30, task_rows=50).collect()}
    assert got == {i: None if i % 10 == 0 else f"GOOD {i}" for i in range(200)}
