"""Steps that come out of order, in pieces, or over several runs."""

import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelmill.operators import tracker
from labelmill.streaming import traces as stream


def states(rows):
    return {r.record_id: (round(r.ema, 9), r.cnt) for r in rows.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for step in range(25):
        for record in ("a", "b", "c", "d"):
            if rng.random() < 0.6:
                zero = rng.random() < 0.2
                out += [(step, record, 0.0 if zero else round(rng.random(), 3)) for _ in range(rng.randint(1, 4))]
    return out + [(3, "only zero", 0.0), (4, "", 0.5)]


def deliver(folder, files):
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(files):
        with open(f"{folder}/{k:03d}.json", "w") as f:
            f.writelines(json.dumps({"step": s, "record_id": r, "reward": w}) + "\n" for s, r, w in part)
        os.utime(f"{folder}/{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def test_files_out_of_order_and_split_steps(spark, tmp_path, rows):
    want = states(tracker.replayed(spark.createDataFrame([r for r in rows if r[1]], "step long, record_id string, reward double")))
    mixed = list(rows)
    random.Random(1).shuffle(mixed)
    # the rows of a step come in several files, later steps before earlier ones
    deliver(f"{tmp_path}/in", [mixed[k::4] for k in range(4)] + [[(None, "a", 1.0), (5, None, 1.0), (5, "a", None)]])
    source = stream.smoothed_stream(stream.trace_stream(spark, f"{tmp_path}/in", files_per_batch=1), late_steps=100)
    stream.run_until_read(source, f"{tmp_path}/out")
    # nothing is complete yet: a new run goes on where the last one stopped
    assert not os.path.exists(f"{tmp_path}/out/rows") or stream.latest(spark, f"{tmp_path}/out").count() == 0
    with open(f"{tmp_path}/in/zzz.json", "w") as f:
        f.write(json.dumps({"step": stream.CLOSING, "record_id": "", "reward": 0.0}) + "\n")
    stream.run_until_read(source, f"{tmp_path}/out")
    assert states(stream.latest(spark, f"{tmp_path}/out")) == want and "only zero" not in want


def test_steps_are_released_when_they_are_complete(spark, tmp_path):
    deliver(f"{tmp_path}/in", [[(1, "a", 0.5)], [(9, "b", 1.0), (2, "a", 1.0), (1, "a", 0.7)], [(30, "a", 0.1)]])
    stream.run_until_read(stream.smoothed_stream(stream.trace_stream(spark, f"{tmp_path}/in", files_per_batch=1), late_steps=10), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/rows").groupBy("record_id").agg(F.max("step").alias("step"), F.max("cnt").alias("cnt"), F.max_by("ema", "cnt").alias("ema")).collect()
    # step 30 says that before 20 all is there: 0.6, then 1.0; 30 itself stays open
    assert {(r.record_id, r.step, r.cnt, round(r.ema, 6)) for r in got} == {("a", 2, 2, 0.72), ("b", 9, 1, 1.0)}


def test_replay_equals_the_batch(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1]], "step long, record_id string, reward double")
    want = states(tracker.replayed(df))
    assert states(stream.replay_stream(df)) == want == states(stream.replay_stream(df, files=3))
    assert stream.replay_stream(df.limit(0)).count() == 0


def test_many_steps_cost_one_read_and_write_of_a_record():
    class Counted(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Handle:
        def getMapState(self, *_):
            return state

    state = Counted()
    fold = stream.InOrderOfSteps(0.5)
    fold.init(Handle())
    steps = list(range(3000))
    random.Random(3).shuffle(steps)
    table = pd.DataFrame([(r, s, 1.0 if s == 2999 else 0.0, s % 3 != 1) for s in steps for r in ("a", "b")], columns=["record_id", "step", "value", "counts"])
    (got,) = fold.handleInputRows((1,), iter([table[:2500], table[2500:]]), None)
    assert sorted(got.itertuples(index=False, name=None)) == [("a", 0.5, 2000, 2999), ("b", 0.5, 2000, 2999)]
    assert state.calls == 4 and dict(state) == {("a",): (0.5, 2000), ("b",): (0.5, 2000)}
    # a later batch goes on from there; a step that doesn't count leaves the average as it is
    (got,) = fold.handleInputRows((1,), iter([pd.DataFrame([("a", 3001, 9.0, False), ("a", 3000, 1.0, True)], columns=table.columns)]), None)
    assert list(got.itertuples(index=False, name=None)) == [("a", 0.75, 2001, 3001)]


def test_many_steps_over_several_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(step, f"r{rng.randrange(40)}", rng.choice((0.0, 0.25, 1.0))) for step in range(1200) for _ in range(20)]
    deliver(f"{tmp_path}/in", [rows[k : k + 4000] for k in range(0, len(rows), 4000)] + [[(stream.CLOSING, "", 0.0)]])
    began = time.monotonic()
    stream.run_until_read(stream.smoothed_stream(stream.trace_stream(spark, f"{tmp_path}/in", files_per_batch=1)), f"{tmp_path}/out")
    took = time.monotonic() - began
    want = states(tracker.replayed(spark.createDataFrame(rows, "step long, record_id string, reward double")))
    assert states(stream.latest(spark, f"{tmp_path}/out")) == want and len(want) == 40
    # the batches before the closing one have released steps already
    assert spark.read.parquet(f"{tmp_path}/out/rows").where(f"step < {rows[8000][0]}").count() > 0
    assert took < 60
