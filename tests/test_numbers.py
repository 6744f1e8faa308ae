import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import arrays
from labelmill.functions.tensors import projected, sequence_logprobs, token_kl
from labelmill.operators import batches, mining, scoring, splits, tracker


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(("report", "truth", "kw", "want"), [(1, 5, {"under": True, "lam": 0.15}, 0.225), (3, 5, {"under": True, "lam": 0.15}, 0.0), (10, 5, {"lam": 0.15}, 0.375), (0, 4, {"under": True}, 0.3), (10, 0, {"under": True}, 0.0), (6, 4, {}, 0.0), (9, 4, {}, 0.3), (9, 4, {"over": False}, 0.0)])
def test_length_penalty(spark, report, truth, kw, want):
    got = rows(spark, [(report, truth)], "a int, b int").select(scoring.length_penalty(F.col("a"), F.col("b"), **kw).alias("x")).first().x
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("inst", "halluc", "n", "config", "want"), [([1.0, 1.0], [0.0, 0.5], 2, None, 0.375), ([1.0, 0.5, 0.0], [0.0, 0.0, 1.0], 3, None, 0.25 - 0.5 / 3), ([1.0, 1.0], [0.0] * 5, 2, None, 0.3), ([0.0] * 4, [], 4, scoring.RewardConfig.shipped(), -0.3), ([1.0], [0.0], 0, None, 0.5)])
def test_reward(spark, inst, halluc, n, config, want):
    got = rows(spark, [(inst, halluc, n)], "a array<double>, b array<double>, n int").select(scoring.reward(F.col("a"), F.col("b"), F.col("n"), config).alias("x")).first().x
    assert got.reward == pytest.approx(want)


def test_judge_scores(spark):
    df = rows(spark, [("INSTRUCTIONS: 1,0.5\nHALLUCINATIONS: 0",), ("lost",)], "a string")
    good, bad = (r.x for r in df.select(scoring.judge_scores(F.col("a"), F.lit(2), F.lit(2)).alias("x")).collect())
    assert good.instruction_scores == [1.0, 0.5] and good.hallucination_scores == [0.0, 0.0] and not good.error
    assert bad.instruction_scores == [0.0, 0.0] and bad.hallucination_scores == [] and bad.error


def test_tracker(spark):
    df = rows(spark, [(1, "a", 0.5), (2, "a", 1.0), (3, "a", 0.0), (3, "a", 0.0), (1, "b", 0.5), (1, "b", 0.7), (1, "b", 0.6)], "step long, record_id string, reward double")
    got = {r.record_id: (r.ema, r.cnt) for r in tracker.replayed(df).collect()}
    assert got["a"] == (pytest.approx(0.65), 2) and got["b"] == (pytest.approx(0.6), 1)
    more = rows(spark, [(9, "a", 1.0), (9, "c", 0.2)], "step long, record_id string, reward double")
    state = {r.record_id: (r.ema, r.cnt) for r in tracker.replayed(more, state=tracker.replayed(df)).collect()}
    assert state == {"a": (pytest.approx(0.3 + 0.7 * 0.65), 3), "b": (pytest.approx(0.6), 1), "c": (pytest.approx(0.2), 1)}
    assert tracker.replayed(df, skip_all_zero=False).where("record_id = 'a'").first().cnt == 3


@pytest.mark.parametrize(("value", "most", "default", "want"), [(0.1, 10.0, 0.5, 5.0), (0.9, 5.0, 0.5, 1.0), (0.0, 5.0, 0.5, 5.0), (-0.5, 5.0, 0.5, 5.0), (None, 5.0, 0.5, 1 / 0.6)])
def test_weights(spark, value, most, default, want):
    assert rows(spark, [(value,)], "a double").select(tracker.weight(F.col("a"), 0.1, most, default).alias("x")).first().x == pytest.approx(want)


def test_weighted_draws(spark):
    df = rows(spark, [(i, 1000.0 if i == 7 else 1.0) for i in range(50)], "idx long, weight double").repartition(5)
    drawn = [r.idx for r in tracker.weighted_draws(df, 2000, 3).collect()]
    assert len(drawn) == 2000 and drawn.count(7) > 1800
    flat = [r.idx for r in tracker.weighted_draws(df.withColumn("weight", F.lit(0.0)), 2000, 3).collect()]
    assert len(flat) == 2000 and max(map(flat.count, set(flat))) < 120
    with pytest.raises(ValueError):
        tracker.weighted_draws(df.limit(0), 5, 1)


@pytest.mark.parametrize(("n", "k", "strategy", "want"), [(200, 128, "last", (72, 200)), (200, 128, "first", (0, 128)), (50, 128, "middle", (0, 50)), (0, 128, "last", (0, 0)), (100, 10, "middle", (45, 55)), (10, 4, "last", (6, 10))])
def test_token_ranges(spark, n, k, strategy, want):
    got = rows(spark, [(n,)], "a long").select(arrays.token_range(F.col("a"), k, strategy).alias("x")).select("x", arrays.positions(F.col("x")).alias("p")).first()
    assert tuple(got.x) == want and got.p == list(range(*want))


def test_random_ranges_and_unknown_strategies(spark):
    df = rows(spark, [(i, 20) for i in range(40)], "id long, a long").select(arrays.token_range(F.col("a"), 5, "random", F.col("id"), 1).alias("x"))
    got = [tuple(r.x) for r in df.collect()]
    assert got == [tuple(r.x) for r in df.collect()] and len(set(got)) > 5 and all(0 <= a and b <= 20 and b - a == 5 for a, b in got)
    with pytest.raises(ValueError):
        arrays.token_range(F.lit(1), 1, "sideways")


def test_log_probabilities(spark):
    uniform = [[0.0, 0.0, 0.0]] * 4
    df = rows(spark, [(1, uniform, [-100, -100, -100, 1]), (2, uniform, [-100, 0, 1, 2]), (3, uniform, [-100] * 4), (4, [], [])], "id long, logits array<array<double>>, labels array<int>")
    for chunk in (1, 2, 256):
        got = {r.id: r for r in sequence_logprobs(df, "id", chunk=chunk).collect()}
        assert got[1].logp_sum == pytest.approx(-math.log(3)) and got[2].logp_sum == pytest.approx(-3 * math.log(3)) and got[2].logp_mean == pytest.approx(-math.log(3))
        assert got[3].logp_sum == 0.0 and got[3].n_tokens == 0 and got[4].logp_sum == 0.0


def test_divergences(spark):
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(3, 5)), rng.normal(size=(3, 5))
    df = rows(spark, [(1, p.tolist(), q.tolist(), [1, 0, 1]), (2, p.tolist(), p.tolist(), [1, 1, 1]), (3, p.tolist(), q.tolist(), [0, 0, 0])], "id long, policy array<array<double>>, reference array<array<double>>, mask array<int>")
    got = {r.id: r for r in token_kl(df, "id").collect()}
    soft = lambda x: x - np.log(np.exp(x).sum(-1, keepdims=True))
    want = sum((np.exp(soft(p[i])) * (soft(p[i]) - soft(q[i]))).sum() for i in (0, 2))
    assert got[1].kl_sum == pytest.approx(want) and got[1].kl_mean == pytest.approx(want / 2) and got[2].kl_sum == pytest.approx(0) and got[3].kl_mean == 0
    k3 = rows(spark, [(0.3, 0.3), (0.1, 0.9)], "a double, b double").select(scoring.k3(F.col("a"), F.col("b")).alias("x")).collect()
    assert k3[0].x == 0 and k3[1].x > 0


def test_losses(spark):
    pairs = rows(spark, [(5.0, 0.0, 0.0, 0.0)], "pi_chosen double, pi_rejected double, ref_chosen double, ref_rejected double")
    assert scoring.pair_losses(pairs).first().ipo_loss == pytest.approx(0)
    zero = scoring.pair_losses(rows(spark, [(1.0, 1.0, 0.0, 0.0)], "pi_chosen double, pi_rejected double, ref_chosen double, ref_rejected double")).first()
    assert zero.pair_accuracy == 0 and zero.dpo_loss == pytest.approx(math.log(2))
    group = rows(spark, [(1, 0.0, 2.0, 0.5), (1, 0.0, 1.0, 0.5), (2, 0.0, 3.0, 0.5), (2, 0.0, 2.0, 0.5)], "g long, reward double, policy_logp double, kl double")
    assert scoring.group_loss(group, ["g"], 1.0).first().loss == pytest.approx(0.5)


def test_projection_and_norms(spark):
    w, b = np.arange(6.0).reshape(2, 3), np.array([1.0, -1.0])
    df = rows(spark, [([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    got = [r.projected for r in projected(df, "v", w, b).collect()]
    assert got[0] == pytest.approx([9.0, 25.0]) and got[1] == pytest.approx([1.0, -1.0])
    some = rows(spark, [(None,), ([1.0, 2.0, 3.0],), (None,)], "v array<double>").coalesce(1)
    assert [r.projected for r in projected(some, "v", w).collect()] == [None, [8.0, 26.0], None]
    matched = [r.x for r in df.select(arrays.norm_matched(F.col("v"), 2.0).alias("x")).collect()]
    assert np.linalg.norm(matched[0]) == pytest.approx(2.0) and matched[1] == [0.0, 0.0, 0.0]


def test_array_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = F.array(*map(F.lit, (1, 2, 3)))
    assert one(arrays.cut_after(a, 2)) == [1, 2] and one(arrays.cut_after(a, 9)) == [1, 2, 3]
    assert one(arrays.spliced(a, F.lit(1), F.array(F.lit(9)))) == [1, 9, 2, 3]
    assert one(arrays.answer_labels(a, F.lit(1), F.lit(2))) == [-100, 2, -100]
    assert one(arrays.right_padded(a, F.lit(5), 0)) == [1, 2, 3, 0, 0]
    assert one(arrays.filled_mask(a, 5)) == [1, 1, 1, 0, 0] and one(arrays.padded(a, 2, F.lit(0))) == [1, 2]
    lr = spark.range(0, 12).select(arrays.learning_rate_factor(F.col("id"), 2, 10, 0.1).alias("x")).collect()
    assert lr[0].x == 0.5 and lr[1].x == 1.0 and lr[2].x == pytest.approx(1.0) and lr[10].x == pytest.approx(0.1) and lr[11].x == pytest.approx(0.1)
    assert one(arrays.learning_rate_factor(F.lit(7), 5, 6, 0.1)) == 1.0


@pytest.mark.parametrize("stratify", [None, "source_dataset"])
@pytest.mark.parametrize("seed", [42, 7])
def test_splits_keep_groups_and_fill_test_first(spark, stratify, seed):
    rng = random.Random(1)
    data = [(i, f"r{i}", f"s{rng.randint(0, 2)}", f"g{i // 3}" if rng.random() < 0.7 else None) for i in range(300)]
    df = rows(spark, data, "ord long, id string, source_dataset string, paraphrase_group_id string")
    for how in (splits.split_records, splits.split_records_exactly):
        got = {r.id: r.split for r in how(df, seed=seed, stratify_by=stratify).collect()}
        assert len(got) == 300
        by_group: dict = {}
        for _, i, _, g in data:
            if g:
                by_group.setdefault(g, set()).add(got[i])
        assert all(len(x) == 1 for x in by_group.values())
        n = [list(got.values()).count(s) for s in ("test", "val", "train")]
        assert 30 - 3 <= n[0] <= 40 and 27 <= n[1] <= 40
    tiny = rows(spark, data[:3], "ord long, id string, source_dataset string, paraphrase_group_id string")
    assert "test" in {r.split for r in splits.split_records(tiny, 0.0, 0.0).collect()}


def test_split_then_mask(spark):
    df = rows(spark, [(i, f"r{i}", "s", None, "" if i == 32 else "- x") for i in range(33)], "ord long, id string, source_dataset string, paraphrase_group_id string, instruction_set string")
    mask = rows(spark, [(f"r{i}",) for i in range(22)], "id string")
    assert splits.split_then_mask(df, mask).count() == 22 and splits.split_then_mask(df, None).count() == 32
    assert splits.orphans(rows(spark, [("r1",), ("zz",)], "id string"), df).collect()[0].id == "zz"
    with pytest.raises(ValueError):
        splits.require_rows(df.limit(0), "train")


def test_order_and_batches(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") * 37 % 101).alias("k"))
    got = batches.numbered(df, ["k", "id"]).orderBy("rn").collect()
    assert [(r.k, r.id) for r in got] == sorted((i * 37 % 101, i) for i in range(1000)) and [r.rn for r in got] == list(range(1000))
    assert batches.whole_batches(df.withColumn("b", F.floor(F.col("id") / 300)), "b", 300).count() == 900
    assert batches.hash_sample(df.withColumn("key", F.col("id").cast("string")), 0.1, 1, "key").count() == 100
    log = rows(spark, [(1, "a", 0), (1, "b", 1), (1, " ", 2), (2, None, 0)], "idx long, response string, at long")
    assert [tuple(r) for r in batches.last_written(log, "idx", "response", "at").collect()] == [(1, "b")]
    assert {tuple(r) for r in batches.restored(rows(spark, [(1,), (3,)], "idx long"), batches.last_written(log, "idx", "response", "at"), "idx", "response").collect()} == {(1, "b"), (3, "")}


def test_hard_ids(spark):
    meta = rows(spark, [(f"a{i}", "a") for i in range(6)] + [(f"b{i}", "b") for i in range(2)], "record_id string, source string")
    traces = rows(spark, [("a0", 0.2, None), ("a1", 0.9, None), ("a2", 0.1, None), ("a3", 0.0, "boom"), ("b0", 0.84, "")], "record_id string, reward double, judge_error string")
    ranked = {r.record_id: r["rank"] for r in mining.hard_ids(meta, traces).collect()}
    assert ranked == {"a2": 1, "a0": 2, "a3": 3, "a4": 4, "a5": 5, "b0": 1, "b1": 2}
    assert {r.record_id for r in mining.hard_ids(meta, traces, target=2).collect()} == {"a2", "a0", "b0"}
    assert {r.record_id for r in mining.hard_ids(meta, traces, exclude_unobserved=True).collect()} == {"a2", "a0", "b0"}
    assert {r.record_id for r in mining.hard_ids(meta, traces, min_observations=2).collect()} == {m.record_id for m in meta.collect()}
