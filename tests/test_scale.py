"""What only shows with several partitions, files of unlike size, or services that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from labelmill.operators import batches, mining, splits, tracker
from labelmill.plans import enrich, manifest
from labelmill.plans.timings import Timings
from labelmill.sources import readers
from labelmill.storage import shared_folder, staged, unstaged, write_text


@pytest.fixture(params=["true", "false"])
def narrow(spark, request):
    """Small partitions, with and without adaptive coalescing."""
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": request.param, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.shuffle.partitions": "17"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbering_loses_no_row(narrow):
    df = narrow.range(60_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("wide"))
    got = batches.numbered(df, ["k", "id"])
    assert got.columns == ["k", "id", "wide", "rn"]
    rows = got.select("rn", "k", "id").toPandas().sort_values("rn")
    assert rows.rn.tolist() == list(range(60_000)) and rows.k.is_monotonic_increasing and rows.id.nunique() == 60_000
    # pruned columns change nothing
    assert got.select("rn").distinct().count() == 60_000
    sharded = batches.length_batches(df, "k", "id", 100, 1000).groupBy("shard").count().collect()
    assert sorted((r["shard"], r["count"]) for r in sharded) == [(i, 1000) for i in range(60)]
    placed = batches.shard_order(df.withColumn("shard", F.col("id") % 7), "shard", "id", 3, 1)
    assert placed.agg(F.count_distinct("position"), F.max("position")).first()[:] == (60_000, 59_999)


def test_draws_follow_weights(narrow, monkeypatch):
    monkeypatch.setattr(tracker, "CHUNK_BITS", 8)
    weights = narrow.range(20_000).select(F.col("id").alias("idx"), F.when(F.col("id") == 12_345, 20_000.0).otherwise(1.0).alias("weight"))
    draws = tracker.weighted_draws(weights, 10_000, 5)
    assert draws.select("draw").distinct().count() == 10_000
    heavy = draws.where("idx = 12345").count()
    assert 4700 < heavy < 5300
    assert draws.where("idx < 10000").count() > 2200
    flat = tracker.weighted_draws(weights.withColumn("weight", F.lit(0.0)), 3000, 5)
    assert flat.count() == 3000 and flat.select("idx").distinct().count() > 2500


def lines(path, names):
    path.write_text("".join(json.dumps({"id": n, "prompt": "p", "response": "r", "instruction_set": "- x", "source_dataset": "s"}) + "\n" for n in names))
    return str(path)


def test_lines_keep_the_order_of_files_and_places(narrow, tmp_path):
    a = lines(tmp_path / "a.jsonl", [f"a{i}" for i in range(5)])
    b = lines(tmp_path / "b.jsonl", [f"b{i}" for i in range(4000)])
    c = lines(tmp_path / "c.jsonl", [f"c{i}" for i in range(9)])
    want = [*(f"b{i}" for i in range(4000)), *(f"a{i}" for i in range(5)), *(f"c{i}" for i in range(9))]
    rows = readers.dataset(narrow, [b, a, c])
    assert rows.rdd.getNumPartitions() > 2
    assert [r.id for r in rows.orderBy("ord").select("id").collect()] == want
    path = str(tmp_path / "mask.json")
    assert manifest.write_mask(rows, path) == len(want) and json.loads(open(path).read()) == want
    assert [r.id for r in splits.units(rows).orderBy("first_ord").selectExpr("substring(unit, 3) as id").collect()] == want


def test_files_of_one_name_are_verified_apart(spark, tmp_path):
    import hashlib

    paths = {}
    for folder in ("x", "y"):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "data.bin").write_text(folder)
        paths[str(tmp_path / folder / "data.bin")] = hashlib.sha256(folder.encode()).hexdigest()
    readers.verified(spark, paths)
    a, b = paths
    with pytest.raises(ValueError, match="/x/"):
        readers.verified(spark, {a: paths[b], b: paths[b]})


def test_shards_are_of_one_size(narrow, tmp_path):
    acts = narrow.range(250).select(F.concat(F.lit("r"), "id").alias("record_id"), "id", F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.explode(F.array(F.lit(3), F.lit(7))).alias("layer"), F.array(F.array(F.lit(1.0))).alias("acts"))
    manifest.write_shards(acts, str(tmp_path / "acts"), 64, ["id"])
    sizes = {(r.split, r.layer, r["shard"]): r["count"] for r in narrow.read.parquet(str(tmp_path / "acts")).groupBy("split", "layer", "shard").count().collect()}
    assert sizes == {("train", k, s): n for k in (3, 7) for s, n in enumerate((64, 64, 64, 8))} | {("val", k, 0): 50 for k in (3, 7)}
    assert [r.id for r in narrow.read.parquet(str(tmp_path / "acts")).where("split = 'train' and layer = 3 and shard = 1").orderBy("id").limit(1).collect()] == [81]
    made = manifest.Manifest(layers=[3, 7])
    with pytest.raises(ValueError, match="in_progress"):
        readers.activation_table(narrow, str(tmp_path / "acts"), "train", [3], made=made)
    made.status = "complete"
    with pytest.raises(ValueError, match="layers"):
        readers.activation_table(narrow, str(tmp_path / "acts"), "train", [3, 4], made=made)
    assert readers.activation_table(narrow, str(tmp_path / "acts"), "train", [3], made=made).count() == 200


def test_removal_log_cuts_long_texts(spark):
    df = spark.createDataFrame([("1", "x" * 900, "l", "removed", "rule"), ("2", "p", None, "kept", "")], "id string, prompt string, instruction_set string, route string, rule string")
    got = manifest.removal_log(df).collect()
    assert len(got) == 1 and len(got[0].prompt) == 500


def test_failed_requests_are_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", f"q{i}") for i in range(40)], "id string, prompt string").coalesce(2)
    log = tmp_path / "calls"
    log.mkdir()

    def client(prompts):
        # each request fails the first time that it is seen
        out = []
        for p in prompts:
            seen = log / p
            out.append(p.upper() if seen.exists() else None)
            seen.write_text("")
        return out

    got = {r.id: r.response for r in enrich.enriched(df, "id", "prompt", client, "response", batch_size=4, tries=3, base_seconds=0.001, jitter=0.5, at_once=3).collect()}
    assert got == {f"k{i}": f"Q{i}" for i in range(40)}
    parsed = enrich.enriched(df, "id", "prompt", lambda ps: ["NO" if p == "q7" else p for p in ps], "response", tries=2, base_seconds=0.001, parse=lambda s: s[s.index("q") :], breaker=0)
    assert {r.id for r in parsed.collect() if r.response is None} == {"k7"}
    with pytest.raises(Exception, match="another number"):
        enrich.enriched(df, "id", "prompt", lambda ps: ps[1:], "response").collect()


def test_state_comes_back(spark, tmp_path):
    state = spark.createDataFrame([("a", 0.25, 3), ("b", -0.5, 1)], "record_id string, ema double, cnt long")
    tracker.save_state(state, str(tmp_path / "state"), 0.2)
    back, alpha = tracker.load_state(spark, str(tmp_path / "state"))
    assert alpha == 0.2 and sorted(back.collect()) == sorted(state.collect())
    ids = spark.createDataFrame([("a",), ("z",)], "record_id string")
    assert {r.record_id: r.ema for r in tracker.looked_up(ids, back).collect()} == {"a": 0.25, "z": 0.5}


def test_timings(spark):
    ticks = iter(range(100))
    t = Timings(lambda: next(ticks))
    for name in ("load", "judge", "load"):
        with t.phase(name):
            next(ticks)
    assert t.seconds == {"load": 4, "judge": 2} and t.total() == 6 and t.metrics() == {"timing/load_s": 4, "timing/judge_s": 2}
    assert t.line() == "total=6.00s | load=4.00s judge=2.00s"
    t.seconds = {k: float(v) for k, v in t.seconds.items()}
    both = t.table(spark, 1).union(t.table(spark, 2))
    assert {(r.phase, r.seconds, round(r.share, 4)) for r in mining.phase_seconds(both).collect()} == {("load", 8.0, 0.6667), ("judge", 4.0, 0.3333)}
    assert mining.phase_seconds(both, ["step"]).count() == 4
    t.reset()
    assert t.total() == 0
    traces = spark.createDataFrame([(1, None), (1, "boom"), (2, "")], "step long, judge_error string")
    assert {r.step: (r.errors, r.n) for r in mining.judge_errors(traces, ["step"]).collect()} == {1: (1, 2), 2: (0, 1)}


def test_storage(spark, tmp_path):
    t = staged(spark.range(5), "t")
    assert t.staged_at.startswith(shared_folder(spark)) and t.count() == 5
    path = t.staged_at.removeprefix("file:")
    assert os.path.exists(path)
    unstaged(t)
    assert not os.path.exists(path)
    write_text(spark, str(tmp_path / "x.txt"), (f"{i}," for i in range(1000)), block=64)
    assert (tmp_path / "x.txt").read_text() == "".join(f"{i}," for i in range(1000)) and not (tmp_path / "x.txt.tmp").exists()


def test_exact_split_moves_sizes_only(narrow):
    import random

    rng = random.Random(2)
    data = [(i, f"r{i}", rng.choice("abc"), f"g{i // 3}" if i % 4 else None) for i in range(900)]
    df = narrow.createDataFrame(data, "ord long, id string, source_dataset string, paraphrase_group_id string")
    for stratify in (None, "source_dataset"):
        groups: dict = {}
        for _, i, source, group in data:
            groups.setdefault(f"g:{group}" if group else f"r:{i}", []).append((i, source))
        buckets: dict = {}
        for unit, rows in groups.items():
            buckets.setdefault(rows[0][1] if stratify else "", []).append((unit, rows))
        want = {}
        for name in sorted(buckets):
            chosen = list(buckets[name])
            random.Random(42).shuffle(chosen)
            total = sum(len(rows) for _, rows in chosen)
            have = {"test": 0, "val": 0}
            for _, rows in chosen:
                split = next((s for s in ("test", "val") if have[s] < max(1, int(total * 0.1))), "train")
                if split != "train":
                    have[split] += len(rows)
                want |= {i: split for i, _ in rows}
        assert {r.id: r.split for r in splits.split_records_exactly(df, stratify_by=stratify).collect()} == want


def test_split_stays_as_it_was_written(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("ord"), F.concat(F.lit("r"), "id").alias("id"), F.lit("s").alias("source_dataset"), F.lit(None).cast("string").alias("paraphrase_group_id"))
    first = {r.id: r.split for r in splits.kept_split(df, str(tmp_path / "split"), seed=1).collect()}
    more = df.union(spark.range(200, 300).select("id", F.concat(F.lit("r"), "id"), F.lit("s"), F.lit(None).cast("string")))
    assert {r.id: r.split for r in splits.kept_split(more, str(tmp_path / "split"), seed=2).collect()} == first and len(first) == 200


def test_sequences_and_windows(spark):
    from labelmill.functions import arrays

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(arrays.tail(a(1, 2, 3), 2)) == [2, 3] and one(arrays.tail(a(1), 2)) == [1]
    assert one(arrays.tail_spliced(a(0, 0, 0, 0, 0), F.lit(1), a(1, 2, 3), 2)) == [0, 2, 3, 0, 0]
    shown = one(arrays.shown_window(a("He", "llo", " you"), 2))
    assert (shown.prefix, shown.window, shown.truncated, [tuple(p) for p in shown.pieces]) == ("He", "llo you", 1, [("llo", 1), (" you", 2)])
    for left, rows, mask, start in ((True, [0, 0, 7, 8, 9], [0, 0, 1, 1, 1], 4), (False, [7, 8, 9, 0, 0], [1, 1, 1, 0, 0], 2)):
        got = one(arrays.joined_sequence(a(7), a(8), a(9), F.lit(5), F.lit(0), left))
        assert (got.rows, got.mask, got.candidate_start) == (rows, mask, start)
    with pytest.raises(Exception, match="doesn't fit"):
        one(arrays.joined_sequence(a(7), a(8), a(9), F.lit(2), F.lit(0), True))
    got = one(arrays.retrieval_inputs(F.array(a(3.0, 4.0)), 10.0, F.array(a(1.0, 0.0)), F.array(a(0.0, 1.0))))
    assert got == [[1.0, 0.0], pytest.approx([6.0, 8.0]), [0.0, 1.0]]


def test_contexts_are_tokenised_with_the_response_start(spark):
    from labelmill.functions.tensors import plain_encoder, tokenised_context

    df = spark.createDataFrame([("a", "ask", "say it"), ("b", None, None)], "id string, prompt string, response string")
    encode = plain_encoder(lambda text: [len(w) for w in text.split()])
    got = {r.id: (r.ids, r.response_start) for r in tokenised_context(df, "id", "prompt", "response", encode).collect()}
    assert got == {"a": ([5, 3, 10, 3, 2], 3), "b": ([5, 10], 2)}
    system = lambda messages: [{"role": "system", "content": "be good"}, *messages]
    assert tokenised_context(df, "id", "prompt", "response", encode, system).where("id = 'a'").first().response_start == 6


def test_resuming_profiles_reports_and_paths(spark, tmp_path):
    assert [r.id for r in batches.after_first(spark.range(10), 7, ["id"]).orderBy("id").collect()] == [7, 8, 9] and batches.after_first(spark.range(3), 0, ["id"]).count() == 3
    profiles = {"default": {"layers": [1]}, "large": {"layers": [2]}}
    got = manifest.chosen_profile(profiles, {"PROFILE": ""})
    got["layers"].append(9)
    assert profiles["default"] == {"layers": [1]} and manifest.chosen_profile(profiles, {"PROFILE": "large"}) == {"layers": [2]}
    with pytest.raises(KeyError):
        manifest.chosen_profile(profiles, {"PROFILE": "none"})
    (tmp_path / "model.bin").write_bytes(b"abc")
    report = manifest.checkpoint_report(spark, {"best_reward": 1.0, "config": {"checkpoint_dir": "/home/x"}}, str(tmp_path / "model.bin"), "p")
    assert report["bytes"] == 3 and report["method"] == "grpo" and report["config"]["checkpoint_dir"] is None and report["sha256"].startswith("ba7816bf")
    (tmp_path / "out").mkdir()
    for name in ("a.jsonl", "b.removed.jsonl", "out/c.jsonl"):
        (tmp_path / name).write_text("{}")
    assert readers.input_paths(spark, [str(tmp_path / "*.jsonl"), str(tmp_path / "*/*.jsonl"), str(tmp_path / "a.jsonl")], str(tmp_path / "out")) == [f"file:{tmp_path}/a.jsonl"]


def test_scratch_tables_go(spark):
    from labelmill.storage import scratch

    there = lambda t: os.path.exists(t.staged_at.removeprefix("file:"))
    with scratch():
        with scratch() as keep:
            a, b = keep(staged(spark.range(3), "a")), staged(spark.range(4), "b")
        assert there(a) and not there(b) and a.count() == 3
        c = staged(spark.range(1), "c")
    assert not there(a) and not there(c)
    with pytest.raises(ZeroDivisionError), scratch() as keep:
        d = keep(staged(spark.range(3), "d"))
        1 / 0
    assert not there(d)


def test_small_tables_are_spread(spark, tmp_path, monkeypatch):
    from labelmill import storage

    spark.range(0, 400_000, 1, 1).select(F.xxhash64("id").alias("x"), "id").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = storage.spread(table)
    assert got.rdd.getNumPartitions() > 1 and got.agg(F.count_distinct("id")).first()[0] == 400_000
    monkeypatch.setattr(storage, "SPREAD_BYTES", 1 << 20)
    assert storage.spread(table) is table


def test_threads_keep_their_own_scratch_tables(spark):
    from threading import Barrier, Thread

    from labelmill.storage import CLEANUP, released, scratch

    before, found, both = spark.conf.get(CLEANUP, None), {}, Barrier(2, timeout=60)

    def work(name):
        for k in range(4):
            with scratch() as keep:
                both.wait()
                gone = staged(spark.range(k + 1).withColumn("name", F.lit(name)), name)
                both.wait()
                kept = keep(staged(gone.withColumn("again", F.col("id")), name))
            found.setdefault(name, []).append((kept.where(F.col("name") == name).count(), os.path.exists(gone.staged_at.removeprefix("file:")), kept))

    threads = [Thread(target=work, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {n: [x[:2] for x in v] for n, v in found.items()} == {n: [(k + 1, False) for k in range(4)] for n in ("one", "two")}
    assert spark.conf.get(CLEANUP, None) == before
    last, first = found["one"][-1][2], found["one"][0][2]
    both = last.join(first, "id")
    assert released(both) == 2 and not os.path.exists(last.staged_at.removeprefix("file:")) and released(spark.range(3)) == 0


def test_two_queries_at_once(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    from labelmill.plans.queries import QUERIES

    names = ["q_shards", "exact_seed_split", "q_shard_order", "q_shards"]
    want = {n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in dict.fromkeys(names)}
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())), names))
    assert got == [want[n] for n in names]
