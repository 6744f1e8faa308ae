import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from labelmill.operators import rules
from labelmill.plans import enrich, manifest
from labelmill.sources import loaders, readers
from labelmill.streaming import traces as streams


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_jsonl_policies_and_legacy_names(spark, tmp_path):
    a = put(tmp_path / "a.jsonl", [{"id": "1", "source_dataset": "s", "prompt": "p", "response": "r", "instruction_set": "l", "metadata": {"paraphrase_group_id": "g"}}, "", {"id": "2", "prompt": "", "prompt_a": "old", "response_a": "r", "response_b": "l", "metadata": "text"}, {"id": "3", "prompt": "p", "response": "r", "metadata": [1]}, {"id": "4", "response": "r"}])
    b = put(tmp_path / "b.jsonl", ["{bad", "[1, 2]", {"id": "5", "prompt": "p", "response": "r"}])
    got = {r.id: r for r in readers.dataset(spark, [a, b, str(tmp_path / "gone.jsonl")]).collect()}
    assert set(got) == {"1", "2", "3", "5"}
    assert got["1"].paraphrase_group_id == "g" and got["2"].prompt == "old" and got["2"].instruction_set == "l" and got["2"].paraphrase_group_id is None
    assert {r.id for r in readers.dataset(spark, [a], require_label=True).collect()} == {"1", "2"}
    with pytest.raises(Exception, match="bad JSON line"):
        readers.jsonl(spark, [b], readers.RECORD_FIELDS).collect()
    with pytest.raises(Exception, match="(?i)path"):
        readers.jsonl(spark, [str(tmp_path / "gone.jsonl")], readers.RECORD_FIELDS).collect()
    assert readers.jsonl(spark, [str(tmp_path / "gone.jsonl")], readers.RECORD_FIELDS, missing="skip").count() == 0
    lines = readers.jsonl(spark, [a], readers.RECORD_FIELDS).orderBy("ord").select("id", "value").collect()
    assert [r.id for r in lines] == ["1", "2", "3", "4"] and json.loads(lines[0].value)["id"] == "1"


def test_masks_shards_and_digests(spark, tmp_path):
    put(tmp_path / "jsonl/x.jsonl", [{"id": "1"}])
    ids = spark.createDataFrame([(2, "b"), (1, "a"), (3, 'c"é')], "ord long, id string")
    path = str(tmp_path / "valid_record_ids.json")
    assert manifest.write_mask(ids, path) == 3 and json.loads(open(path).read()) == ["a", "b", 'c"é']
    assert [r.id for r in readers.mask(spark, path).collect()] == ["a", "b", 'c"é']
    assert readers.find_mask(spark, [str(tmp_path / "jsonl/x.jsonl")]) == path
    for k, source in ((0, "old"), (1, "new")):
        (tmp_path / f"shard-{k}.meta.json").write_text(json.dumps([{"record_id": "r", "source_dataset": source}, {"record_id": "", "source_dataset": "x"}]))
    assert [tuple(r) for r in readers.shard_meta(spark, str(tmp_path / "shard-*.meta.json")).collect()] == [("r", "new")]
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    readers.verified(spark, {path: digest})
    with pytest.raises(ValueError):
        readers.verified(spark, {path: "0" * 64})
    put(tmp_path / "out/y.jsonl", ["{}"])
    put(tmp_path / "jsonl/x.removed.jsonl", ["{}"])
    assert readers.input_files([str(tmp_path / "*/*.jsonl"), str(tmp_path / "jsonl/x.jsonl")], str(tmp_path / "out")) == [str(tmp_path / "jsonl/x.jsonl")]


def test_traces(spark, tmp_path):
    p = put(tmp_path / "t.jsonl", [{"step": 1, "record_id": "a", "reward": 0.5}, "{", {"step": "x", "record_id": "b", "reward": 1}, {"record_id": "c", "reward": 1}])
    assert readers.traces(spark, [p], typed=True).count() == 1
    assert readers.traces(spark, [str(tmp_path / "none.jsonl")], typed=True).count() == 0
    with pytest.raises(Exception, match="bad JSON"):
        readers.traces(spark, [p], policy="raise").collect()


def test_loaders(spark, tmp_path):
    tasks = spark.createDataFrame([(2, "t", "later", "x"), (1, "t", "do", "in"), (3, "u", " ", ""), (4, "u", "second", "")], "ord long, task_name string, definition string, inputs string")
    assert [(r.prompt, r.task_type) for r in loaders.REGISTRY["supernatural"].read(tasks).collect()] == [("do\n\nInput: in", "task_definition")]
    chats = spark.createDataFrame([(1, "p1", [("user", "u1")]), (2, "p2", [("system", "s"), ("user", "u2")]), (3, "p3", [])], "ord long, prompt string, messages array<struct<role:string,content:string>>")
    assert [r.prompt for r in loaders.REGISTRY["ultrachat"].read(chats).collect()] == ["p1"]
    assert [r.prompt for r in loaders.REGISTRY["if_multi_constraints"].read(chats).orderBy("ord").collect()] == ["u1", "u2"]
    plain = spark.createDataFrame([(1, " a "), (2, ""), (3, "b"), (4, "c")], "ord long, prompt string")
    assert [r.prompt for r in loaders.REGISTRY["ifeval"].read(plain, most=2).orderBy("ord").collect()] == ["a", "b"]
    both = loaders.collected({"ifeval": plain, "ultrachat": chats})
    assert both.count() == 4 and both.select("group_id").distinct().count() == 4
    with pytest.raises(KeyError):
        loaders.collected({"nothing": plain})
    p = put(tmp_path / "s.jsonl", [{"prompt": "x"}, "{bad"])
    assert loaders.synthetic_file(spark, p).count() == 1 and loaders.synthetic_file(spark, p + ".gone").count() == 0


def test_manifest_resume(tmp_path):
    m = manifest.Manifest(model_id="m", layers=[3])
    assert manifest.load_or_create(str(tmp_path), m) == m and not glob.glob(str(tmp_path / "*.tmp"))
    for name, value in (("split_seed", 1), ("layers", [4]), ("num_tokens", 1), ("token_position", "first"), ("records_per_shard", 2)):
        with pytest.raises(ValueError, match=name):
            manifest.load_or_create(str(tmp_path), manifest.Manifest(**{**m.__dict__, name: value}))
    manifest.finalized(str(tmp_path), m)
    assert manifest.load_or_create(str(tmp_path), manifest.Manifest(model_id="other")).model_id == "m"
    raw = json.loads((tmp_path / "manifest.json").read_text()) | {"unknown": 1}
    (tmp_path / "manifest.json").write_text(json.dumps(raw))
    assert manifest.Manifest.load(str(tmp_path / "manifest.json")).status == "complete"
    with pytest.raises(ValueError):
        manifest.may_resume(m, 2, False)
    with pytest.raises(ValueError):
        manifest.may_resume(manifest.Manifest(token_position="random"), 2, True)
    manifest.may_resume(m, 2, True)


def test_phases_ids_and_settings(tmp_path):
    p = manifest.PhaseMarker(str(tmp_path))
    assert p.get() == "prompts" and not p.reached("phase1")
    p.set("phase2")
    assert p.reached("phase1")
    for bad in (("other", None), ("done", 0)):
        with pytest.raises(ValueError):
            p.set(*bad)
    assert manifest.run_id({"a": 1, "b": 2}) == manifest.run_id({"b": 2, "a": 1}) != manifest.run_id({"a": 1, "b": 2}, "t")
    assert manifest.overlaid({"n": 1, "f": 0.5, "on": False, "s": None}, {"N": "3", "F": "", "ON": "true", "S": "x"}, {"n": "N", "f": "F", "on": "ON", "s": "S"}, {"f": 2.0}) == {"n": 3, "f": 2.0, "on": True, "s": "x"}
    (tmp_path / ".env").write_text("# c\nexport A='1'\nB=2\n")
    assert manifest.dotenv(str(tmp_path), {"B": "9"}) == {"A": "1", "B": "9"}
    with pytest.raises(ValueError):
        manifest.data_mode(None, None)
    with pytest.raises(FileNotFoundError):
        manifest.data_mode(str(tmp_path / "gone"), None)
    assert manifest.data_mode(str(tmp_path), None) == "cache"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "kept", "f1"), ("b", "removed", "f1"), ("c", "kept", "f2")], "value string, route string, source_file string")
    manifest.write_routes(df, str(tmp_path / "routes"))
    assert spark.read.json(str(tmp_path / "routes")).where("route = 'kept'").count() == 2
    for _ in range(2):
        manifest.write_jsonl(df.select("value"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and not os.path.exists(str(tmp_path / "j._writing"))
    manifest.write_kept_lines(df, F.col("route") == "kept", str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "c"]
    acts = spark.createDataFrame([(f"r{i}", "train", i % 2, [[1.0]]) for i in range(10)], "record_id string, split string, layer int, acts array<array<float>>")
    manifest.write_shards(acts.coalesce(1), str(tmp_path / "acts"), 2)
    valid = spark.createDataFrame([("r1",), ("r2",)], "id string")
    assert [r.record_id for r in readers.activation_table(spark, str(tmp_path / "acts"), "train", [1], valid).collect()] == ["r1"]
    built = []
    for _ in range(2):
        assert manifest.materialised(str(tmp_path / "m"), lambda: built.append(1) or df, spark).count() == 3
    assert built == [1]


def test_enrichment_resumes_without_loss_or_repeats(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", f"q{i}") for i in range(20)], "id string, prompt string")

    def flaky(prompts):
        return [None if p.endswith("3") else " " if p.endswith("4") else p.upper() for p in prompts]

    def sound(prompts):
        assert all(p[-1] in "34" for p in prompts)
        return [p.upper() for p in prompts]

    folder = str(tmp_path / "saved")
    first = {r.id: r.response for r in enrich.enriched_with_checkpoint(df, "id", "prompt", flaky, "response", folder).collect()}
    assert len(first) == 20 and first["k3"] == first["k14"] == "" and first["k5"] == "Q5"
    again = {r.id: r.response for r in enrich.enriched_with_checkpoint(df, "id", "prompt", sound, "response", folder).collect()}
    assert again == {f"k{i}": f"Q{i}" for i in range(20)}


def test_breaker_and_retries():
    b = enrich.Breaker(3)
    for ok in (False, False, True, False, False):
        b.record(ok)
    with pytest.raises(enrich.CircuitOpen):
        b.record(False)
    for _ in range(100):
        enrich.Breaker(0).record(False)
    waits, calls = [], []
    assert enrich.retried(lambda: calls.append(1) or "x" * len(calls), 3, 1.0, lambda s: {"xx": 2}[s], waits.append) == 2 and waits == [1.0]
    assert enrich.retried(lambda: 1 / 0, 2, 1.0, sleep=waits.append) is None


def test_stream_of_files(spark, tmp_path):
    put(tmp_path / "in/a.json", [{"step": 1, "record_id": "a", "reward": 0.5}, {"step": 2, "record_id": "a", "reward": 1.0}, {"step": 3, "record_id": "b", "reward": 0.0}])
    stream = streams.smoothed_stream(streams.trace_stream(spark, str(tmp_path / "in")))
    streams.run_until_read(stream, str(tmp_path / "out"))
    assert [(r.record_id, round(r.ema, 6), r.cnt) for r in streams.latest(spark, str(tmp_path / "out")).collect()] == [("a", 0.65, 2)]


def test_gates_and_messages(spark):
    df = spark.createDataFrame([("w " * 25, "x" * 90, "p"), ("short", "x" * 90, "p"), ("w " * 25, "I was asked to help " + "x" * 90, "p")], "response string, label string, prompt string")
    assert [r.v for r in df.select(rules.valid_record(F.col("response"), F.col("label")).alias("v")).collect()] == [True, False, False]
    one = rules.with_system(rules.label_messages(F.col("prompt"), F.col("response"), F.lit("ask"), "prompt_only"), F.lit("sys"))
    assert [m.role for m in df.select(one.alias("m")).first().m] == ["system", "user"]
    with pytest.raises(ValueError):
        rules.label_messages(F.lit(1), F.lit(1), F.lit(1), "other")
    missing = rules.missing_fields({"a": F.lit(""), "b": F.lit("x")}, [F.lit("")])
    assert df.select(missing.alias("m")).first().m == ["a"]
    assert df.select(rules.missing_fields({"a": F.lit("")}, [F.lit("old")]).alias("m")).first().m == []
    assert df.select(rules.clamped(F.lit(7.0), 0.0, 5.0).alias("m")).first().m == 5.0
