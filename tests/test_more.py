import json

from pyspark.sql import functions as F

from labelmill import cli
from labelmill.functions import arrays, text
from labelmill.operators import mining
from labelmill.plans import enrich, manifest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_padding_masks_and_lookups(spark):
    assert one(spark, arrays.left_padded(F.array(F.lit(1), F.lit(2)), F.lit(4), 0)) == [0, 0, 1, 2]
    for mask, want in (([0, 1, 1, 0], True), ([1, 0, 1], False), ([0, 0], True)):
        assert one(spark, arrays.contiguous(F.array(*map(F.lit, mask)))) is want
    table = F.create_map(F.lit("a"), F.lit(3))
    assert one(spark, arrays.looked_up(F.lit("a"), table)) == 3 and one(spark, arrays.looked_up(F.lit("b"), table)) == -1
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("yo").alias("content")))
    assert one(spark, text.plain_chat(messages)) == "User: hi\nAssistant: yo"


def test_reports(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "o long, v double")
    assert tuple(mining.validation_mean(rows, "o", "v", 5, 4).first()) == (3.5, 8)
    assert tuple(mining.validation_mean(rows.limit(0), "o", "v", 5, 4).first()) == (0.0, 0)
    tokens = spark.createDataFrame([("a", 1.0, 5, True), ("a", 3.0, 6, False), ("a", 99.0, -100, False)], "source string, loss double, label int, hit boolean")
    assert tuple(mining.masked_source_loss(tokens).first()) == ("a", 2.0, 0.5, 2)
    runs = spark.createDataFrame([("x", 1.0), ("x", 3.0)], "name string, loss double")
    assert mining.seed_study(runs, "name", "loss").first()["mean"] == 2.0
    table = spark.createDataFrame([("g1", "s", 1.0), ("g2", "s", 3.0)], "g string, k string, v double")
    assert {r.g: r.s for r in mining.chart(table, "g", "k", "v", ["s"]).collect()} == {"g1": 1.0, "g2": 3.0, None: 2.0}
    layers = spark.createDataFrame([(1, 3, 0.5), (1, 7, 0.4), (2, 3, 0.1)], "run int, layer int, val_loss double")
    assert {r.run: r.layer for r in mining.best_layer(layers).collect()} == {1: 7, 2: 3}


def test_token_gate_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None)], "id long, t string")
    assert {r.id for r in enrich.within_tokens(df, "t", lambda xs: [len(x.split()) for x in xs], 2).collect()} == {2, 3}
    assert enrich.within_tokens(df, "t", None).count() == 3
    for _ in range(2):
        manifest.append_jsonl(df, str(tmp_path / "log"))
    manifest.append_jsonl(df, None)
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    ids = df.select(F.col("id").cast("string").alias("record_id"))
    assert manifest.cached_ids(ids, str(tmp_path / "ids")).count() == 3
    assert manifest.cached_ids(ids.limit(2), str(tmp_path / "ids")).count() == 2


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    rows = [{"id": f"r{i}", "source_dataset": "s", "prompt": "please do the following thing now", "response": "word " * 30, "instruction_set": "- do the thing\n- do it well" if i % 2 else "nothing to see"} for i in range(20)]
    (tmp_path / "in/a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    source = str(tmp_path / "in/*.jsonl")
    cli.main(["mask", source, "--output", str(tmp_path / "mask.json")])
    assert sorted(json.loads((tmp_path / "mask.json").read_text())) == sorted(f"r{i}" for i in range(1, 20, 2))
    cli.main(["filter", source, "--output", str(tmp_path / "routes")])
    assert spark.read.json(str(tmp_path / "routes")).groupBy("route").count().collect() is not None
    cli.main(["split", source, "--mask", str(tmp_path / "mask.json"), "--output", str(tmp_path / "split")])
    assert spark.read.parquet(str(tmp_path / "split")).count() == 10
    traces = [{"step": k, "record_id": f"r{k}", "reward": 0.1 * k, "mean_instruction_score": 0.5, "mean_hallucination_score": 0.0, "length_penalty": 0.0} for k in range(8)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, traces)))
    (tmp_path / "shard-0.meta.json").write_text(json.dumps([{"record_id": r["id"], "source_dataset": "s"} for r in rows]))
    cli.main(["hard-ids", str(tmp_path / "t.jsonl"), "--meta", str(tmp_path / "shard-*.meta.json"), "--target", "3", "--output", str(tmp_path / "hard.json")])
    assert json.loads((tmp_path / "hard.json").read_text())["record_ids"] == ["r0", "r1", "r2"]
    cli.main(["traces", str(tmp_path / "t.jsonl"), "--bin", "4"])
    cli.main(["audit", source, "--mask", str(tmp_path / "mask.json")])
    assert "0 ids of the mask match no record" in capsys.readouterr().out
