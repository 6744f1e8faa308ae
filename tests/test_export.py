"""What leaves the house with a checkpoint."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.plans import manifest


def checkpoint(reward=True):
    config = {
        "model_id": "Qwen/Qwen3.5-9B", "hook_layer": 16, "lora_target_modules": ["q_proj"], "projection_dim": 8,
        "checkpoint_dir": "/mnt/cluster/group/run1", "precomputed_dir": "/mnt/cluster/pre", "sft_init_from": "/home/somebody/best.pt",
        "resume_from": "/scratch/x", "encoder_checkpoint": "/groups/x", "hard_ids_json": "/home/x/ids.json", "dataset_paths": ["/mnt/cluster/a.jsonl"],
        "wandb_entity": "some-lab", "wandb_project": "tracked-phase1", "wandb_run_name": "run-xyz",
    }
    out = {"config": config, "lora_state": {"a": np.ones((4, 8), np.float32)}, "projection_state": {"w": np.array([[1.0, 3.14159]], np.float32)}, "opt_step": 1234, "optimizer_state": {}, "wandb_run_id": "abc"}
    return out | ({"val_reward": 0.9, "reward_tracker_state": {}} if reward else {"best_val_loss": 0.5, "encoder_state": None})


def test_schema_and_sanitising():
    name, out = manifest.exported(checkpoint(), "shown")
    assert name == "shown-qwen3.5-9b-grpo.pt" and sorted(out) == sorted(manifest.EXPORTED) and out["opt_step"] == 1234
    text = json.dumps(out["config"])
    assert not any(m in text for m in (*manifest.PATH_MARKS, "some-lab", "run-xyz", "tracked-phase1"))
    assert all(out["config"][k] is None for k in manifest.BLANKED) and out["config"]["wandb_run_name"] == "released" and out["config"]["wandb_project"] == "shown"
    assert out["config"]["dataset_paths"] == [] and out["config"]["hook_layer"] == 16
    assert out["projection_state"]["w"].dtype == np.uint16 and out["lora_state"]["a"].dtype == np.float32


def test_method_name_and_refusals():
    assert manifest.exported(checkpoint(False), "p")[0] == "p-qwen3.5-9b-sft.pt"
    assert manifest.exported(checkpoint(False), "p", method="grpo", name=None)[0] == "p-qwen3.5-9b-grpo.pt" and manifest.exported(checkpoint(), "p", name="n.pt")[0] == "n.pt"
    for key in ("best_reward", "val_reward", "reward_tracker_state"):
        assert manifest.training_method({key: None}) == "grpo"
    assert manifest.training_method({}) == "sft" and manifest.model_tag("Org/New-Model") == "new-model"
    with pytest.raises(ValueError):
        manifest.exported({"weights": 1}, "p")
    with pytest.raises(ValueError):
        manifest.exported({"config": {}}, "p")
    # absent keys aren't added, and a path anywhere else is refused, however deep
    assert manifest.sanitised_config({"lr": 1}, "p") == {"lr": 1}
    for mark in manifest.PATH_MARKS:
        with pytest.raises(ValueError):
            manifest.sanitised_config({"note": {"deep": [f"see {mark}x"]}}, "p")
    assert manifest.sanitised_config({"note": "/root/x"}, "p") == {"note": "/root/x"}
    without = checkpoint() | {"projection_state": None}
    assert "projection_state" not in manifest.exported(without, "p")[1]


def test_rounding_to_bfloat16():
    x = np.array([1.0, 1.00390625, 1.01171875, 3.14159, -0.0, np.inf, -np.inf, 3.4e38, 1e-40], np.float32)
    back = (manifest.bfloat16_bits(x).astype(np.uint32) << 16).view(np.float32)
    # halfway cases go to the even neighbour
    assert back[:3].tolist() == [1.0, 1.0, 1.015625] and back[3] == 3.140625 and np.isinf(back[5:8]).all()
    assert np.isnan((manifest.bfloat16_bits(np.array([np.nan], np.float32)).astype(np.uint32) << 16).view(np.float32))[0]


def test_maps_with_paths(spark):
    df = spark.createDataFrame([({"a": "/groups/x"},), ({"a": "/root/x"},)], "m map<string,string>")
    assert [r[0] for r in df.select(manifest.path_free(F.col("m"))).collect()] == [False, True]


def test_logs_are_cut(spark):
    df = spark.createDataFrame([("a", "errors", "no answer", "p" * 600, None), ("b", "removed", "", "q", "l" * 501), ("c", "kept", "", "r", "l")], "id string, route string, judge_error string, prompt string, instruction_set string")
    assert [tuple(r) for r in manifest.errors_log(df).collect()] == [("a", "no answer", "p" * 500, "")]
    assert [tuple(r) for r in manifest.removal_log(df).collect()] == [("b", "q", "l" * 500)]
