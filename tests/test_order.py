"""The order in which files are given, and what depends on it: scans, exact splits, digests."""

import hashlib
import json
import os
import random
import resource

import pytest

from labelmill.operators import splits
from labelmill.sources import digests, readers


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
    return str(path)


def record(name, group=None, source="s"):
    row = {"id": name, "source_dataset": source, "prompt": "p", "response": "r", "instruction_set": "- x"}
    return row | ({"metadata": {"paraphrase_group_id": group}} if group else {})


def ids(rows):
    return [r.id for r in rows.orderBy("ord").select("id").collect()]


def test_files_are_read_in_the_order_given(spark, tmp_path):
    a = write(f"{tmp_path}/x y/a [1]{{z}} %20é.jsonl", [record(f"a{i}") for i in range(4)])
    b = write(f"{tmp_path}/b.jsonl", [record(f"b{i}") for i in range(3)])
    c = write(f"{tmp_path}/c.jsonl", [record("c0")])
    a_ids, b_ids = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(3)]
    quoted = "".join(f"\\{x}" if x in "[]{}" else x for x in a)
    assert ids(readers.dataset(spark, [b, quoted])) == b_ids + a_ids
    assert ids(readers.dataset(spark, [a, b])) == a_ids + b_ids
    assert ids(readers.dataset(spark, [b, b])) == b_ids * 2
    assert ids(readers.dataset(spark, [c, b, c])) == ["c0", *b_ids, "c0"]
    # patterns and folders by name, at the place where they are given
    assert ids(readers.dataset(spark, [c, f"{tmp_path}/*.jsonl"])) == ["c0", *b_ids, "c0"]
    write(f"{tmp_path}/d/_x.jsonl", [record("hidden")]), write(f"{tmp_path}/d/2.jsonl", [record("d2")]), write(f"{tmp_path}/d/1.jsonl", [record("d1")])
    assert ids(readers.dataset(spark, [f"{tmp_path}/d", c])) == ["d1", "d2", "c0"]
    assert ids(readers.dataset(spark, [c, f"{tmp_path}/gone.jsonl", b])) == ["c0", *b_ids]
    with pytest.raises(FileNotFoundError):
        readers.jsonl(spark, [c, f"{tmp_path}/gone.jsonl"], "id string")
    assert readers.dataset(spark, []).count() == 0


def test_blank_and_bad_lines(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", [record("1"), "", "\t", " \x0b ", record("2")])
    for policy in ("raise", "skip"):
        assert [r.id for r in readers.jsonl(spark, [path], "id string", policy).orderBy("ord").collect()] == ["1", "2"]
        with pytest.raises(Exception, match="empty line"):
            readers.jsonl(spark, [path], "id string", policy, empty="raise").select("id", "value").collect()
    bad = write(f"{tmp_path}/b.jsonl", [record("1"), "{oops", record("2"), "[1]"])
    assert readers.jsonl(spark, [bad], "id string", "skip").count() == 2
    with pytest.raises(Exception, match="bad JSON line"):
        readers.jsonl(spark, [bad], "id string").collect()


def reference_split(records, val_ratio, test_ratio, seed, stratify):
    """(split, ids in order) as one process makes them: records are (id, group, source)."""
    has_groups = any(g is not None for _, g, _ in records)

    def grouped(rows):
        out, by = [], {}
        for r in rows:
            if r[1] is None:
                out.append([r])
            elif r[1] in by:
                by[r[1]].append(r)
            else:
                by[r[1]] = [r]
                out.append(by[r[1]])
        return out

    def cut(rows, rng):
        items = grouped(rows) if has_groups else [[r] for r in rows]
        rng.shuffle(items)
        parts = {"test": [], "val": [], "train": []}
        room = {"test": max(1, int(len(rows) * test_ratio)), "val": max(1, int(len(rows) * val_ratio))}
        for item in items:
            to = next((k for k in ("test", "val") if len(parts[k]) < room[k]), "train")
            parts[to] += item
        return parts

    if not stratify:
        parts = cut(records, random.Random(seed))
    else:
        buckets = {}
        for item in grouped(records):
            buckets.setdefault(item[0][2], []).extend(item)
        parts = {"train": [], "val": [], "test": []}
        for key in sorted(buckets):
            for k, v in cut(buckets[key], random.Random(seed)).items():
                parts[k] += v
        rng = random.Random(seed + 1)
        for k in ("train", "val", "test"):
            rng.shuffle(parts[k])
    return {k: [r[0] for r in v] for k, v in parts.items()}


@pytest.mark.parametrize("groups,stratify,seed,n", [(True, None, 42, 300), (True, "source_dataset", 7, 300), (False, "source_dataset", 42, 120), (False, None, 7, 5)])
def test_exact_splits_have_the_order_of_one_process(spark, groups, stratify, seed, n, monkeypatch):
    monkeypatch.setattr(splits, "SLICE", 100)
    rng = random.Random(n)
    # ids repeat, and some are empty: each is a record of its own
    records = [(f"r{i % 290}" if i else "", f"g{rng.randrange(n // 3)}" if groups and rng.random() < 0.7 else None, f"s{rng.randrange(3)}") for i in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "ord long, id string, paraphrase_group_id string, source_dataset string").repartition(3)
    want = reference_split(records, 0.1, 0.1, seed, stratify)
    got = splits.split_records_exactly(df, seed=seed, stratify_by=stratify, ordered=True)
    rows = got.orderBy("split", "position").select("split", "position", "id").collect()
    for name, names in want.items():
        own = [r for r in rows if r.split == name]
        assert [r.id for r in own] == names and [r.position for r in own] == list(range(len(names)))
    assert {(r.split, r.n, r.checksum) for r in splits.split_digests(got).collect()} == {(k, len(v), hashlib.sha256("\n".join(v).encode()).hexdigest()) for k, v in want.items()}
    plain = splits.split_records_exactly(df, seed=seed, stratify_by=stratify)
    assert sorted((r.ord, r.split) for r in plain.collect()) == sorted((r.ord, r.split) for r in got.collect()) and plain.columns[:4] == ["ord", "id", "paraphrase_group_id", "source_dataset"]


def test_splits_follow_the_order_of_files(spark, tmp_path):
    a = write(f"{tmp_path}/a.jsonl", [record(f"a{i}", f"g{i // 3}" if i % 2 else None) for i in range(60)])
    b = write(f"{tmp_path}/b.jsonl", [record(f"b{i}", source="t") for i in range(40)])
    rows = {p: [(json.loads(x)["id"], json.loads(x).get("metadata", {}).get("paraphrase_group_id"), json.loads(x)["source_dataset"]) for x in open(p)] for p in (a, b)}
    for order in ([a, b], [b, a]):
        got = splits.split_records_exactly(readers.dataset(spark, order), ordered=True)
        want = reference_split([r for p in order for r in rows[p]], 0.1, 0.1, 42, None)
        val = [r.id for r in got.where("split = 'val'").orderBy("position").collect()]
        assert val == want["val"]
        assert digests.ordered_digest(got.where("split = 'val'"), ["position"], "id") == (len(val), hashlib.sha256("\n".join(val).encode()).hexdigest())


def test_digests_of_values_in_order(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, concat('v', id)) as v").repartition(7)
    want = "\n".join("" if i % 7 == 0 else f"v{i}" for i in range(5000))
    assert digests.ordered_digest(df, ["id"], "v") == (5000, hashlib.sha256(want.encode()).hexdigest())
    assert digests.ordered_digest(df.limit(0), ["id"], "v") == (0, hashlib.sha256(b"").hexdigest())
    assert digests.ordered_digest(df.where("id = 0"), ["id"], "v") == (1, hashlib.sha256(b"").hexdigest())


def test_digests_of_files_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "WHOLE_BYTES", 1000)
    want = {}
    for name, size in (("small", 10), ("empty", 0), ("lar[g]e é%20", 9_000_001)):
        path = f"{tmp_path}/{name}"
        data = os.urandom(size)
        with open(path, "wb") as f:
            f.write(data)
        want[path] = (size, hashlib.sha256(data).hexdigest())
    got = {r.path.removeprefix("file:"): (r.bytes, r.sha256) for r in readers.file_digests(spark, list(want)).collect()}
    assert got == want
    readers.verified(spark, {k: v[1] for k, v in want.items()})
    with pytest.raises(ValueError):
        readers.verified(spark, {next(iter(want)): "0"})
    monkeypatch.setattr(digests, "OPENED", ())
    assert {r.path.removeprefix("file:"): (r.bytes, r.sha256) for r in readers.file_digests(spark, list(want)).collect()} == want
    assert readers.file_digests(spark, []).count() == 0


def test_three_gigabytes_in_little_memory(tmp_path):
    path = f"{tmp_path}/sparse"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (_, size, digest), = digests._DigestReader([]).read(digests._File(f"file:{path}"))
    assert size == 3 << 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    state = hashlib.sha256()
    for _ in range(3 << 10):
        state.update(bytes(1 << 20))
    assert digest == state.hexdigest()
