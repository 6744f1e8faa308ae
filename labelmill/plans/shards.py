"""Shards and their manifest in one commit: df.write.format("shards").

Each task writes its shards under names of its own and tells the driver what it wrote. Only when all tasks have, the driver
writes the manifest, which names the files; readers read what the manifest names. So a job that fails, a task that is tried
again, or an executor that is lost leaves nothing that a reader sees, and nothing has to be renamed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from labelmill.operators.batches import numbered
from labelmill.sources.stores import opened
from labelmill.storage import _file_system, whole_path

MANIFEST = "manifest.json"


@dataclass
class _Written(WriterCommitMessage):
    shards: list[dict] = field(default_factory=list)


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        if self.names[:2] != ["split", "shard"]:
            raise ValueError("the first columns must be split and shard")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file for each (split, shard); rows of a shard come together, so one file is open at a time."""
        store, top = opened(self.path)
        done: list[dict] = []
        out = key = None
        try:
            for batch in iterator:
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                lo = 0
                while lo < len(keys):
                    hi = lo
                    while hi < len(keys) and keys[hi] == keys[lo]:
                        hi += 1
                    if keys[lo] != key:
                        if out is not None:
                            out.close()
                        key = keys[lo]
                        split, shard = key
                        name = f"{split}/shard-{shard:05d}-{uuid.uuid4().hex}.parquet"
                        store.create_dir(f"{top}/{split}", recursive=True)
                        schema = batch.schema.remove(1).remove(0)
                        out = pq.ParquetWriter(f"{top}/{name}", schema, filesystem=store)
                        done.append({"split": split, "shard": shard, "file": name, "records": 0})
                    part = batch.slice(lo, hi - lo)
                    out.write_batch(pa.RecordBatch.from_arrays(part.columns[2:], schema=schema))
                    done[-1]["records"] += hi - lo
                    lo = hi
        finally:
            if out is not None:
                out.close()
        for shard in done:
            info = store.get_file_info(f"{top}/{shard['file']}")
            shard["bytes"] = info.size
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = opened(self.path)
        shards = [s for m in messages if m is not None for s in m.shards]
        old = [] if self.overwrite else _named(store, top)
        twice = {(s["split"], s["shard"]) for s in old} & {(s["split"], s["shard"]) for s in shards}
        if twice or len({(s["split"], s["shard"]) for s in shards}) < len(shards):
            self.abort(messages)
            raise ValueError(f"shards are written twice: {sorted(twice)[:5]}")
        _put(store, f"{top}/{MANIFEST}", json.dumps(_manifest(old + shards), indent=2, sort_keys=True))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes what tasks told of; what a lost task left is named nowhere, and goes with swept()."""
        store, top = opened(self.path)
        for m in messages:
            for shard in m.shards if m is not None else ():
                if store.get_file_info(f"{top}/{shard['file']}").type == arrow_fs.FileType.File:
                    store.delete_file(f"{top}/{shard['file']}")


def _named(store, top: str) -> list[dict]:
    if store.get_file_info(f"{top}/{MANIFEST}").type != arrow_fs.FileType.File:
        return []
    with store.open_input_stream(f"{top}/{MANIFEST}") as f:
        made = json.loads(f.read())
    return [s | {"split": split} for split, part in made["splits"].items() for s in part["shards"]]


def _manifest(shards: list[dict]) -> dict:
    splits: dict[str, dict] = {}
    for s in sorted(shards, key=lambda s: (s["split"], s["shard"])):
        part = splits.setdefault(s["split"], {"num_records": 0, "num_shards": 0, "shards": []})
        part["num_records"] += s["records"]
        part["num_shards"] += 1
        part["shards"].append({k: s[k] for k in ("shard", "file", "records", "bytes")})
    digest = hashlib.sha256(json.dumps(splits, sort_keys=True).encode()).hexdigest()
    return {"status": "complete", "splits": splits, "digest": digest}


def _put(store, path: str, text: str) -> None:
    """A file that appears whole; on stores without a rename a whole file is written at once anyway."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(text.encode())
    store.move(tmp, path)


class Shards(DataSource):
    """Writes rows of (split, shard, ...). Mode overwrite names the new shards alone, append the old ones too."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter(self.options["path"], schema, overwrite)


def with_shards(rows: DataFrame, order: list[str], records_per_shard: int) -> DataFrame:
    """rows (split, ...) with shard: those of a split in an order, cut every so many records; the last shard is shorter."""
    placed = numbered(rows.select("split", *order), ["split", *order])
    # a row for each split
    first = placed.groupBy("split").agg(F.min("rn").alias("_first"))
    shard = F.floor((F.col("rn") - F.col("_first")) / records_per_shard).cast("long").alias("shard")
    return rows.join(placed.join(F.broadcast(first), "split").select("split", *order, shard), ["split", *order])


def write_sharded(rows: DataFrame, path: str, order: list[str], records_per_shard: int, mode: str = "overwrite") -> dict:
    """Writes rows (split, ...; order must name each) in shards of just so many records, and returns the manifest. Rows of a shard come to one task, in order."""
    spark = rows.sparkSession
    spark.dataSource.register(Shards)
    cut = with_shards(rows, order, records_per_shard)
    others = [c for c in rows.columns if c != "split"]
    dealt = cut.repartition("split", "shard").sortWithinPartitions("split", "shard", *order).select("split", "shard", *others)
    dealt.write.format("shards").mode(mode).option("path", whole_path(spark, path)).save()
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder; an error if there is none, it isn't complete, or isn't as it was written."""
    fs, p = _file_system(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(p):
        raise FileNotFoundError(f"no manifest in {path}")
    made = json.loads("".join(r["value"] for r in spark.read.text(p.toString(), wholetext=True).collect()))
    if made.get("status") != "complete" or _manifest([s | {"split": k} for k, v in made["splits"].items() for s in v["shards"]])["digest"] != made["digest"]:
        raise ValueError(f"the manifest in {path} isn't complete")
    return made


def read_sharded(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Rows of the shards that the manifest names, with split and shard; of some splits if asked. Files that it doesn't name aren't read."""
    made = read_manifest(spark, path)
    named = [(k, s["shard"], s["file"].rsplit("/", 1)[1]) for k, v in made["splits"].items() if splits is None or k in splits for s in v["shards"]]
    if not named:
        raise ValueError(f"no shards in {path}")
    rows = spark.read.parquet(*(f"{path.rstrip('/')}/{k}/{f}" for k, _, f in named))
    names = spark.createDataFrame(named, "split string, shard long, _name string")
    return rows.withColumn("_name", F.col("_metadata.file_name")).join(names, "_name").drop("_name")


def swept(spark: SparkSession, path: str) -> int:
    """Removes shard files that the manifest doesn't name, which failed jobs left, and returns how many. No job may be writing."""
    made = read_manifest(spark, path)
    named = {s["file"] for v in made["splits"].values() for s in v["shards"]}
    top = whole_path(spark, path).rstrip("/")
    fs, p = _file_system(spark, path)
    gone, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        name = f.toString().removeprefix(f"{top}/")
        if name.endswith(".parquet") and name not in named:
            gone.append(f)
    for f in gone:
        fs.delete(f, False)
    return len(gone)
