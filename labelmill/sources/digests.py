"""SHA-256 of files of any size, and of values in an order.

A digest is one chain over all bytes, so what is hashed runs through one place; only the state of the hash is kept there,
and a bounded piece of the input. Files are hashed side by side, one task each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelmill.sources.stores import OPENED, opened
from labelmill.storage import _file_system, whole_path

#: Files up to this size are read whole.
WHOLE_BYTES = 64 << 20
#: Bytes of a larger one that are held at once.
PIECE_BYTES = 4 << 20


@dataclass
class _File(InputPartition):
    path: str


class _DigestReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, path = opened(partition.path)
        digest, size = hashlib.sha256(), 0
        piece = bytearray(PIECE_BYTES)
        view = memoryview(piece)
        with store.open_input_stream(path, compression=None) as f:
            while n := f.readinto(view):
                digest.update(view[:n])
                size += n
        yield partition.path, size, digest.hexdigest()


class FileDigests(DataSource):
    """spark.read.format("file_digests").option("paths", "\\n".join(uris)): (path, bytes, sha256) of each file, which is read in pieces by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader([p for p in self.options.get("paths", "").split("\n") if p])


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of whole files, however large and on any file system that Spark reads.

    Small files are hashed inside Spark. Larger ones are read in pieces, one task for each file; where workers can't open
    the store by themselves, that is done by Spark's own client, on the driver's machine.
    """
    small, large, empty = [], [], []
    for given in paths:
        fs, p = _file_system(spark, given)
        status = fs.getFileStatus(p)
        (empty if not status.getLen() else small if status.getLen() <= WHOLE_BYTES else large).append(status.getPath())
    parts = []
    if empty:
        # Spark leaves out files without bytes
        parts.append(spark.createDataFrame([(p.toString(), 0, hashlib.sha256().hexdigest()) for p in empty], "path string, bytes long, sha256 string"))
    if small:
        rows = spark.read.format("binaryFile").load([_literal(p.toString()) for p in small])
        parts.append(rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    known = [p for p in large if (p.toUri().getScheme() or "file") in OPENED]
    if known:
        spark.dataSource.register(FileDigests)
        rows = spark.read.format("file_digests").option("paths", "\n".join(p.toUri().toString() for p in known)).load()
        names = spark.createDataFrame([(p.toUri().toString(), p.toString()) for p in known], "path string, named string")
        parts.append(rows.join(names, "path").select(F.col("named").alias("path"), "bytes", "sha256"))
    others = [p for p in large if p not in known]
    if others:
        parts.append(spark.createDataFrame([_digest_by_client(spark, p.toString()) for p in others], "path string, bytes long, sha256 string"))
    if not parts:
        return spark.createDataFrame([], "path string, bytes long, sha256 string")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _literal(path: str) -> str:
    """path, with what would be a pattern escaped."""
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in path)


def _digest_by_client(spark: SparkSession, path: str) -> tuple[str, int, str]:
    """The bytes stay inside the client, which reads them in pieces."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return whole_path(spark, path), fs.getFileStatus(p).getLen(), spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def ordered_digest(rows: DataFrame, order: list[str], value: str) -> tuple[int, str]:
    """How many values there are, and SHA-256 of them, as text, in an order and with line feeds between; null counts as empty.

    The rows are sorted in ranges; each range comes as pieces of joined values, one range after the other, so neither a task
    nor the driver holds all values, and the driver keeps the state of the hash alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                joined = "\n".join(v or "" for v in batch.column(0).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([joined], pa.binary())], names=["n", "piece"])

    found = rows.select(*order, F.col(value).cast("string").alias("_value")).orderBy(*order).select("_value").mapInArrow(pieces, "n long, piece binary")
    n, digest = 0, hashlib.sha256()
    for row in found.toLocalIterator(prefetchPartitions=True):
        if n:
            digest.update(b"\n")
        digest.update(row["piece"])
        n += row["n"]
    return n, digest.hexdigest()
