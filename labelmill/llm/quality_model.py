"""A quality classifier by compression.

Two zstandard dictionaries are trained, on well and on badly rated texts. A text is cut into blocks, each block is
compressed with either dictionary, and the normalised difference of the compressed sizes says which of them its
phrases come from. A logistic curve fitted on labelled texts that the dictionaries haven't seen makes that a score.

The dictionaries come from a bounded labelled sample and are sent to the executors; all rows are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import text_bytes
from labelmill.llm.labelled import Logistic, labelled_sample
from labelmill.llm.shared import bounded_batches, crc_fold, received, scratch, sent, tidy

#: Of each class at most this many labelled documents are learnt from.
SAMPLE_PER_CLASS = 3000
DICTIONARY_BYTES = 1 << 16
#: The whole of a text is compressed, in blocks of this size: in longer ones a dictionary soon stops to matter.
BLOCK_BYTES = 2048
#: Bytes of sample blocks that a dictionary is trained on, if not said otherwise.
TRAINING_BYTES = 8 << 20
LEVEL = 1


def blocks(data: memoryview) -> Iterator[memoryview]:
    for lo in range(0, len(data), BLOCK_BYTES):
        yield data[lo : lo + BLOCK_BYTES]


def dictionary(texts: list[bytes], training_bytes: int = TRAINING_BYTES) -> bytes:
    """A dictionary for texts; what too few or too small samples can't be trained on is used as it is."""
    samples, size = [], 0
    for t in texts:
        for b in blocks(memoryview(t)):
            if size < training_bytes:
                samples.append(bytes(b))
                size += len(b)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries = good, bad

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the difference of compressed sizes against their sum and against the bytes, the better size against the bytes, and the log of the bytes."""
        if not hasattr(self, "_by"):
            self._by = []
            for d in self.dictionaries:
                kind = zstandard.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                prepared = zstandard.ZstdCompressionDict(d, dict_type=kind)
                prepared.precompute_compress(level=LEVEL)
                self._by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_checksum=False, write_content_size=False, write_dict_id=False))
        good, bad = (c.compress for c in self._by)
        view = memoryview(np.ascontiguousarray(data))
        sizes = np.zeros((len(offsets) - 1, 2))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for block in blocks(view[a:b]):
                sizes[i, 0] += len(good(block))
                sizes[i, 1] += len(bad(block))
        n = np.diff(offsets)
        difference = sizes[:, 1] - sizes[:, 0]
        return np.column_stack([difference / np.maximum(sizes.sum(axis=1), 1), difference / np.maximum(n, 1), sizes.min(axis=1) / np.maximum(n, 1), np.log1p(n)])


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", training_bytes: int = TRAINING_BYTES) -> tuple[Compressors, Logistic]:
    """Dictionaries and curve, learnt from labelled texts outside the held fold: at most per_class of each class, whose dictionary is trained on the first training_bytes in the order of their hash."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, folds, held, per_class, id_col, text_col)
    made = []
    for y in (1, 0):
        # no more than the training bytes come to the driver
        texts, size = [], 0
        for r in sample.where((F.col("part") == 0) & (F.col("y") == y)).orderBy(F.xxhash64("text")).select(F.encode("text", "UTF-8")).toLocalIterator():
            texts.append(bytes(r[0]))
            size += len(r[0])
            if size >= training_bytes:
                break
        made.append(dictionary(texts, training_bytes))
    compressors = Compressors(*made)
    held_by_all = sent(docs.sparkSession, compressors)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(held_by_all)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(model.features(*text_bytes(batch.column(0)))), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.where("part = 1").select("text", "y").mapInArrow(tidy(run), schema).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, 4)
    return compressors, Logistic(x, rows.column("y").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", training_bytes: int = TRAINING_BYTES) -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted (score >= threshold) and size_difference.

    Only the text is scored; a null one counts as empty and has the score that the curve gives to no evidence. held_out
    says whether crc32(id as text) mod folds is held; a null id counts as held out. Equal texts have equal scores.
    Without labels all scores are 0.5. Other columns aren't read.
    """
    with scratch():
        held_by_all = sent(docs.sparkSession, quality_model(docs, labels, label, folds, held, per_class, id_col, text_col, training_bytes))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("size_difference", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = received(held_by_all)
        for batch in batches:
            x = model.features(*text_bytes(batch.column(1)))
            score = curve(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0])], names=schema.names)

    fold = F.coalesce(crc_fold(id_col, folds) == held, F.lit(True))
    return docs.select(docs[id_col], docs[text_col].alias("text"), fold.alias("held_out")).mapInArrow(tidy(run), schema)
