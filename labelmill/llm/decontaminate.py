"""Benchmark decontamination by winnowing.

Of every run of WINDOW neighbouring k-gram hashes the smallest is kept. Texts that share k + WINDOW - 1 words share a
kept hash, so with k + WINDOW - 1 = span every shared run of span words is found. Kept hashes of a document are looked up
among those of the benchmark, and each hit is extended to the windows of span words around it, which are looked up among
the benchmark's windows. Equal windows of the benchmark are one, whatever items they stand in, so a passage that many
items and documents share is extended once for each place in a document.

A benchmark of bounded size is sent to the executors as a whole; documents aren't shuffled at all then. A larger one stays
in tables: a bit map of its kept hashes thins out the documents' windows, and these are joined to the benchmark's. Nothing
but a count and that bit map comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import ALNUM, covered, mix, per_row, row_groups, text_bytes, windows, words
from labelmill.llm.expressions import joined_runs
from labelmill.llm.lm import bit_map, in_map, runs
from labelmill.llm.shared import bounded_batches, given_back, received, sent, staged, tidy

#: Words in a window; an item of fewer words is one window.
SPAN = 10
#: Words in a hashed gram. Winnowing windows then hold SPAN - GRAM + 1 hashes.
GRAM = 5
#: A benchmark of more words than this isn't sent to the executors.
BLOCK_WORDS = 2_000_000


def window_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words that begin at starts, as windows() gives them for all places."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total += hashes[starts + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(total)


def item_windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, starts) of the windows of items: those of span words, then for each n below that whole items of n words."""
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.searchsorted(rows, np.arange(n_rows))
    m = max(0, len(hashes) - span + 1)
    yield span, np.flatnonzero(rows[:m] == rows[span - 1 : span - 1 + m])
    for n in np.unique(counts[(counts > 0) & (counts < span)]).tolist():
        yield n, firsts[counts == n]


class Windows:
    """The distinct windows of one length: sorted hashes, a place of each among the benchmark's words, and which list of items each has."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, rows: np.ndarray, lists: dict[bytes, int]):
        order = np.lexsort((rows[starts], keys))
        keys, starts = keys[order], starts[order]
        first, size = runs(keys)
        self.keys, self.places = keys[first], starts[first]
        items = rows[starts]
        self.lists = np.array([lists.setdefault(np.unique(items[i : i + k]).tobytes(), len(lists)) for i, k in zip(first.tolist(), size.tolist(), strict=True)], np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


class Fingerprints:
    """The words, the kept hashes and the windows of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        self.words, rows, _, _ = words(data, offsets, ALNUM, lower=True)
        starts, kept = winnow(self.words, rows, gram, span - gram + 1)
        self.kept = np.unique(kept[starts])
        lists: dict[bytes, int] = {}
        self.windows = {n: Windows(window_hashes(self.words, at, n), at, rows, lists) for n, at in item_windows(self.words, rows, len(items), span)}
        #: The items of each list, as sorted strings.
        self.items = [frozenset(str(items[i][0]) for i in np.frombuffer(x, rows.dtype).tolist()) for x in lists]


def winnow(hashes: np.ndarray, rows: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the kept grams, hashes of all grams). Of equal smallest hashes in a window the last is kept."""
    keys, inside = windows(hashes, rows, gram)
    m = len(keys) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), keys
    least, at = keys[:m].copy(), np.arange(m)
    for k in range(1, window):
        lower = keys[k : k + m] <= least
        least[lower] = keys[k : k + m][lower]
        at[lower] = np.flatnonzero(lower) + k
    whole = inside[:m] & (rows[:m] == rows[window + gram - 2 : window + gram - 2 + m])
    return np.unique(at[whole]), keys


def candidates(hashes: np.ndarray, rows: np.ndarray, kept: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Starts of the windows of span words around the grams that begin at kept."""
    starts = np.unique((kept[:, None] - np.arange(span - gram + 1)).ravel())
    starts = starts[(starts >= 0) & (starts + span <= len(hashes))]
    return starts[rows[starts] == rows[starts + span - 1]]


def find(hashes: np.ndarray, rows: np.ndarray, prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which words are hit; and as row and list of items the windows found, each pair once)."""
    hit = np.zeros(len(hashes), bool)
    in_row, lists = [], []
    for n, known in prints.windows.items():
        if n == prints.span:
            kept, keys = winnow(hashes, rows, prints.gram, n - prints.gram + 1)
            kept = kept[np.isin(keys[kept], prints.kept)]
            starts = candidates(hashes, rows, kept, n, prints.gram)
        else:
            m = max(0, len(hashes) - n + 1)
            starts = np.flatnonzero(rows[:m] == rows[n - 1 : n - 1 + m])
        at = known(window_hashes(hashes, starts, n))
        starts, at = starts[at >= 0], at[at >= 0]
        # word by word
        steps = np.arange(n)
        same = (hashes[starts[:, None] + steps] == prints.words[known.places[at][:, None] + steps]).all(axis=1)
        starts, at = starts[same], at[same]
        hit |= covered(starts, n, len(hit))
        in_row.append(rows[starts])
        lists.append(known.lists[at])
    none = np.zeros(0, np.int64)
    pairs = np.unique(np.column_stack([np.concatenate(in_row or [none]), np.concatenate(lists or [none])]), axis=0) if in_row else np.zeros((0, 2), np.int64)
    return hit, pairs[:, 0], pairs[:, 1]


def _spans(rows: np.ndarray, hit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of the runs of hit words; words count from 0 in each row."""
    begin = hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], rows[1:] == rows[:-1]]))
    stop = hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([rows[1:] == rows[:-1], [False]]))
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(rows, rows[a]) if len(a) else a
    return rows[a], a - first, b - first


def _sent_prints(benchmark: DataFrame, block_words: int):
    """The benchmark's fingerprints, sent to the executors, or None if it has more words than that. benchmark: (item, text)."""
    bounded_batches(benchmark.sparkSession)
    # a word takes two bytes at least, but for the last one
    size = benchmark.agg(F.coalesce(F.sum(F.floor(F.octet_length("text") / 2) + 1), F.lit(0))).first()[0]
    if size > block_words:
        return None
    prints = sent(benchmark.sparkSession, Fingerprints([(r[0], r[1]) for r in benchmark.collect()]))
    given_back()
    return prints


def _benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((n, key, item): the distinct windows of the items; a bit map of kept hashes and of the windows of short items)."""
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                hashes, rows, _, _ = words(data, offsets[lo : hi + 1], ALNUM, lower=True)
                starts, keys = winnow(hashes, rows, GRAM, SPAN - GRAM + 1)
                parts = [(0, keys[starts], rows[starts])] + [(n, window_hashes(hashes, at, n), rows[at]) for n, at in item_windows(hashes, rows, hi - lo, SPAN)]
                n, key, row = (np.concatenate(x) for x in zip(*((np.full(len(k), n, np.int32), k, r) for n, k, r in parts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(key.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(row))], names=schema.names)

    table = staged(benchmark.select(F.col("item").cast("string"), "text").mapInArrow(tidy(run), schema).distinct(), "windows")
    return table.where("n > 0"), bit_map(table.where(f"n < {SPAN}").select(F.col("key").alias("k")).distinct())


def _joined(source: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each row of source (id, text), by joins."""
    table, bits = _benchmark_tables(benchmark)
    lengths = [r[0] for r in table.select("n").distinct().collect()]
    shared = sent(source.sparkSession, bits)
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = received(shared), TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                count = hi - lo
                hashes, rows, _, _ = words(data, offsets[lo : hi + 1], ALNUM, lower=True)
                first = np.searchsorted(rows, np.arange(count))
                parts = []
                for n in lengths:
                    if n == SPAN:
                        kept, keys = winnow(hashes, rows, GRAM, n - GRAM + 1)
                        starts = candidates(hashes, rows, kept[in_map(bits, keys[kept])], n, GRAM)
                        keys = window_hashes(hashes, starts, n)
                    else:
                        m = max(0, len(hashes) - n + 1)
                        starts = np.flatnonzero(rows[:m] == rows[n - 1 : n - 1 + m])
                        keys = window_hashes(hashes, starts, n)
                        may = in_map(bits, keys)
                        starts, keys = starts[may], keys[may]
                    parts.append((rows[starts], starts, np.full(len(starts), n), keys))
                in_row, starts, n, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 4))
                by = np.argsort(in_row, kind="stable")
                in_row, starts, n, keys = in_row[by], starts[by], n[by], keys[by]
                ends = np.searchsorted(in_row, np.arange(count + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array((starts - first[in_row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys.astype(np.uint64).view(np.int64))], names=["start", "n", "key"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + count)), batch.column(0).slice(lo, count), pa.array(per_row(rows, count)), pa.ListArray.from_arrays(pa.array(ends), each)], names=schema.names)
                row += count

    asked = staged(source.mapInArrow(tidy(run), schema), "asked")
    each = asked.select("row", F.inline("found"))
    hits = staged(each.join(table.select("n", "key").distinct(), ["n", "key"], "left_semi"), "hits")
    items = hits.select("row", "n", "key").distinct().join(table, ["n", "key"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    parts = ends.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("parts"))
    none = F.expr("cast(array() as array<struct<first: bigint, end: bigint>>)")
    spans = F.coalesce(joined_runs(F.col("parts")), none)
    rows = asked.drop("found").join(parts, "row", "left").join(items, "row", "left").withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return rows.select("id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, items (ids of the items that occur, as sorted strings) and spans (runs of hit words, [first, end)).

    A null or empty text has no words and no hits; items without words occur nowhere; an item of fewer words than a
    window is one window. Repeated items (same id) count once. Repeated documents give repeated rows. Other columns
    of either table aren't read. A benchmark of more than block_words words is joined, with the same result.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).where("text is not null")
    prints = _sent_prints(items, block_words)
    if prints is None:
        return _joined(source, items).select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(prints)
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                n = hi - lo
                hashes, rows, starts, _ = words(data, offsets[lo : hi + 1], ALNUM, lower=True)
                hit, in_row, lists = find(hashes, rows, held)
                items: list[list[str]] = [[] for _ in range(n)]
                first, size = runs(in_row)
                for i, k in zip(first.tolist(), size.tolist(), strict=True):
                    items[int(in_row[i])] = sorted(frozenset().union(*(held.items[x] for x in lists[i : i + k].tolist())))
                spans: list[list[dict]] = [[] for _ in range(n)]
                for r, a, b in zip(*(x.tolist() for x in _spans(rows, hit, starts)), strict=True):
                    spans[r].append({"first": a, "end": b})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(per_row(rows, n)), pa.array(per_row(rows[hit], n)), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without a hit word, all columns as they were. A document without words stays."""
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).where("text is not null")
    prints = _sent_prints(items, block_words)
    if prints is None:
        # equal texts have equal hits
        texts = docs.select(F.struct(F.xxhash64(docs[text_col]).alias("h"), F.length(docs[text_col]).alias("l")).alias("id"), docs[text_col].alias("text"))
        hit = staged(_joined(texts, items).where("n_hit > 0").select(F.col("id.h").alias("_hit_h"), F.col("id.l").alias("_hit_l")).distinct(), "hit")
        return docs.join(hit, (F.xxhash64(docs[text_col]) == F.col("_hit_h")) & (F.length(docs[text_col]) == F.col("_hit_l")), "left_anti")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(prints)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            clean = []
            for lo, hi in row_groups(offsets):
                hashes, rows, _, _ = words(data, offsets[lo : hi + 1], ALNUM, lower=True)
                clean.append(per_row(rows[find(hashes, rows, held)[0]], hi - lo) == 0)
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(tidy(run), docs.schema)
