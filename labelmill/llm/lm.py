"""Language-model scoring by a weighted backoff automaton whose arcs are tables.

Counts are taken over all training documents. Every word, and every pair and triple that occurs twice or more, gets an arc;
every word and every pair that begins a longer arc is a state with a failure arc. The automaton's weights are pushed so
that the way of a text through it is a sum over its n-grams: a word adds its own log-probability and the failure arc of
the state it leads to, a pair or triple what its arc has more than the failure arc and the shorter arc it replaces. What
has no arc adds nothing.

States and arcs grow with the corpus and stay in tables. Those of at least HEAD_SHARE and HEAD_ARC_SHARE of the tokens,
whose number has a bound, are sent to the executors; all others are looked up shard by shard. A shard is a range of hash
values; n-grams travel to it in cells, sorted and packed, and meet the arcs of that range there. There are as many shards
as keep each at about SHARD n-grams. Which n-gram is frequent makes no shard hot: of each text, or block of texts, it
arrives once, and the most frequent ones don't travel when texts are scored. Bit maps of bounded size keep out of the
shuffles most n-grams that can't occur twice or have no arc; what they let through by chance is settled in the shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import SPACED, row_groups, text_bytes, words
from labelmill.llm.shared import bounded_batches, crc_fold, received, scratch, sent, staged, tidy, unstaged

#: Words of at least this share of the training tokens are held by every executor: at most 2,097,152 of them.
HEAD_SHARE = 2.0**-21
#: Pairs and triples of at least this share are held by every executor: at most 1,048,576 of each.
HEAD_ARC_SHARE = 2.0**-20
#: Pairs and triples that occur less often have no arc.
LEAST_COUNT = 2
DISCOUNT = 0.75
#: The token that ends every text.
END = np.array([0x1F3D5B79A2C4E6F8], np.uint64)
#: Bytes of text that are counted, and scored, at once.
GROUP = 1 << 23
SCORED_GROUP = 1 << 21
#: Bits of a bit map at most: 16 MB.
MAP_BITS = 27
#: n-grams that a shard should hold when they are counted, bits of the number of shards at least, and bits by which cells are split at once.
SHARD = 1 << 20
#: Bits of the place of a text among those that are scored at once, and of these groups' numbers in a task.
BLOCK_BITS, GROUP_BITS = 21, 21
#: n-grams of texts that are looked up in a shard.
ASKED = 1 << 24
LEAST_BITS = 5
SPLIT_BITS = 12
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Positions of 64-bit keys in a sorted array, by linear probing from the high bits of the key."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        slots = (keys >> self.shift).astype(np.int64)
        n = np.arange(len(keys))
        at = np.maximum.accumulate(slots - n) + n if len(keys) else slots
        size = max(1 << bits, int(at[-1]) + 1 if len(keys) else 0) + 1
        self.keys = np.full(size, _EMPTY)
        self.keys[at] = keys
        self.index = np.full(size, -1, np.int64)
        self.index[at] = n

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        at = (wanted >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == wanted, self.index[at], -1)
        left = np.flatnonzero(there < wanted)
        at = at[left]
        while len(left):
            at = at + 1
            there = self.keys[at]
            same = there == wanted[left]
            out[left[same]] = self.index[at[same]]
            more = there < wanted[left]
            left, at = left[more], at[more]
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each row and its end token, offsets of the rows in them)."""
    hashes, rows, _, _ = words(data, offsets, SPACED, lower=True)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n) + 1
    where = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(where[-1], np.uint64)
    out[np.arange(len(hashes)) + rows] = hashes
    out[where[1:] - 1] = END[0]
    return out, where


def ngram_key(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Spark's xxhash64(a, b): the key of a pair from its words, of a triple from its pairs. Worked out in pieces that stay in the processor's cache."""
    out = np.empty(len(a), np.uint64)
    for lo in range(0, len(a), at_once):
        out[lo : lo + at_once] = _key(a[lo : lo + at_once], b[lo : lo + at_once])
    return out


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    h = np.full(len(a), 42, np.uint64)
    for x in (a, b):
        h = h + p5 + np.uint64(8)
        h ^= turned(x * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of those the bit map was made of."""
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bit_map(keys: DataFrame) -> np.ndarray:
    """A bit map of the column k of keys: each task makes its own, compressed; those of one part are put together in one place."""
    bits = 1 << min(MAP_BITS, max(16, (16 * keys.count()).bit_length()))
    size = min(bits // 8, 1 << 18)
    schema = "part int, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        write = zstandard.ZstdCompressor(level=1)
        parts = [(p, write.compress(own[p * size : (p + 1) * size].tobytes())) for p in range(len(own) // size) if own[p * size : (p + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["part", "bits"])

    def together(table: pa.Table) -> pa.Table:
        read, out = zstandard.ZstdDecompressor(), np.zeros(size, np.uint8)
        for part in table.column("bits").to_pylist():
            out |= np.frombuffer(read.decompress(part), np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = staged(keys.select("k").mapInArrow(tidy(run), schema).groupBy("part").applyInArrow(tidy(together), schema), "bits")
    out = np.zeros((bits // 8 // size, size), np.uint8)
    for part, chunk in parts.toLocalIterator():
        out[part] = np.frombuffer(chunk, np.uint8)
    unstaged(parts)
    return out.reshape(-1)


def _counted(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word, and the end token, occurs in docs (text)."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets, GROUP):
                h, c = np.unique(tokens(data, offsets[lo : hi + 1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.mapInArrow(tidy(run), schema).groupBy("h").agg(F.sum("c").alias("c"))


def _planes(*columns: np.ndarray) -> bytes:
    """Columns byte by byte: the bytes that hardly vary stand together."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _column(raw: np.ndarray, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel(), at + n * size


class Names:
    """Short numbers of frequent words, the most frequent first."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.order, self.find = keys, order, None

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, from 1; 0 for one that has none."""
        if self.find is None:
            self.find = Lookup(self.keys[self.order])
        at = self.find(words)
        return np.where(at >= 0, self.order[at] + 1 if len(self.order) else 0, 0).astype(np.uint32)

    def words(self, numbers: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The words of numbers; others has those without a number in their order."""
        out = np.empty(len(numbers), np.uint64)
        named = numbers > 0
        out[named] = self.keys[numbers[named].astype(np.int64) - 1]
        out[~named] = others
        return out


def packed_ngrams(columns: list[np.ndarray], numbers: list[np.ndarray], n: np.ndarray) -> bytes:
    """A cell of n-grams, whose words are columns, with the numbers of these, and how often each occurs."""
    order = np.argsort(numbers[0], kind="stable")
    numbers, columns = [x[order] for x in numbers], [c[order] for c in columns]
    others = [c[x == 0] for c, x in zip(columns, numbers, strict=True)]
    body = _planes(np.diff(numbers[0], prepend=np.zeros(1, np.uint32)), *numbers[1:], n[order].astype(np.uint64), *others)
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(n), *map(len, others)], np.uint32).tobytes() + body)


def unpacked_ngrams(names: Names, cells: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of words, counts) of some cells, one after the other."""
    out: list[list] = [[] for _ in range(order + 1)]
    reader = zstandard.ZstdDecompressor()
    for cell in cells:
        raw = np.frombuffer(reader.decompress(cell), np.uint8)
        size, *rest = raw[: 4 * (order + 1)].view(np.uint32).tolist()
        at, numbers = 4 * (order + 1), []
        for k in range(order + 1):
            x, at = _column(raw, at, size, np.uint32 if k < order else np.uint64)
            numbers.append(x)
        numbers[0] = np.cumsum(numbers[0], dtype=np.uint32)
        for k, m in enumerate(rest):
            others, at = _column(raw, at, m, np.uint64)
            out[k].append(names.words(numbers[k], others))
        out[order].append(numbers[order])
    *columns, n = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in out)
    return columns, n.astype(np.int64)


def packed_asked(key: np.ndarray, row: np.ndarray, n: np.ndarray) -> bytes:
    """A cell of n-grams that texts ask for: keys, in order, with row and how often."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(key, prepend=np.zeros(1, np.uint64)), row, n.astype(np.uint32)))


def unpacked_asked(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, n) of some cells, one after the other."""
    out: tuple[list, list, list] = ([], [], [])
    reader = zstandard.ZstdDecompressor()
    for cell in cells:
        raw, at = np.frombuffer(reader.decompress(cell), np.uint8), 0
        for column, kind in zip(out, (np.uint64, np.uint64, np.uint32), strict=True):
            x, at = _column(raw, at, len(raw) // 20, kind)
            column.append(x)
        out[0][-1] = np.cumsum(out[0][-1], dtype=np.uint64)
    key, row, n = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in out)
    return key, row, n.astype(np.int64)


def runs(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal rows begin, how long each is)."""
    new = np.zeros(len(key), bool)
    new[:1] = True
    for x in (key, *more):
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(key)))


def split(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(shard, which rows are in it) by the first bits of key, which is in order."""
    shard = (key >> np.uint64(64 - bits)).astype(np.int64)
    first, size = runs(shard)
    for i, n in zip(first.tolist(), size.tolist(), strict=True):
        yield int(shard[i]), slice(i, i + n)


def _cells(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], names=["shard", "cell"])


def shard_bits(ngrams: int, each: int) -> int:
    """Bits of the number of shards for so many n-grams, about each in one."""
    return max(LEAST_BITS, (int(ngrams) // each).bit_length())


def _resplit(cells: DataFrame, again: Callable[[list[bytes], int], list[tuple[int, bytes]]], bits: int) -> DataFrame:
    """cells (shard, cell, ...) split further, where there are more shards than one split makes: step by step, each with cells of a useful size. again: cells of one shard to (shard, cell) by so many bits."""
    done = min(bits, SPLIT_BITS)
    while done < bits:
        done = min(bits, done + SPLIT_BITS)

        def run(batches: Iterator[pa.RecordBatch], done: int = done) -> Iterator[pa.RecordBatch]:
            held, size, of = [], 0, None
            for batch in batches:
                for shard, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and (shard != of or size > 16 * SHARD):
                        yield _cells(again(held, done))
                        held, size = [], 0
                    held.append(cell)
                    of, size = shard, size + len(cell)
            if held:
                yield _cells(again(held, done))

        cells = cells.select("shard", "cell").repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(run), "shard long, cell binary")
    return cells


def _keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of n-grams, and the two that each one's key is made of): the words of a pair, the pairs of a triple."""
    a, b = columns if len(columns) == 2 else (ngram_key(columns[0], columns[1]), ngram_key(columns[1], columns[2]))
    return ngram_key(a, b), a, b


def _ngrams(docs: DataFrame, order: int, names: np.ndarray, shorter: np.ndarray, bits: int) -> DataFrame:
    """(a, b, c): how often each pair of words a, b, or triple of pairs a, b, occurs, if LEAST_COUNT times. names: frequent words, the most frequent first. shorter: a bit map of the words, or pairs, that occur LEAST_COUNT times."""
    shared, least = sent(docs.sparkSession, (Names(names), shorter)), LEAST_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often_bits = received(shared)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets, GROUP):
                h, where = tokens(data, offsets[lo : hi + 1])
                inside = np.ones(len(h), bool)
                inside[where[1:] - 1] = False
                x, both = h, inside[:-1]
                if order == 3:
                    x, both = ngram_key(x[:-1], x[1:]), both[:-1] & both[1:]
                often = in_map(often_bits, x)
                at = np.flatnonzero(both & often[:-1] & often[1:])
                keys = ngram_key(x[at], x[at + 1])
                by = np.argsort(keys)
                first, c = runs(keys[by])
                keys, at, numbers = keys[by[first]], at[by[first]], names.numbers(h)
                yield _cells([(s, packed_ngrams([h[at[i] + k] for k in range(order)], [numbers[at[i] + k] for k in range(order)], c[i])) for s, i in split(keys, min(bits, SPLIT_BITS))])

    def again(cells: list[bytes], done: int) -> list[tuple[int, bytes]]:
        names, _ = received(shared)
        columns, n = unpacked_ngrams(names, cells, order)
        keys = _keys(columns)[0]
        by = np.argsort(keys)
        # what many groups have is added up on the way
        first, _ = runs(keys[by])
        n = np.add.reduceat(n[by], first) if len(first) else n
        by = by[first]
        return [(s, packed_ngrams([c[by[i]] for c in columns], [names.numbers(c[by[i]]) for c in columns], n[i])) for s, i in split(keys[by], done)]

    def added(table: pa.Table) -> pa.Table:
        names, _ = received(shared)
        columns, c = unpacked_ngrams(names, table.column("cell").to_pylist(), order)
        keys, a, b = _keys(columns)
        by = np.argsort(keys)
        first, _ = runs(keys[by])
        c = np.add.reduceat(c[by], first) if len(first) else c
        often = c >= least
        at = by[first[often]]
        return pa.table({"a": a[at].view(np.int64), "b": b[at].view(np.int64), "c": c[often]})

    cells = _resplit(docs.mapInArrow(tidy(run), "shard long, cell binary"), again, bits)
    return cells.groupBy("shard").applyInArrow(tidy(added), "a long, b long, c long")


def _with_backoff(states: DataFrame, arcs: DataFrame) -> DataFrame:
    """states (k, c, ...) with backoff: what the discounts of its arcs (a, c) leave of each; null if it has none."""
    sums = arcs.groupBy(F.col("a").alias("k")).agg((F.sum("c") - F.lit(DISCOUNT) * F.count(F.lit(1))).alias("given"))
    return states.join(sums, "k", "left").withColumn("backoff", F.greatest(1 - F.col("given") / F.col("c"), F.lit(1e-9))).withColumn("backoff", F.when(F.col("given").isNotNull(), F.col("backoff"))).drop("given")


def packed_arcs(key: np.ndarray, c: np.ndarray, w: np.ndarray) -> bytes:
    """A cell of arcs: keys, in order, with counts and weights."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(key, prepend=np.zeros(1, np.uint64)), c, w))


def unpacked_arcs(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, c, w) of some cells, in the order of keys."""
    out: tuple[list, list, list] = ([], [], [])
    reader = zstandard.ZstdDecompressor()
    for cell in cells:
        raw, at = np.frombuffer(reader.decompress(cell), np.uint8), 0
        for column, kind in zip(out, (np.uint64, np.int64, np.float64), strict=True):
            x, at = _column(raw, at, len(raw) // 24, kind)
            column.append(x)
        out[0][-1] = np.cumsum(out[0][-1], dtype=np.uint64)
    key, c, w = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.uint64, np.int64, np.float64), strict=True))
    order = np.argsort(key)
    return key[order], c[order], w[order]


def _arc_cells(arcs: DataFrame, total: int, bits: int) -> DataFrame:
    """(shard, cell) of arcs (k, c, w); those that all executors hold are in shard -1."""
    word_least, arc_least = max(1.0, HEAD_SHARE * total), HEAD_ARC_SHARE * total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> pa.RecordBatch:
            k, c, w = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            order = np.argsort(k.view(np.uint64))
            k, c, w = k.view(np.uint64)[order], c[order], w[order]
            head = np.where(c > 0, c >= word_least, -c >= arc_least)
            out = [(-1, packed_arcs(k[head], c[head], w[head]))] if head.any() else []
            k, c, w = k[~head], c[~head], w[~head]
            return _cells(out + [(s, packed_arcs(k[i], c[i], w[i])) for s, i in split(k, min(bits, SPLIT_BITS))])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD // 2:
                yield flushed()
                held = []
        if held:
            yield flushed()

    return arcs.select("k", "c", "w").mapInArrow(tidy(run), "shard long, cell binary")


def fitted(train: DataFrame, text_col: str = "text", keep: Callable[[DataFrame], DataFrame] = lambda table: table) -> tuple[DataFrame, np.ndarray, int, int, int]:
    """(arcs (shard, cell), a bit map of their keys, bits of the shards, training tokens, different words). train may be empty.

    Cells have every word, pair and triple of the model: its key, a word's count (negative: that of another n-gram), and
    what its occurrence adds to a text's log10 score; a word's own log10(c + 1) isn't in w.
    """
    texts = train.select(F.col(text_col).alias("text"))
    vocabulary = staged(_counted(texts).withColumnRenamed("h", "k"), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    scale, bits = float(total + distinct + 1), shard_bits(total, SHARD)
    key = F.xxhash64("a", "b").alias("k")
    # at most as many as HEAD_SHARE allows
    named = vocabulary.where(F.col("c") >= max(float(LEAST_COUNT), HEAD_SHARE * total)).toArrow()
    names = named.column("k").to_numpy().view(np.uint64)[np.argsort(-named.column("c").to_numpy(), kind="stable")]
    pairs = staged(_ngrams(texts, 2, names, bit_map(vocabulary.where(F.col("c") >= LEAST_COUNT)), bits), "pairs")
    # a pair has LEAST_COUNT whenever a triple with it has
    triples = staged(_ngrams(texts, 3, names, bit_map(pairs.select(key)), bits), "triples")

    words_ = staged(_with_backoff(vocabulary, pairs), "words")
    unstaged(vocabulary)
    # what begins an arc has a failure arc, and what ends one occurs as often as an arc
    left, right = words_.where("backoff is not null").select(F.col("k").alias("a"), F.col("c").alias("ca"), F.col("backoff").alias("ba")), words_.where(F.col("c") >= LEAST_COUNT).select(F.col("k").alias("b"), F.log10((F.col("c") + 1) / F.lit(scale)).alias("lb"))
    p = (F.col("c") - F.lit(DISCOUNT)) / F.col("ca") + F.col("ba") * F.pow(F.lit(10.0), F.col("lb"))
    pushed = (F.log10(p) - F.col("lb") - F.log10("ba")).alias("w")
    arcs = pairs.join(left, "a").select("a", "b", "c", "ca", "ba").join(right, "b").select(key, "c", F.log10(p).alias("l"), pushed)
    states = staged(_with_backoff(arcs, triples), "states")
    unstaged(pairs)
    left, right = states.where("backoff is not null").select(F.col("k").alias("a"), F.col("c").alias("ca"), F.col("backoff").alias("ba")), states.select(F.col("k").alias("b"), F.col("l").alias("lb"))
    bits = shard_bits(3 * total, ASKED)
    longer = staged(_arc_cells(triples.join(left, "a").select("a", "b", "c", "ca", "ba").join(right, "b").select(key, (-F.col("c")).alias("c"), pushed), total, bits), "arcs")
    failing = F.coalesce(F.log10("backoff"), F.lit(0.0))
    single = words_.select("k", "c", failing.alias("w"))
    double = states.select("k", (-F.col("c")).alias("c"), (F.col("w") + failing).alias("w"))
    shorter = staged(_arc_cells(single.unionAll(double), total, bits), "arcs")
    keys = bit_map(words_.select("k").unionAll(states.select("k")).unionAll(triples.select(key)))
    unstaged(triples, words_, states)
    return keep(shorter).unionAll(keep(longer)), keys, bits, total, distinct


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows whose crc32(id as text) mod folds isn't held; a null id is in no fold and isn't
    learnt from. A null or empty text is its end token alone. base_score adds log10((c + 1) / (N + V + 1)) over the
    tokens, score the automaton's log10 probabilities. Repeated rows are scored, and learnt from, each on its own.
    Other columns of docs aren't read. Without training rows every token is unknown.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    held_out = F.coalesce(crc_fold("id", folds) == held, F.lit(True))
    with scratch() as keep:
        arcs, others, bits, total, distinct = fitted(source.where(~held_out), keep=keep)
    # bounded by HEAD_SHARE and HEAD_ARC_SHARE
    keys, c, w = unpacked_arcs([r[0] for r in arcs.where("shard = -1").select("cell").toLocalIterator()])
    held_by_all = sent(spark, (Lookup(keys), c > 0, np.where(c > 0, np.log10(np.maximum(c, 0) + 1.0), 0.0), w, others))
    known_by_row = [T.StructField("id", source.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("arcs", T.DoubleType())]
    one = [T.StructField("cell", T.BinaryType()), T.StructField("row", T.LongType()), *known_by_row]
    schema = T.StructType([T.StructField("shard", T.LongType()), *one])
    names, plain = schema.names, [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, word, own, w, others = received(held_by_all)
        row = TaskContext.get().partitionId() << (BLOCK_BITS + GROUP_BITS)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets, SCORED_GROUP):
                h, where = tokens(data, offsets[lo : hi + 1])
                n = hi - lo
                rows = np.repeat(np.arange(n), np.diff(where))
                known, base, arcs = np.zeros(n), np.zeros(n), np.zeros(n)
                asked = []
                x, inside, possible = h, np.ones(len(h), bool), np.ones(len(h), bool)
                for k in range(3):
                    if k:
                        # a longer n-gram has an arc only if both shorter ones in it have
                        x, inside = ngram_key(x[:-1], x[1:]), inside[:-1] & (rows[: len(inside) - 1] == rows[k : k + len(inside) - 1])
                        possible = possible[:-1] & possible[1:] & inside
                    there = np.flatnonzero(possible)
                    at = find(x[there])
                    hit = at >= 0
                    here, at = rows[there[hit]], at[hit]
                    if not k:
                        known += np.bincount(here, weights=word[at], minlength=n)
                        base += np.bincount(here, weights=own[at], minlength=n)
                    arcs += np.bincount(here, weights=w[at], minlength=n)
                    # what may be in the table but isn't held here
                    rest = there[~hit]
                    may = in_map(others, x[rest])
                    possible[rest[~may]] = False
                    asked.append((x[rest[may]], rows[rest[may]]))
                key, of = (np.concatenate(a) for a in zip(*asked, strict=True))
                by = np.argsort(key)
                key, of = key[by], of[by]
                # what a text asks for again mostly stands beside it
                first, times = runs(key, of)
                key, of = key[first], (row + of[first]).astype(np.uint64)
                cells = _cells([(s, packed_asked(key[i], of[i], times[i])) for s, i in split(key, min(bits, SPLIT_BITS))])
                m = len(cells)
                yield pa.RecordBatch.from_arrays([*cells.columns, *(pa.nulls(m, batch.schema.field(0).type if kind is None else kind) for kind in plain)], names=names)
                number = np.arange(row, row + n)
                yield pa.RecordBatch.from_arrays([pa.array(number & ((1 << bits) - 1)), pa.nulls(n, pa.binary()), pa.array(number), batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(np.diff(where)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(arcs)], names=names)
                # the scores of a group are put together at once: its bytes are bounded, however many texts it has
                row += 1 << BLOCK_BITS

    def looked_up(asked: pa.Table, arcs: pa.Table) -> pa.Table:
        """The rows of texts as they are, and for each block of texts a cell of what the arcs of this shard add to each."""
        cells = asked.column("cell")
        rows = asked.filter(cells.is_null()).drop_columns(["shard"])
        rows = rows.add_column(0, "block", pa.array(rows.column("row").to_numpy() >> BLOCK_BITS))
        k, c, w = unpacked_arcs(arcs.column("cell").to_pylist())
        own = np.where(c > 0, np.log10(np.maximum(c, 0) + 1.0), 0.0)
        found = []
        for cell in cells.to_pylist():
            if cell is None or not len(k):
                continue
            x, y, n = unpacked_asked([cell])
            at = np.minimum(np.searchsorted(k, x), len(k) - 1)
            hit = k[at] == x
            at, y, n = at[hit], y[hit], n[hit]
            if not len(at):
                continue
            row, of = np.unique(y, return_inverse=True)
            known, base, more = (np.bincount(of, weights=n * v[at], minlength=len(row)) for v in (c > 0, own, w))
            first, size = runs(row >> np.uint64(BLOCK_BITS))
            for i, j in zip(first.tolist(), (first + size).tolist(), strict=True):
                found.append((int(row[i]) >> BLOCK_BITS, zstandard.ZstdCompressor(level=1).compress(_planes(row[i:j], known[i:j].astype(np.uint32), base[i:j], more[i:j]))))
        m = len(found)
        parts = [pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()), *(pa.nulls(m, kind) for kind in rows.schema.types[2:])]
        return pa.concat_tables([rows, pa.table(parts, schema=rows.schema)])

    def added(table: pa.Table) -> pa.Table:
        """The texts of one block, with what all shards have added."""
        rows = table.filter(table.column("cell").is_null()).sort_by("row")
        first = rows.column("row").to_numpy()
        known, base, arcs = (rows.column(x).to_numpy().astype(float) for x in ("n_known", "base", "arcs"))
        for cell in table.column("cell").to_pylist():
            if cell is not None:
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)
                n = len(raw) // 28
                row, at = _column(raw, 0, n, np.int64)
                more, at = _column(raw, at, n, np.uint32)
                where = np.searchsorted(first, row)
                known[where] += more
                for sums in (base, arcs):
                    more, at = _column(raw, at, n, np.float64)
                    sums[where] += more
        return pa.table([*(rows.column(x) for x in ("id", "held_out", "n_tokens")), pa.array(known.astype(np.int64)), pa.array(base), pa.array(arcs)], names=[x.name for x in known_by_row])

    scored = source.withColumn("held_out", held_out).mapInArrow(tidy(run), schema)
    if bits > SPLIT_BITS:
        scored = staged(scored, "asked")

        def again(cells: list[bytes], done: int) -> list[tuple[int, bytes]]:
            key, row, n = unpacked_asked(cells)
            by = np.argsort(key)
            key, row, n = key[by], row[by], n[by]
            return [(s, packed_asked(key[i], row[i], n[i])) for s, i in split(key, done)]

        more = _resplit(scored.where("cell is not null"), again, bits)
        scored = scored.where("cell is null").unionByName(more, allowMissingColumns=True)

    def arcs_again(cells: list[bytes], done: int) -> list[tuple[int, bytes]]:
        k, c, w = unpacked_arcs(cells)
        return [(s, packed_arcs(k[i], c[i], w[i])) for s, i in split(k, done)]

    tail = _resplit(arcs.where("shard >= 0"), arcs_again, bits)
    found = scored.groupBy("shard").cogroup(tail.groupBy("shard")).applyInArrow(tidy(looked_up), T.StructType([T.StructField("block", T.LongType()), *one]))
    added = found.groupBy("block").applyInArrow(tidy(added), T.StructType(known_by_row))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    return added.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("arcs")).alias("score"))
