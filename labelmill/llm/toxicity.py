"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of words and one of words after their predecessor. The discounted count of a pair backs off to the
number of different words that its second one follows; a word's count, or that number, to the number of different words
that begin with its first five characters, that to the number of different five-character beginnings of its first four,
and the last to counts shared by both classes. How much is left to a lower level of spelling is the same for both classes,
so a rare or new expression is judged by the company of its spelling, and one of which nothing is known speaks for
neither class. The log-likelihoods of a text under the two models are compared per word: over the whole text, over its
most toxic windows and over its most toxic words. A logistic curve fitted on labelled texts that weren't counted turns
these into a score.

Models are small, counted on a bounded labelled sample, and sent to the executors; all rows are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import ALNUM, LOWER, row_groups, segment_hashes, text_bytes, words
from labelmill.llm.labelled import SAMPLE_PER_CLASS, Logistic, labelled_sample
from labelmill.llm.lm import Lookup, ngram_key
from labelmill.llm.shared import bounded_batches, crc_fold, received, scratch, sent, staged, tidy, unstaged

DISCOUNT = 0.75
PREFIXES = (5, 4)
WINDOWS = (4, 16, 64)
#: Windows over which pairs are compared.
PAIR_WINDOWS = (4, 16)
FEATURES = 5 + len(WINDOWS) + len(PAIR_WINDOWS)
#: Pairs that come up less often, in both classes together, are left to the level below.
LEAST_PAIR = 2
#: Stands before the first word of a text.
START = np.uint64(0x5A17E9C3B04D2F61)
#: Longest and least log ratio that one word can add.
CLIP = 6.0


def spellings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word; hashes of the word, its first five and its first four characters as columns)."""
    hashes, rows, starts, ends = words(data, offsets, ALNUM, lower=True)
    out = np.empty((len(hashes), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashes
    for lo in range(0, len(hashes), 1 << 16):
        a, b = starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)]
        part = LOWER[data[a[0] : b[-1]]]
        firsts = np.flatnonzero((part & 0xC0) != 0x80)
        firsts = np.append(firsts, np.full(max(PREFIXES) + 1, len(part)))
        at = np.searchsorted(firsts, a - a[0])
        for k, n in enumerate(PREFIXES):
            out[lo : lo + (1 << 16), 1 + k] = segment_hashes(part, a - a[0], np.minimum(firsts[at + n], b - a[0])) ^ np.uint64(n)
    return rows, out


def _counted(sample: DataFrame) -> tuple[pa.Table, pa.Table]:
    """((h, h5, h4, t, o, ct, co): counts of each word in toxic and ordinary texts of the sample, and of the different words before it in these; (a, b, t, o): counts of pairs that come up LEAST_PAIR times, and with b = a sum for each a of all of its pairs)."""

    def by_class(keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return first, [np.bincount(which[m], minlength=len(first)).astype(np.int64) for m in (toxic, ~toxic)]

    def counted(pairs: bool, names: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_bytes(batch.column(0))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for lo, hi in row_groups(offsets):
                    rows, keys = spellings(data, offsets[lo : hi + 1])
                    toxic = y[lo:hi][rows] == 1
                    columns = [keys[:, k] for k in range(3)]
                    if pairs:
                        columns = [before(keys[:, 0], rows), keys[:, 0]]
                    first, count = by_class(ngram_key(*columns) if pairs else keys[:, 0], toxic)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[first].view(np.int64)) for c in columns), *map(pa.array, count)], names=[*names, "t", "o"])

        schema = T.StructType([T.StructField(n, T.LongType()) for n in [*names, "t", "o"]])
        return sample.select("text", "y").mapInArrow(tidy(run), schema).groupBy(*names).agg(F.sum("t").alias("t"), F.sum("o").alias("o"))

    pairs = staged(counted(True, ["a", "b"]), "pairs")
    follows = pairs.groupBy(F.col("b").alias("h")).agg(F.count_if(F.col("t") > 0).alias("ct"), F.count_if(F.col("o") > 0).alias("co"))
    words_ = counted(False, ["h", "h5", "h4"]).join(follows, "h").toArrow()
    often = pairs.where(F.col("t") + F.col("o") >= LEAST_PAIR)
    sums = pairs.groupBy("a").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).select("a", F.lit(None).cast("long").alias("b"), "t", "o")
    found = often.unionAll(sums).toArrow()
    unstaged(pairs)
    return words_, found


def before(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The word before each one; START before the first of a row."""
    out = np.full(len(hashes), START)
    same = rows[1:] == rows[:-1]
    out[1:][same] = hashes[:-1][same]
    return out


def _mixed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of both classes from discounted counts and, for the share that discounting takes from both together, from the level below."""
    if not len(counts):
        return lower
    taken = min(DISCOUNT * np.count_nonzero(counts) / max(counts.sum(), 1.0), 1.0)
    kept = np.maximum(counts - DISCOUNT, 0)
    total = kept.sum(axis=0)
    return np.where(total > 0, (1 - taken) * kept / np.maximum(total, 1e-300) + taken * lower, lower)


class ClassModels:
    """Log ratios of toxic to ordinary probability: of known words, of known beginnings for unknown words, of pairs, and 0 for what is unknown altogether."""

    def __init__(self, table: pa.Table, pairs: pa.Table | None = None):
        def columns(t: pa.Table, *names: str) -> list[np.ndarray]:
            return [t.column(n).to_numpy() for n in names]

        h, k5, k4 = (k.view(np.uint64) for k in columns(table, "h", "h5", "h4"))
        order = np.argsort(h)
        h, k5, k4 = h[order], k5[order], k4[order]
        counts = np.column_stack(columns(table, "t", "o")).astype(float)[order]
        h5, first5, of5 = np.unique(k5, return_index=True, return_inverse=True)
        h4, of4 = np.unique(k4[first5], return_inverse=True)
        # types: words below each five-character beginning, and these below each four-character one
        types5 = np.column_stack([np.bincount(of5, weights=n > 0, minlength=len(h5)) for n in counts.T])
        types4 = np.column_stack([np.bincount(of4, weights=n > 0, minlength=len(h4)) for n in types5.T])
        all5, all4 = np.bincount(of5, minlength=len(h5)), np.bincount(of4, minlength=len(h4))
        # counts of both classes; a part is left to beginnings that weren't met
        shared = ((all4 + 0.5) / (all4.sum() + 0.5 * (len(h4) + 1)))[:, None].repeat(2, axis=1)
        self.p4 = _mixed(types4, shared)
        self.p5 = _mixed(types5, (self.p4 / (all4 + 1.0)[:, None])[of4] if len(h4) else self.p4)
        below = (self.p5 / (all5 + 1.0)[:, None])[of5] if len(h5) else counts
        self.p = _mixed(counts, below)
        values = [self.p, self.p5, self.p4]
        self.find = [Lookup(k) for k in (h, h5, h4)]
        self.levels = [np.clip(np.log(v[:, 0] / v[:, 1]), -CLIP, CLIP) for v in values]
        self.words = h
        self.pairs, self.pair_ratio, self.left, self.start, self.after = Lookup(h[:0]), np.zeros(1), np.zeros(len(h)), 0.0, self.levels[0]
        if pairs is not None and len(h):
            self._pairs(pairs, np.column_stack(columns(table, "ct", "co")).astype(float)[order], below)

    def _pairs(self, table: pa.Table, follows: np.ndarray, below: np.ndarray) -> None:
        """The models of words after their predecessor: discounted counts of pairs, and for what these leave the numbers of words before each word."""
        q = _mixed(follows, below)
        self.after = np.clip(np.log(q[:, 0] / q[:, 1]), -CLIP, CLIP)
        single = table.column("b").is_null().to_numpy(zero_copy_only=False)
        a = table.column("a").to_numpy().view(np.uint64)
        n = np.column_stack([table.column(c).to_numpy() for c in ("t", "o")]).astype(float)
        names, totals = a[single], n[single]
        order = np.argsort(names)
        names, totals = names[order], totals[order]
        b = table.column("b").fill_null(0).to_numpy().view(np.uint64)[~single]
        a, kept = a[~single], np.maximum(n[~single] - DISCOUNT, 0)
        of = np.searchsorted(names, a)
        given = np.column_stack([np.bincount(of, weights=k, minlength=len(names)) for k in kept.T]) / np.maximum(totals, 1)
        # a predecessor that a class hasn't is left to the level below as a whole
        left = np.where(totals > 0, 1 - given, 1.0)
        both = kept / np.maximum(totals[of], 1) + left[of] * q[np.searchsorted(self.words, b)]
        keys = ngram_key(a, b)
        order = np.argsort(keys)
        self.pairs, self.pair_ratio = Lookup(keys[order]), np.clip(np.log(both[:, 0] / both[:, 1]), -CLIP, CLIP)[order]
        ratio = np.log(left[:, 0] / left[:, 1])
        at = np.minimum(np.searchsorted(names, self.words), len(names) - 1)
        self.left = np.where(names[at] == self.words, ratio[at], 0.0)
        first = np.searchsorted(names, START)
        self.start = float(ratio[first]) if first < len(names) and names[first] == START else 0.0

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """The log ratio of each word by itself."""
        return self._both(keys)[0]

    def _both(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log ratio of each word by itself, that of the level below pairs, the word's number or -1)."""
        out, after = np.zeros(len(keys)), np.zeros(len(keys))
        left, number = np.arange(len(keys)), np.full(len(keys), -1)
        for k, (find, value) in enumerate(zip(self.find, self.levels, strict=True)):
            at = find(keys[left, k])
            known = at >= 0
            out[left[known]] = value[at[known]]
            after[left[known]] = (self.after if k == 0 else value)[at[known]]
            if k == 0:
                number = at
            left = left[~known]
        return out, after, number

    def pair_ratios(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log ratio of each word by itself, and after the word before it)."""
        alone, after, number = self._both(keys)
        first = np.ones(len(keys), bool)
        first[1:] = rows[1:] != rows[:-1]
        left = np.append(0.0, np.where(number >= 0, self.left[number] if len(self.left) else 0.0, 0.0)[:-1]) if len(keys) else np.zeros(0)
        left[first] = self.start
        at = self.pairs(ngram_key(before(keys[:, 0], rows), keys[:, 0]))
        return alone, np.clip(np.where(at >= 0, self.pair_ratio[at], left + after), -CLIP, CLIP)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the mean ratio of its words, the log of their number, the greatest and third greatest, the greatest means over windows; the mean of pairs and the greatest means over windows of these."""
        rows, keys = spellings(data, offsets)
        n = len(offsets) - 1
        r, pairs = self.pair_ratios(keys, rows)
        count = np.bincount(rows, minlength=n)
        out = np.zeros((n, FEATURES))
        out[:, 0] = np.bincount(rows, weights=r, minlength=n) / np.maximum(count, 1)
        out[:, 1] = np.log1p(count)
        out[:, 4 + len(WINDOWS)] = np.bincount(rows, weights=pairs, minlength=n) / np.maximum(count, 1)
        full = np.flatnonzero(count)
        if not len(full):
            return out
        first = np.searchsorted(rows, full)
        order = np.lexsort((-r, rows))
        for k, rank in enumerate((0, 2)):
            at = np.minimum(first + rank, first + count[full] - 1)
            out[full, 2 + k] = np.where(count[full] > rank, r[order[at]], np.minimum(r[order[at]], 0.0))
        row_end = np.repeat(first + count[full], count[full])
        for at, values, sizes in ((4, r, WINDOWS), (5 + len(WINDOWS), pairs, PAIR_WINDOWS)):
            total = np.concatenate([[0.0], np.cumsum(values)])
            for k, size in enumerate(sizes):
                # windows at the end of a text, or all of a short one, are cut; their sum still is taken over size words
                stop = np.minimum(np.arange(len(values)) + size, row_end)
                out[full, at + k] = np.maximum.reduceat((total[stop] - total[:-1]) / size, first)
        return out


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[ClassModels, Logistic]:
    """The two models and the curve, learnt from labelled texts outside the held fold."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, folds, held, per_class, id_col, text_col)
    models = ClassModels(*_counted(sample.where("part = 0")))
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    held_by_all = sent(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = received(held_by_all)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(list(models.features(data, offsets[lo : hi + 1])), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.where("part = 1").select("text", "y").mapInArrow(tidy(run), schema).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return models, Logistic(x, rows.column("y").to_numpy().astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted (score >= threshold) and log_ratio per word.

    Only the text is scored: a null or empty one, or one without words, has no evidence and the score that the curve
    gives to that. held_out says whether crc32(id as text) mod folds is held; a null id counts as held out. Equal texts
    have equal scores. Without labels all scores are 0.5. Other columns aren't read.
    """
    with scratch():
        held_by_all = sent(docs.sparkSession, toxicity_model(docs, labels, label, folds, held, per_class, id_col, text_col))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("log_ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, curve = received(held_by_all)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                x = models.features(data, offsets[lo : hi + 1])
                score = curve(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0])], names=schema.names)

    fold = F.coalesce(crc_fold(id_col, folds) == held, F.lit(True))
    return docs.select(docs[id_col], docs[text_col].alias("text"), fold.alias("held_out")).mapInArrow(tidy(run), schema)
