"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over the words of each whole text in numpy; a rule compares the
characters inside n-grams that occurred earlier in the text with all its word characters, another the characters
of repeated lines. What they reject is rejected; the share of symbols is reported beside the verdict and isn't part of it. No row depends on another, so there is no shuffle, and hot sources or copies don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelmill.llm.arrays import FIRST, SPACED, covered, mix, per_row, repeated, row_groups, segment_hashes, text_bytes, windows, words
from labelmill.llm.shared import bounded_batches, tidy

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
VERDICTS = ["base_failed", "symbols_failed", "kept"]


@dataclass(frozen=True)
class RepetitionRules:
    """Greatest allowed shares of word characters: inside n-grams that occurred earlier in the text (by n) and inside lines that equal an earlier one; and of symbols, beside the verdict."""

    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    line_chars: float = 0.20
    symbols: float = 0.05
    min_words: int = 50
    repeat_words_percent: int = 50


def _line_repeats(data: np.ndarray, offsets: np.ndarray, w_starts: np.ndarray, w_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count of lines with a word that equal an earlier line, word characters in them) of each row."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    inner = offsets[1:-1]
    starts = np.unique(np.concatenate([offsets[:1], inner, breaks + 1]))
    starts = starts[starts < offsets[-1]]
    rows = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], offsets[-1]), offsets[rows + 1])
    ends = ends - (data[np.maximum(ends - 1, 0)] == 10) * (ends > starts)
    chars = np.concatenate([[0], np.cumsum(w_chars)])
    inside = chars[np.searchsorted(w_starts, ends)] - chars[np.searchsorted(w_starts, starts)]
    full = inside > 0
    starts, ends, rows, inside = starts[full], ends[full], rows[full], inside[full]
    keys = segment_hashes(data, starts, ends)
    keys = mix(keys + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return per_row(rows[later], n), per_row(rows[later], n, inside[later])


def repetition(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """The base statistics of each row, and for each n dup_n: its word characters inside n-grams that occurred earlier in it."""
    n_rows = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    hashes, rows, starts, ends = words(data, offsets, SPACED, lower=False)
    firsts = np.concatenate([[0], np.cumsum(FIRST[data], dtype=np.int64)])
    chars = firsts[ends] - firsts[starts]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data], dtype=np.int64)])
    out = {"n_words": per_row(rows, n_rows), "word_chars": per_row(rows, n_rows, chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    out["n_dup_lines"], out["dup_line_chars"] = _line_repeats(data, offsets, starts, chars)

    salted = hashes + mix(rows.astype(np.uint64))
    keys, inside = windows(salted, rows, 3)
    at = np.flatnonzero(inside)
    at = at[repeated(keys[at])]
    out["n_repeat_words"] = per_row(rows[covered(at, 3, len(rows))], n_rows)
    for n in sorted(lengths):
        # a longer n-gram can repeat only where the shorter one at the same start does
        if len(at):
            keys, inside = windows(salted, rows, n)
            at = at[at < len(keys)]
            at = at[inside[at]]
            at = at[repeated(keys[at])]
        again = np.ones(len(at), bool)
        again[np.unique(keys[at], return_index=True)[1]] = False
        hit = covered(at[again], n, len(rows))
        out[f"dup_{n}"] = per_row(rows[hit], n_rows, chars[hit])
    return out


def verdicts(stats: dict[str, np.ndarray], rules: RepetitionRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, symbols_failed, kept); kept is the verdict of the base rule and of repetition."""
    failed = (stats["n_words"] < rules.min_words) | (100 * stats["n_repeat_words"] > rules.repeat_words_percent * stats["n_words"])
    total = np.maximum(stats["word_chars"], 1)
    bad = stats["dup_line_chars"] > rules.line_chars * total
    for n, most in rules.ngrams.items():
        bad |= stats[f"dup_{n}"] > most * total
    return failed, stats["n_symbols"] > rules.symbols * total, ~failed & ~bad


def _measure(batch: pa.RecordBatch, text: str, rules: RepetitionRules) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    parts = [repetition(data, offsets[lo : hi + 1], list(rules.ngrams)) for lo, hi in row_groups(offsets)]
    if not parts:
        return {}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def repetition_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """One row for each row of docs: its id, the statistics, dup_n for each n of the rules, base_failed, symbols_failed and kept.

    A null or empty text has no words and fails the base rule. Repeated rows give repeated results; other columns of
    docs aren't read, so their names can't clash. An empty table gives an empty result.
    """
    rules = rules or RepetitionRules()
    bounded_batches(docs.sparkSession)
    names = [*STATS, *(f"dup_{n}" for n in sorted(rules.ngrams))]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), *(T.StructField(n, T.BooleanType()) for n in VERDICTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _measure(batch, "text", rules)
            if stats:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[n]) for n in names), *map(pa.array, verdicts(stats, rules))], names=schema.names)

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(tidy(run), schema)


def keep_by_rules(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were."""
    rules = rules or RepetitionRules()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if stats := _measure(batch, text_col, rules):
                yield batch.filter(pa.array(verdicts(stats, rules)[2]))

    return docs.mapInArrow(tidy(run), docs.schema)
