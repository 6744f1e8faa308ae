import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import arrays
from labelmill.llm.arrays import segment_hashes

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def check(texts, pattern, table, low):
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    got = []
    hashes = {}
    for lo, hi in arrays.row_groups(offsets):
        h, rows, starts, ends = arrays.words(data, offsets[lo : hi + 1], table, low)
        for x, r, a, b in zip(h.tolist(), rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            word = bytes(data[a:b]).decode()
            word = lower(word) if low else word
            got.append((r + lo, word))
            assert hashes.setdefault(word, x) == x
    assert len(set(hashes.values())) == len(hashes)
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, lower(t or "") if low else t or "")]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_words_equal_the_patterns(monkeypatch, block):
    monkeypatch.setattr(arrays, "BLOCK", block)
    texts = ["a b  c", None, "", "É é\nx" * 9, "long" * 40 + " end", "a-b_c,D9\x0b\x1f z", "  ", "q" * 200, "x y " * 50]
    check(texts, SPACED, arrays.SPACED, False)
    check(texts, ALNUM, arrays.ALNUM, True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_words_of_any_text(texts):
    check(texts, SPACED, arrays.SPACED, True)
    check(texts, ALNUM, arrays.ALNUM, True)


def test_windows_and_cover():
    h = np.array([1, 2, 1, 2, 1, 2], np.uint64)
    rows = np.array([0, 0, 0, 0, 1, 1])
    keys, inside = arrays.windows(h, rows, 2)
    assert inside.tolist() == [True, True, True, False, True]
    assert keys[0] == keys[2] == keys[4] != keys[1]
    assert arrays.covered(np.array([0, 3]), 2, 6).tolist() == [True, True, False, True, True, False]
    assert arrays.repeated(np.array([5, 6, 5])).tolist() == [True, False, True]


def test_segment_hashes_tell_alternating_strings_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    # sums modulo 2**64 give these two the same hash, whatever the base
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    at = np.arange(3) * len(a)
    h = segment_hashes(data, at, at + len(a))
    assert h[0] != h[1] and h[0] == h[2]


def test_segment_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 60))
    want = segment_hashes(data, cuts[:-1], cuts[1:])
    monkeypatch.setattr(arrays, "BLOCK", 137)
    assert (segment_hashes(data, cuts[:-1], cuts[1:]) == want).all()
    assert (want[:5] == np.concatenate([segment_hashes(data[a:b], np.zeros(1, int), np.array([b - a])) for a, b in zip(cuts[:5], cuts[1:6])])).all()
