"""Words and hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Both word classes used here are classes of bytes: every byte of a non-ASCII character is a word byte, so
working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words that white space separates: [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII digits, lower-case letters and all non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that begin a character.
FIRST = np.ones(256, bool)
FIRST[0x80:0xC0] = False

BLOCK = 1 << 20
#: Bytes that words are looked for in at once: what is worked on stays in the processor's cache.
WORK = 1 << 16
#: Two primes, and a base for each, of the polynomials by which segments are hashed.
_MODULI = ((2**31 - 1, 1_403_580_281), (2**31 - 19, 1_176_543_943))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each modulus the powers of its base, and of the base's inverse, from 0 to n at least."""
    if not _powers or len(_powers[0][0]) <= n:
        _powers.clear()
        for p, base in _MODULI:
            both = []
            for b in (base, pow(base, -1, p)):
                steps = np.ones(1 << n.bit_length(), np.uint64)
                have = 1
                while have < len(steps):
                    np.multiply(steps[:have], np.uint64(pow(b, have, p)), out=steps[have : 2 * have])
                    steps[have : 2 * have] %= np.uint64(p)
                    have *= 2
                both.append(steps)
            _powers.append((both[0], both[1]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _word_bounds(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends_at = breaks[(breaks > 0) & (breaks <= len(data))] - 1
    after[ends_at] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of data; segments are in order and don't overlap.

    Polynomials modulo two primes: unlike sums modulo 2**64 these have no strings that agree by construction. Work memory
    is bounded by BLOCK, however long segments are.
    """
    found = []
    if len(data) <= BLOCK:
        values = data.astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(data) + 1, np.uint64)
        for (p, _), (up, down) in zip(_MODULI, _power_tables(min(len(data), BLOCK)), strict=True):
            np.cumsum(values * up[: len(data)], out=total[1:])
            found.append((total[ends] - total[starts]) % np.uint64(p) * down[starts] % np.uint64(p))
        return mix((found[0] << np.uint64(32)) | found[1])
    for (p, base), (up, down) in zip(_MODULI, _power_tables(min(len(data), BLOCK)), strict=True):
        m = np.uint64(p)
        left, right, back = (np.zeros(len(starts), np.uint64) for _ in range(3))
        carry, scale, unscale = 0, 1, 1
        for lo in range(0, max(len(data), 1), BLOCK):
            block = data[lo : lo + BLOCK]
            total = np.zeros(len(block) + 1, np.uint64)
            # at most 2**20 terms below 2**39
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=total[1:])
            a, z = np.searchsorted(starts, [lo, lo + len(block)])
            at = starts[a:z] - lo
            left[a:z] = (total[at] % m * np.uint64(scale) + np.uint64(carry)) % m
            back[a:z] = down[at] * np.uint64(unscale) % m
            a, z = np.searchsorted(ends, [lo, lo + len(block)], "right")
            right[a:z] = (total[ends[a:z] - lo] % m * np.uint64(scale) + np.uint64(carry)) % m
            carry = (carry + int(total[-1]) % p * scale) % p
            scale, unscale = scale * pow(base, len(block), p) % p, unscale * pow(base, -len(block), p) % p
        found.append((right + m - left) % m * back % m)
    return mix((found[0] << np.uint64(32)) | found[1])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of the rows between offsets; starts and ends are byte positions in data.

    Work memory is bounded by WORK however long a text is, but for a single word longer than that.
    """
    base, out = int(offsets[0]), []
    end = int(offsets[-1])
    at = base
    while at < end:
        stop = min(end, at + WORK)
        if stop < end and not (stop == offsets[np.searchsorted(offsets, stop)]):
            gaps = np.flatnonzero(~table[data[at:stop]])
            cut = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if len(gaps):
                stop = max(at + int(gaps[-1]) + 1, cut if cut > at else 0)
            elif cut > at:
                stop = cut
            else:
                limit = int(offsets[np.searchsorted(offsets, at, "right")])
                while stop < limit:
                    gaps = np.flatnonzero(~table[data[stop : min(limit, stop + WORK)]])
                    if len(gaps):
                        stop += int(gaps[0])
                        break
                    stop = min(limit, stop + WORK)
        block = data[at:stop]
        if lower:
            block = LOWER[block]
        breaks = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        starts, ends = _word_bounds(block, breaks, table)
        out.append((segment_hashes(block, starts, ends), starts + at, ends + at))
        at = stop
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words, and which of them lie in one row; there is one window for each start."""
    m = max(0, len(hashes) - n + 1)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(total), rows[:m] == rows[n - 1 : n - 1 + m]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in one of the windows of n places that begin at starts."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, for each of n rows."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)
