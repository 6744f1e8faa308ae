"""SentencePiece encoding and decoding by streaming Viterbi.

For every boundary of a text one backpointer is kept: the piece that ends there on the best path so far. Pieces are found
by a trie over code points. A boundary that no piece of the text spans is one where all surviving paths converge: the
ids before it are committed, and what follows starts afresh. The texts of a batch are worked on side by side in numpy:
all stretches between such boundaries take their next character at the same time. A stretch that goes on longer than most
is walked alone (stream), with a window bounded by the longest piece, and commits wherever all its paths meet.

Two kinds of models are known. For a unigram model the best path has the greatest sum of scores. For a merge (BPE) model
it is the one that the merges produce: a piece may follow another only if merging the two together leaves exactly these
two; with that, one path survives at each boundary and the ids are those of the library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import BLOCK, FIRST, mix, row_groups, text_bytes
from labelmill.llm.lm import Lookup
from labelmill.llm.shared import bounded_batches, given_back, received, sent, tidy

BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What a unigram model takes off its least score for a character without a piece. Fixed value.
UNKNOWN_PENALTY = 10.0
#: What stands between texts: no character.
STOP = 0x110000
#: Stretches are walked side by side as long as there are so many.
ABREAST = 32
#: Bits of the table of pairs of pieces that a worker remembers.
PAIR_BITS = 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class Vocabulary:
    """What a SentencePiece model file says: its pieces as a trie, how they are scored or merged, and how texts are normalised.

    Merge and unigram models are read; word and character models, user-defined pieces and blanks written after words are
    refused with a ValueError.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = f.read()
        model = [*_fields(proto)]
        trainer, normalizer = ({k: v for n, m in model if n == field for k, v in _fields(m)} for field in (2, 3))
        rows = [{1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(m)) for n, m in model if n == 1]
        self.pieces = [r[1].decode() for r in rows]
        kinds = np.array([r[3] for r in rows])
        scores = np.array([struct.unpack("<f", r[2])[0] for r in rows], np.float32)
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or (kinds == USER_DEFINED).any() or trainer.get(24):
            raise ValueError(f"{path}: only unigram and merge models without user-defined pieces, with blanks before words, are supported")
        #: Any other normalisation than writing blanks as U+2581 and putting one before the text is left to the library.
        self.prefix, self.escape = bool(normalizer.get(3, 1)), bool(normalizer.get(5, 1))
        self.normalizer = proto if normalizer.get(2) or normalizer.get(4, 1) or not self.escape else None
        byte_ids = np.flatnonzero(kinds == BYTE)
        self.bytes_from = int(byte_ids[0]) if len(byte_ids) else None
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0]) if (kinds == UNKNOWN).any() else 0
        silent = np.isin(kinds, (CONTROL, UNKNOWN, UNUSED))
        self.as_bytes = [b"" if quiet else bytes([i - self.bytes_from]) if k == BYTE else p.replace(BLANK, " ").encode() for i, (p, k, quiet) in enumerate(zip(self.pieces, kinds.tolist(), silent.tolist(), strict=True))]

        normal = [i for i in range(len(rows)) if kinds[i] == NORMAL and self.pieces[i]]
        ids = {self.pieces[i]: i for i in normal}
        # characters that stand in pieces, but aren't pieces, come after the pieces; the last number is any other character
        alone = sorted({c for p in ids for c in p} - set(ids))
        number = ids | {c: len(rows) + k for k, c in enumerate(alone)}
        self.other = len(rows) + len(alone)
        self.longest = max(map(len, ids), default=1)
        lengths = np.ones(self.other + 1, np.int32)
        lengths[list(ids.values())] = [len(p) for p in ids]
        self.lengths = lengths
        self.single = np.full(STOP + 1, self.other, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        if self.kind == BPE:
            self._merges(number, scores)
        else:
            self.score = np.full(self.other + 1, scores[kinds == NORMAL].min(initial=0) - np.float32(UNKNOWN_PENALTY), np.float32)
            self.score[normal] = scores[normal]
            self.found = {p: i for p, i in ids.items() if len(p) > 1}
        self._trie()

    def _merges(self, number: dict[str, int], scores: np.ndarray) -> None:
        """The order in which pieces are merged, of which two each one is made, and which two make one."""
        long = sorted((i for p, i in number.items() if len(p) > 1), key=lambda i: (-scores[i], i))
        rank = {self.pieces[i]: k for k, i in enumerate(long, 1)}
        self.rank = np.zeros(self.other + 1, np.int64)
        self.rank[long] = np.arange(1, len(long) + 1)
        self.halves = np.zeros((2, self.other + 1), np.int32)
        self.found = {}
        pairs = {}
        for p, k in rank.items():
            # only pieces that merging makes of their own characters can end a path
            if two := self._last_two(p, rank):
                self.found[p] = number[p]
                self.halves[:, number[p]] = number[two[0]], number[two[1]]
            for at in range(1, len(p)):
                a, b = number.get(p[:at]), number.get(p[at:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = k
        keys = mix(np.array(sorted(pairs), np.uint64))
        order = np.argsort(keys)
        self.pairs, self.pair_rank = Lookup(keys[order]), np.array([pairs[k] for k in sorted(pairs)], np.int64)[order]

    @staticmethod
    def _last_two(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
        """The two parts that are merged last: always the best pair, of equal ones the first."""
        parts, never = list(piece), len(rank) + 1
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: (rank.get(parts[k] + parts[k + 1], never), k))
            if parts[best] + parts[best + 1] not in rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def _trie(self) -> None:
        """Nodes of the beginnings of pieces: by first character, then by (node, next character); and the piece that ends at each."""
        nodes: dict[str, int] = {}
        for p in self.found:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        self.root = np.full(STOP + 1, -1, np.int32)
        self.node_piece = np.full(len(nodes) + 1, -1, np.int32)
        keys, to = [], []
        for p, node in nodes.items():
            self.node_piece[node] = self.found.get(p, -1)
            if len(p) == 1:
                self.root[ord(p)] = node
            else:
                keys.append(nodes[p[:-1]] << 21 | ord(p[-1]))
                to.append(node)
        mixed = mix(np.array(keys, np.uint64))
        order = np.argsort(mixed)
        self.steps, self.step_to = Lookup(mixed[order]), np.array(to, np.int32)[order]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    made = Vocabulary(path)
    given_back()
    return made


class Encoder:
    """Ids of texts by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known = np.full(1 << PAIR_BITS, -1, np.int64)
        self.fits = np.zeros(1 << PAIR_BITS, bool)
        self.normalizer = None
        if vocabulary.normalizer is not None:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceNormalizer(model_proto=vocabulary.normalizer, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=bool(dict(_fields(next(m for n, m in _fields(vocabulary.normalizer) if n == 3))).get(4, 1)))

    # merge models

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves each two as neighbours, remembered for so many pairs."""
        key = before.astype(np.int64) << 20 | piece
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            out[new] = self._follows(before[new], piece[new])
            # one of the pairs that share a slot stays: its answer is written with it
            self.known[slot[new]] = key[new]
            mine = new[self.known[slot[new]] == key[new]]
            self.fits[slot[mine]] = out[mine]
        return out

    def _follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves each two as neighbours.

        Both are taken apart again, the one that was merged later first. If at some point the two at the seam make a
        piece that would have been merged before that, they wouldn't have stayed apart.
        """
        v = self.v
        out = np.ones(len(before), bool)
        at, a, b = np.arange(len(before)), before.copy(), piece.copy()
        limit = np.full(len(before), len(v.rank) + 1, np.int64)
        while len(at):
            whole = v.pairs(mix(a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)))
            bad = (whole >= 0) & (v.pair_rank[whole] < limit) if len(v.pair_rank) else np.zeros(len(at), bool)
            out[at[bad]] = False
            left, right = v.rank[a], v.rank[b]
            go = ~bad & ((left > 0) | (right > 0))
            at, a, b, left, right = at[go], a[go], b[go], left[go], right[go]
            # what is further left is merged first, so an equal piece across the seam would come before
            first = left > right
            limit = np.where(first, left, right + 1)
            a, b = np.where(first, v.halves[1][a], a), np.where(first, b, v.halves[0][b])
        return out

    # all models

    def _matches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(spanned, of, pieces): whether a piece stands across the boundary before each character; and the numbers of the pieces that end at boundary e, longest first: pieces[of[e]:of[e + 1]]."""
        v = self.v
        n = len(x)
        edge, count = np.zeros(n + 2, np.int32), np.zeros(n + 2, np.int32)
        levels = []
        node = v.root[x]
        at = np.flatnonzero(node >= 0)
        node = node[at]
        for length in range(2, v.longest + 1):
            inside = at + length <= n
            at, node = at[inside], node[inside]
            found = v.steps(mix(node.astype(np.uint64) << np.uint64(21) | x[at + length - 1]))
            on = found >= 0
            at, node = at[on], v.step_to[found[on]]
            if not len(at):
                break
            piece = v.node_piece[node]
            full = piece >= 0
            start = at[full]
            levels.append((start + length, piece[full]))
            edge[start + 1] += 1
            edge[start + length] -= 1
            count[start + length] += 1
        count[1 : n + 1] += 1
        of = np.concatenate([[0], np.cumsum(count)])
        pieces = np.empty(of[-1], np.int32)
        put = of[:-1].copy()
        for end, piece in reversed(levels):
            pieces[put[end]] = piece
            put[end] += 1
        pieces[put[1 : n + 1]] = v.single[x]
        return np.cumsum(edge)[: n + 1] > 0, of, pieces

    def encode_block(self, x: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, the boundary where each one's piece ends, boundary up to which all is settled) of characters x; texts are parted by STOP. If more characters follow (not last), what they could change isn't settled."""
        v = self.v
        spanned, of, pieces = self._matches(x)
        starts = np.flatnonzero(~spanned[:-1]) if len(x) else np.zeros(0, np.int64)
        settled = len(x)
        if not last:
            starts = starts[starts <= len(x) - v.longest]
            settled = int(starts[-1]) if len(starts) else 0
            starts = starts[:-1]
        sizes = np.diff(np.append(starts, settled))
        real = x[starts] != STOP
        starts, sizes = starts[real], sizes[real]
        best = np.full(len(x) + 1, -1, np.int32)
        # of stretches of one character nothing is left open
        one = starts[sizes == 1]
        best[one + 1] = v.single[x[one]]
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        abreast = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 2 if len(sizes) else 0), "right")
        limit = 4 * v.longest
        while limit < len(abreast) and abreast[limit] >= ABREAST:
            limit += 1
        alone = int(abreast[limit]) if limit < len(abreast) else 0
        step = self._merge_step if v.kind == BPE else self._score_step
        score = np.zeros(len(x) + 1 if v.kind == UNIGRAM else 0, np.float32)
        for j in range(1, min(limit, len(abreast) - 1)):
            lanes = starts[alone : abreast[j]]
            step(lanes, lanes + j, of, pieces, best, score)
        chosen = np.zeros(len(x) + 1, bool)
        chosen[one + 1] = True
        begin, end = starts[alone:], (starts + sizes)[alone:]
        while len(end):
            chosen[end] = True
            end = end - v.lengths[best[end]]
            more = end > begin
            begin, end = begin[more], end[more]
        for a, b in zip(starts[:alone].tolist(), (starts + sizes)[:alone].tolist(), strict=True):
            for stop, piece in self.stream(x[a:b]):
                chosen[a + stop] = True
                best[a + stop] = piece
        ends = np.flatnonzero(chosen)
        ids, ends = self._ids(best[ends], ends, x)
        return ids, ends, settled

    def _merge_step(self, lanes: np.ndarray, ends: np.ndarray, of: np.ndarray, pieces: np.ndarray, best: np.ndarray, score: np.ndarray) -> None:
        """The piece that ends at ends in stretches that begin at lanes: the longest that may follow what ends before it."""
        v = self.v
        at, left = of[ends], np.arange(len(ends))
        while len(left):
            piece = pieces[at]
            begin = ends[left] - v.lengths[piece]
            ok = begin == lanes[left]
            inner = np.flatnonzero(~ok)
            if len(inner):
                ok[inner] = self.follows(best[begin[inner]], piece[inner])
            best[ends[left[ok]]] = piece[ok]
            left, at = left[~ok], at[~ok] + 1

    def _score_step(self, lanes: np.ndarray, ends: np.ndarray, of: np.ndarray, pieces: np.ndarray, best: np.ndarray, score: np.ndarray) -> None:
        """The piece with the greatest sum of scores; of equal ones the longest."""
        v = self.v
        at, stop, most = of[ends], of[ends + 1], np.full(len(ends), -np.inf, np.float32)
        left = np.arange(len(ends))
        while len(left):
            piece = pieces[at[left]]
            begin = ends[left] - v.lengths[piece]
            total = np.where(begin == lanes[left], np.float32(0), score[begin]) + v.score[piece]
            better = total > most[left]
            most[left[better]] = total[better]
            best[ends[left[better]]] = piece[better]
            at[left] += 1
            left = left[at[left] < stop[left]]
        score[ends] = most

    def stream(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(end, piece) of a stretch of any length, in order. Only boundaries within the longest piece's length can still be reached; where all paths from these go back to one boundary, what stands before it is committed and forgotten."""
        v, size, longest = self.v, len(x), self.v.longest
        text = "".join(map(chr, x.tolist()))
        single, number, merges = v.single[x].tolist(), v.found.get, v.kind == BPE
        remembered: dict[tuple[int, int], bool] = {}
        begins, ends_with, total = {0: 0}, {0: -1}, {0: np.float32(0)}
        committed = 0
        for j in range(1, size + 1):
            most = None
            for n in range(min(longest, j - committed), 0, -1):
                i = j - n
                piece = number(text[i:j]) if n > 1 else single[i]
                if piece is None:
                    continue
                if merges:
                    pair = ends_with[i], piece
                    fit = True if i == 0 else remembered.get(pair)
                    if fit is None:
                        if len(remembered) > 100_000:
                            remembered.clear()
                        fit = remembered[pair] = bool(self.follows(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
                    if fit:
                        begins[j], ends_with[j] = i, piece
                        break
                elif most is None or total[i] + v.score[piece] > most:
                    most = total[j] = total[i] + v.score[piece]
                    begins[j], ends_with[j] = i, piece
            if j - committed >= 4 * longest or j == size:
                alive = {j} if j == size else set(range(max(j - longest + 1, committed), j + 1))
                while len(alive) > 1:
                    furthest = max(alive)
                    alive.discard(furthest)
                    alive.add(begins[furthest])
                meet = alive.pop()
                path, at = [], meet
                while at > committed:
                    path.append((at, ends_with[at]))
                    at = begins[at]
                yield from reversed(path)
                if meet > committed:
                    committed = meet
                    begins, ends_with, total = ({k: t for k, t in d.items() if k >= committed} for d in (begins, ends_with, total))

    def _ids(self, pieces: np.ndarray, ends: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for numbers of pieces: a character without a piece becomes its bytes, or unknown."""
        v = self.v
        strange = pieces >= len(v.pieces)
        if not strange.any():
            return pieces, ends
        if v.bytes_from is None:
            return np.where(strange, v.unknown, pieces).astype(np.int32), ends
        codes = np.where(strange, x[ends - 1], 0)
        width = np.where(strange, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), 1)
        out, where = np.repeat(pieces, width), np.repeat(ends, width)
        data = np.frombuffer(codes[strange].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        out[np.repeat(strange, width)] = v.bytes_from + data.astype(np.int32)
        return out, where

    def _characters(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(normalised characters of texts with STOP after each, where each text ends in them)."""
        v = self.v
        if self.normalizer is not None:
            texts = [self.normalizer.normalize(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = np.array([len(t) for t in texts], np.int64)
            raw = "".join(texts)
        else:
            counts = np.concatenate([[0], np.cumsum(FIRST[data], dtype=np.int64)])
            sizes = np.diff(counts[offsets - offsets[0]])
            raw = data.tobytes().decode("utf-8", "surrogatepass")
        characters = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if v.escape:
            characters[characters == 0x20] = ord(BLANK)
        before = (sizes > 0) & v.prefix
        stops = np.cumsum(sizes + 1 + before)
        x = np.full(int(stops[-1]) if len(stops) else 0, STOP, np.uint32)
        firsts = stops - 1 - sizes
        x[firsts[before] - 1] = ord(BLANK)
        x[np.arange(len(characters)) + np.repeat(firsts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = characters
        return x, stops

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them). Longer texts than BLOCK are taken in slices, each as far as its paths have converged."""
        x, stops = self._characters(data[offsets[0] : offsets[-1]], offsets)
        out, ends, at, size = [], [], 0, BLOCK
        while at < len(x):
            stop = min(len(x), at + size)
            ids, where, settled = self.encode_block(x[at:stop], stop == len(x))
            if not settled:
                size *= 2
                continue
            out.append(ids)
            ends.append(where + at)
            at, size = at + settled, BLOCK
        ids, where = (np.concatenate(a) if a else np.zeros(0, np.int32) for a in (out, ends))
        if self.v.bytes_from is None:
            # neighbouring unknown characters are one
            unknown = ids == self.v.unknown
            once = ~(unknown & np.append(False, unknown[:-1]) & np.append(False, where[1:] == where[:-1] + 1)) if len(ids) else unknown
            ids, where = ids[once], where[once]
        return ids, np.concatenate([[0], np.searchsorted(where, stops)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0].astype(np.int32).tobytes()


class Decoder:
    """Texts of ids by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes = np.array([*map(len, vocabulary.as_bytes), 0])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(vocabulary.as_bytes), np.uint8)
        self.prefix = vocabulary.prefix

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids between offsets."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1).astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.data[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)]
        starts, stops = ends[offsets[:-1]], ends[offsets[1:]]
        if self.prefix:
            # the blank before the text
            starts = starts + ((starts < stops) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 0x20) if len(data) else 0)
        raw = data.tobytes()
        try:
            raw.decode()
            whole = FIRST[data[np.minimum(starts, len(data) - 1)]].all() if len(data) else True
        except UnicodeDecodeError:
            whole = False
        return pa.array([raw[a:b].decode("utf-8", "strict" if whole else "replace") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with ids_col, the ids of each whole text, instead of text_col; no beginning or end marks are added.

    A null or empty text has no ids. Columns that already are named ids_col or decoded_col are replaced. Rows keep their
    order, and repeated rows are encoded each. The model file is read on the driver; its pieces go to the executors.
    With decoded_col the ids are decoded again in the same pass.
    """
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    rest = [c for c in docs.columns if c not in (text_col, *added)]
    bounded_batches(docs.sparkSession)
    held_by_all = sent(docs.sparkSession, vocabulary(model_path))
    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, k) for c, k in zip(added, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = received(held_by_all)
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(rest)))
            for lo, hi in row_groups(offsets, BLOCK // 2):
                ids, ends = encoder.encode_rows(data, offsets[lo : hi + 1])
                out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded_col:
                    out.append(decoder.decode_rows(ids, ends))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(rest))), *out], names=[*rest, *added])

    return docs.select(*rest, F.col(text_col)).mapInArrow(tidy(run), schema)


def decoded(ids: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """ids with text_col, the text of ids_col, instead of ids_col: pieces joined, bytes put together, the blank before the text taken off.

    Null or empty ids give an empty text. A text that had the piece character U+2581 of its own has a blank there. Bytes
    that aren't UTF-8 give U+FFFD; ids outside the model give nothing.
    """
    rest = [c for c in ids.columns if c not in (text_col, ids_col)]
    bounded_batches(ids.sparkSession)
    held_by_all = sent(ids.sparkSession, vocabulary(model_path))
    schema = T.StructType([*(ids.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(received(held_by_all))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                column = part.column(len(rest))
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), decoder.decode_rows(values, np.concatenate([[0], np.cumsum(sizes)]))], names=[*rest, text_col])

    return ids.select(*rest, ids_col).mapInArrow(tidy(run), schema)
