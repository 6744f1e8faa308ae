"""Arrays of numbers and tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100
EPSILON = 1e-6


def _dot(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_dot(v))


def norm_matched(v: Column, target: Column | float) -> Column:
    """v scaled to the length target; lengths under EPSILON count as EPSILON."""
    target = target if isinstance(target, Column) else F.lit(float(target))
    # the length is named once, so that it isn't worked out for every element
    scale = F.array(target / F.greatest(norm(v), F.lit(EPSILON)))
    return F.flatten(F.transform(scale, lambda s: F.transform(v, lambda x: x.cast("double") * s)))


def mean(v: Column) -> Column:
    """Mean of an array of numbers, 0 if it is null or empty."""
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total, F.nullif(F.size(v), F.lit(-1))), F.lit(0.0))


def token_range(length: Column, n: Column | int, strategy: str, key: Column | None = None, seed: int = 0) -> Column:
    """struct(start, end): the half-open range of at most n tokens that a strategy takes; random is a seeded hash of key."""
    n = n if isinstance(n, Column) else F.lit(n)
    take = F.least(n, length)
    if strategy == "last":
        start = length - take
    elif strategy == "first":
        start = F.lit(0)
    elif strategy == "middle":
        start = F.least(F.greatest(F.floor(length / 2) - F.floor(take / 2), F.lit(0)), length - take)
    elif strategy == "random":
        if key is None:
            raise ValueError("random ranges need a key")
        start = F.pmod(F.xxhash64(F.lit(seed), key), length - take + 1)
    else:
        raise ValueError(f"unknown strategy of token selection: {strategy!r}")
    empty = length <= 0
    start = F.when(empty, F.lit(0)).otherwise(start).cast("long")
    return F.struct(start.alias("start"), F.when(empty, F.lit(0)).otherwise(start + take).cast("long").alias("end"))


def positions(span: Column) -> Column:
    """The positions of a range, one by one."""
    return F.when(span["end"] > span["start"], F.sequence(span["start"], span["end"] - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))


def padded(rows: Column, n: int, zero: Column) -> Column:
    """The first n elements, filled up with zero."""
    return F.slice(F.concat(F.coalesce(rows, F.array()), F.array_repeat(zero, F.greatest(n - F.coalesce(F.size(rows), F.lit(0)), F.lit(0)))), 1, n)


def filled_mask(rows: Column, n: int) -> Column:
    """n flags: 1 for an element, 0 for what was filled up."""
    have = F.least(F.coalesce(F.size(rows), F.lit(0)), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1).cast("tinyint"), have), F.array_repeat(F.lit(0).cast("tinyint"), n - have))


def right_padded(tokens: Column, width: Column, pad: int) -> Column:
    """Tokens filled up to width, as in a batch."""
    return F.concat(tokens, F.array_repeat(F.lit(pad).cast("int"), (width - F.size(tokens)).cast("int")))


def answer_labels(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens inside [start, end), IGNORED elsewhere."""
    return F.transform(tokens, lambda x, i: F.when((i >= start) & (i < end), x).otherwise(F.lit(IGNORED).cast("int")))


def cut_after(tokens: Column, stop: int) -> Column:
    """Tokens up to and with the first stop token."""
    at = F.array_position(tokens, F.lit(stop).cast("int"))
    return F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens)


def masked(rows: Column, mask: Column) -> Column:
    """Vectors set to zero where the mask is 0."""
    return F.zip_with(rows, mask, lambda v, m: F.when(m == 1, v).otherwise(F.transform(v, lambda x: x * 0)))


def spliced(a: Column, at: Column, b: Column) -> Column:
    """a with b put in at a place."""
    return F.concat(F.slice(a, F.lit(1), at.cast("int")), b, F.slice(a, (at + 1).cast("int"), F.size(a)))


def without_keys(m: Column, parts: list[str]) -> Column:
    """A map without keys that contain one of the parts."""
    return F.map_filter(m, lambda k, _: ~F.exists(F.array(*map(F.lit, parts)), lambda p: k.contains(p)))


def remapped_keys(m: Column, old: str, new: str) -> Column:
    """A map whose keys begin with new instead of old, unless a key begins with new already."""
    have = F.exists(F.map_keys(m), lambda k: k.startswith(new))
    moved = F.transform_keys(m, lambda k, _: F.when(k.startswith(old), F.concat(F.lit(new), F.substring(k, len(old) + 1, 1 << 30))).otherwise(k))
    return F.when(have, m).otherwise(moved)


def learning_rate_factor(step: Column, warmup: int, total: int, floor: float) -> Column:
    """Linear warm-up, then a cosine from 1 down to floor; 1 if there is nothing left after the warm-up."""
    step = step.cast("double")
    if total <= warmup + 1:
        after = F.lit(1.0)
    else:
        share = F.least(F.greatest((step - warmup) / float(total - warmup), F.lit(0.0)), F.lit(1.0))
        after = F.lit(floor) + F.lit(1.0 - floor) * 0.5 * (1.0 + F.cos(F.pi() * share))
    return F.when((F.lit(warmup) > 0) & (step < warmup), (step + 1.0) / float(max(warmup, 1))).otherwise(after)


def left_padded(tokens: Column, width: Column, pad: int) -> Column:
    """Tokens filled up to width from the left, as before generation."""
    return F.concat(F.array_repeat(F.lit(pad).cast("int"), (width - F.size(tokens)).cast("int")), tokens)


def contiguous(mask: Column) -> Column:
    """Whether the ones of a mask stand together."""
    edges = F.aggregate(mask, F.struct(F.lit(0).alias("last"), F.lit(0).alias("runs")), lambda acc, x: F.struct(x.cast("int").alias("last"), (acc["runs"] + F.when((x == 1) & (acc["last"] == 0), 1).otherwise(0)).alias("runs")))
    return edges["runs"] <= 1


def looked_up(names: Column, table: Column, default: int = -1) -> Column:
    """The number of a name in a map, or the default."""
    return F.coalesce(F.try_element_at(table, names), F.lit(default))


def tail(rows: Column, n: int) -> Column:
    """The last n elements, or all."""
    return F.when(F.size(rows) > n, F.slice(rows, F.size(rows) - n + 1, F.lit(n))).otherwise(rows)


def tail_spliced(into: Column, at: Column, rows: Column, n: int) -> Column:
    """A sequence with the last n of cached rows in the place of those from at on that they take."""
    window = tail(rows, n)
    return F.concat(F.slice(into, F.lit(1), at.cast("int")), window, F.slice(into, (at + F.size(window) + 1).cast("int"), F.size(into)))


def shown_window(tokens: Column, n: int) -> Column:
    """What a page shows of the last n tokens: (prefix, window, pieces, truncated): the text before them, their text, each with its place in the whole, and how many stand before."""
    cut = F.greatest(F.size(tokens) - n, F.lit(0))
    pieces = F.transform(tail(tokens, n), lambda t, i: F.struct(t.alias("text"), (cut + i).cast("int").alias("response_index")))
    return F.struct(F.array_join(F.slice(tokens, F.lit(1), cut), "").alias("prefix"), F.array_join(tail(tokens, n), "").alias("window"), pieces.alias("pieces"), cut.cast("int").alias("truncated"))


def joined_sequence(soft: Column, prefix: Column, candidate: Column, width: Column, pad: Column, from_left: bool) -> Column:
    """struct(rows, mask, candidate_start): soft, prefix and candidate rows one after the other, filled up to width from one side, with the flags of what isn't filling; an error if what isn't filling doesn't stand together or doesn't fit."""
    body = F.concat(soft, prefix, candidate)
    missing = (width - F.size(body)).cast("int")
    filling = F.array_repeat(pad, F.greatest(missing, F.lit(0)))
    ones, zeros = F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), F.greatest(missing, F.lit(0)))
    rows, mask = (F.concat(filling, body), F.concat(zeros, ones)) if from_left else (F.concat(body, filling), F.concat(ones, zeros))
    checked = F.when((missing >= 0) & contiguous(mask), mask).otherwise(F.raise_error(F.concat(F.lit("a sequence doesn't fit into "), width.cast("string"))))
    start = F.size(soft) + F.size(prefix) + (F.greatest(missing, F.lit(0)) if from_left else F.lit(0))
    return F.struct(rows.alias("rows"), checked.alias("mask"), start.cast("int").alias("candidate_start"))


def retrieval_inputs(vectors: Column, target_norm: float, before: Column, after: Column) -> Column:
    """Vectors scaled to a norm, between the embeddings of what stands before and after them."""
    return F.concat(before, F.transform(vectors, lambda v: norm_matched(v, target_norm)), after)
