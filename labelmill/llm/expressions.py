"""Expressions over arrays that take time in proportion to an array's size.

An array that is appended to inside aggregate() is copied each time. Here running values are found in chunks of CHUNK
elements, then over the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
#: Spans that are cut out of a text at once.
CUT = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(values: Column, size: int) -> Column:
    """The elements in arrays of size, the last one shorter."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda k: F.slice(values, k * size + 1, F.lit(size)))


def _scan(values: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    return F.aggregate(values, F.expr(f"cast(array() as array<{kind}>)"), lambda done, x: F.array_append(done, F.when(F.size(done) > 0, join(F.get(done, F.size(done) - 1), x)).otherwise(x)))


def running(values: Column, join: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element what join, an associative function, makes of all elements up to it."""

    def joined(inside: Column) -> Column:
        ends = _scan(F.transform(inside, lambda c: F.get(c, F.size(c) - 1)), join, kind)
        return let(ends, lambda e: F.flatten(F.transform(inside, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: join(F.get(e, i - 1), x))))))

    return let(values, lambda v: let(F.transform(chunks(v, CHUNK), lambda c: _scan(c, join, kind)), joined))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def joined_runs(parts: Column) -> Column:
    """Runs (first, end) of sorted parts (start, end) that overlap or touch."""

    def found(p: Column, upto: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["start"] > F.get(upto, i - 1)))
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.get(p, i)["start"].cast("long").alias("first"), F.get(upto, F.coalesce(F.get(f, k + 1), F.size(p)) - 1).cast("long").alias("end"))))

    return F.when(F.size(parts) > 0, let(parts, lambda p: let(running(F.transform(p, lambda x: x["end"]), F.greatest), lambda upto: found(p, upto))))


def replaced(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """text with name(span) in place of each of its spans (start, end), which are in order and don't overlap. The text is cut up by CUT spans at a time, since a place in it is found from its beginning."""

    def part(group: Column, before: Column) -> Column:
        stretch = text.substr(before + 1, F.get(group, F.size(group) - 1)["end"] - before)
        since = lambda i: F.when(i == 0, before).otherwise(F.get(group, i - 1)["end"])
        return let(stretch, lambda t: F.array_join(F.transform(group, lambda s, i: F.concat(t.substr(since(i) - before + 1, s["start"] - since(i)), name(s))), ""))

    def whole(groups: Column) -> Column:
        ends = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.get(groups, k - 1), F.size(F.get(groups, k - 1)) - 1)["end"])
        return F.concat(F.array_join(F.transform(groups, lambda g, k: part(g, ends(k))), ""), text.substr(ends(F.size(groups)) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(chunks(s, CUT), whole))).otherwise(text)
