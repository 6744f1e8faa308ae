"""Near-duplicate vectors by cosine, found by walking pairs of cover trees.

1. Rows with equal vectors are one class. Classes are dealt to cells: a bounded sample of vectors gives the upper levels of
   the cover tree, each class goes to the nearest of them, and neighbours in the tree are put together up to BLOCK
   vectors. A cell that is larger gets nodes of its own once more; what is still larger is cut up by hash.
2. Each block becomes one packed row: its vectors in the order of its cover tree, and the tree (see covertree).
3. Pairs of blocks whose distance less both radii is over the threshold are left out; every other pair is one row of a
   join, and is walked from both roots: pairs of nodes too far from each other go, pairs so near that all members must be
   linked are linked whole, all others are opened. At the last level pairs of vectors are compared in double precision.
4. A pair of blocks returns, for each of its vectors that has links, their number and one vector of its component: never
   the links themselves. Numbers are added, components joined.

Distances are those of unit vectors: a cosine of c is a distance of sqrt(2 - 2c). Vectors of different lengths are never
linked. The work on vectors that no radius separates is that of all pairs, in matrix products; nothing exact can avoid it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm import covertree
from labelmill.llm.near_dup import components
from labelmill.llm.shared import bounded_batches, received, scratch, sent, staged, tidy
from labelmill.llm.vectors import matrix, unit, usable

#: Vectors of a block, at most but for chance.
BLOCK = 8192
#: Vectors sampled for the upper levels, and again for each cell that is too large.
NODES, MORE_NODES = 512, 64
#: Places of a block's vectors in the numbers of classes.
PLACES = 1 << 20
#: Bounds are taken with this much room for rounding, in double and in single precision.
ROOM, SINGLE = 1e-9, 2e-5
#: Tasks that pairs of blocks are dealt to, at most.
TASKS = 1 << 15
#: Pairs that are held at once.
PAIRS = 1 << 22


@dataclass
class _Side:
    """A block in a task: unit vectors in the tree's order, numbers of rows that each stands for, and their running sum."""

    x: np.ndarray
    weight: np.ndarray
    tree: covertree.Tree

    def __post_init__(self):
        self.single = self.x.astype(np.float32)
        self.before = np.concatenate([[0], np.cumsum(self.weight)])


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[k] and b[k] for all k; labels name the smallest member."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


class _Walk:
    """The links between two blocks, or within one."""

    def __init__(self, a: _Side, b: _Side, cosine: float):
        self.a, self.b, self.same = a, b, a is b
        self.cosine, self.reach = cosine, float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
        n, m = len(a.x), 0 if self.same else len(b.x)
        self.shift = 0 if self.same else n
        self.labels = np.arange(n + m)
        self.found = np.zeros(n + m, np.int64)
        self.edge = np.zeros(n + m + 1, np.int64)
        self.depth = max(a.tree.depth, b.tree.depth)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of links, label) of each vector."""
        todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            i, j = self._bounded(level, i, j)
            if level < self.depth and len(i):
                todo += [(level + 1, x, y) for x, y in self._opened(level, i, j)]
        self.found += np.cumsum(self.edge[:-1])
        return self.found, self.labels

    def _at(self, side: _Side, level: int, nodes: np.ndarray):
        t, k = side.tree, min(level, side.tree.depth)
        return t.center[k][nodes], t.radius[k][nodes], t.first[k][nodes], t.end[k][nodes]

    def _bounded(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes that have to be opened; those that are linked whole, or compared, are settled."""
        (ca, ra, fa, ea), (cb, rb, fb, eb) = self._at(self.a, level, i), self._at(self.b, level, j)
        away = covertree.paired(self.a.x, self.b.x, ca, cb)
        last = level == self.depth
        if last:
            linked = np.einsum("ij,ij->i", self.a.x[ca], self.b.x[cb]) >= self.cosine
            if self.same:
                linked &= i != j
            self._link_vectors(ca[linked], cb[linked])
            return i[:0], j[:0]
        whole = away + ra + rb <= self.reach - ROOM
        if whole.any():
            self._link_nodes(i[whole] == j[whole] if self.same else None, fa[whole], ea[whole], fb[whole], eb[whole])
        left = ~whole & (away - ra - rb <= self.reach + ROOM)
        return i[left], j[left]

    def _link_vectors(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.found, p, self.b.weight[q])
        np.add.at(self.found, q + self.shift, self.a.weight[p])
        _joined(self.labels, p, q + self.shift)

    def _link_nodes(self, own: np.ndarray | None, fa: np.ndarray, ea: np.ndarray, fb: np.ndarray, eb: np.ndarray) -> None:
        """All members of nodes fa..ea with all of fb..eb; own: which pairs are a node and itself."""
        in_a, in_b = self.a.before[ea] - self.a.before[fa], self.b.before[eb] - self.b.before[fb]
        np.add.at(self.edge, fa, in_b), np.add.at(self.edge, ea, -in_b)
        other = slice(None) if own is None else ~own
        np.add.at(self.edge, fb[other] + self.shift, in_a[other]), np.add.at(self.edge, eb[other] + self.shift, -in_a[other])
        if own is not None:
            for f, e in zip(fa[own].tolist(), ea[own].tolist(), strict=True):
                self.found[f:e] -= self.a.weight[f:e]
        for side, f, e in ((0, fa, ea), (self.shift, fb, eb)):
            members = np.repeat(f - np.concatenate([[0], np.cumsum(e - f)[:-1]]), e - f) + np.arange((e - f).sum())
            _joined(self.labels, members + side, np.repeat(fa, e - f))

    def _kids(self, side: _Side, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level >= side.tree.depth:
            return nodes, nodes + 1
        first, end = side.tree.child[level]
        return first[nodes], end[nodes]

    def _opened(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of children, in parts; those of large nodes that a product of their centers rules out aren't listed."""
        (fa, ea), (fb, eb) = self._kids(self.a, level, i), self._kids(self.b, level, j)
        na, nb = ea - fa, eb - fb
        large = na * nb > 1 << 14
        for k in np.flatnonzero(large).tolist():
            yield from self._products(level + 1, int(fa[k]), int(ea[k]), int(fb[k]), int(eb[k]), self.same and i[k] == j[k])
        i, j, fa, fb, na, nb = (v[~large] for v in (i, j, fa, fb, na, nb))
        ends = np.cumsum(na * nb)
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            size = (na * nb)[lo:hi]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(nb[lo:hi], size)
            x, y = np.repeat(fa[lo:hi], size) + nth // wide, np.repeat(fb[lo:hi], size) + nth % wide
            if self.same:
                keep = (np.repeat(i[lo:hi] != j[lo:hi], size)) | (x <= y)
                x, y = x[keep], y[keep]
            yield x, y
            lo = hi

    def _products(self, level: int, fa: int, ea: int, fb: int, eb: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cb, rb, _, _ = self._at(self.b, level, np.arange(fb, eb))
        right = self.b.single[cb].T
        most = float(rb.max())
        step = max(1, PAIRS // max(1, eb - fb))
        for lo in range(fa, ea, step):
            nodes = np.arange(lo, min(lo + step, ea))
            ca, ra, _, _ = self._at(self.a, level, nodes)
            skip = lo - fa if own else 0
            least = 1.0 - (self.reach + ra + most) ** 2 / 2 - SINGLE
            x, y = np.nonzero(self.a.single[ca] @ right[:, skip:] >= least[:, None].astype(np.float32))
            x, y = x + lo, y + fb + skip
            if own:
                x, y = x[x <= y], y[x <= y]
            for at in range(0, len(x), PAIRS):
                yield x[at : at + PAIRS], y[at : at + PAIRS]


def _side(packed: bytes) -> _Side:
    raw, weight, tree = pickle.loads(packed)
    return _Side(unit(raw), weight, covertree.Tree(*tree))


def _compared(pairs: DataFrame, cosine: float) -> DataFrame:
    """(class, n, near) for each pair (a, b, tree_a, tree_b) and each class in it that has links there: their number, and a class of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                left = _side(batch.column(2)[k].as_py())
                right = left if a == b else _side(batch.column(3)[k].as_py())
                n, label = _Walk(left, right, cosine).run()
                names = a * PLACES + np.arange(len(left.x))
                if a != b:
                    names = np.concatenate([names, b * PLACES + np.arange(len(right.x))])
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(n[at]), pa.array(names[label[at]])], names=["class", "n", "near"])

    return pairs.select("a", "b", "tree_a", "tree_b").mapInArrow(tidy(run), "class long, n long, near long")


def _packed(placed: DataFrame) -> DataFrame:
    """One row for each block: (block, top, center, radius, tree, members)."""
    member = T.StructType([placed.schema["k1"], placed.schema["k2"], placed.schema["rep"]])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("top", T.LongType()), T.StructField("center", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("tree", T.BinaryType()), T.StructField("members", T.ArrayType(member))])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        raw = matrix(group["vector"], len(group["vector"][0].as_py()))
        x = unit(raw)
        tree = covertree.build(x)
        order = pa.array(tree.order)
        members = pa.StructArray.from_arrays([group[c].combine_chunks().take(order) for c in ("k1", "k2", "rep")], names=["k1", "k2", "rep"])
        packed = pickle.dumps((raw[tree.order], group["weight"].to_numpy()[tree.order], (np.arange(len(raw)), tree.center, tree.first, tree.end, tree.radius, tree.child)), protocol=5)
        return pa.table([
            group["block"].slice(0, 1),
            group["top"].slice(0, 1),
            pa.array([x[tree.order[0]]], pa.list_(pa.float64())),
            pa.array([float(tree.radius[0][0])]),
            pa.array([packed], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), members),
        ], names=schema.names)

    return placed.select("block", "top", "k1", "k2", "rep", "weight", "vector").groupBy("block").applyInArrow(tidy(run), schema)


def _nearest(classes: DataFrame, nodes: dict[int, np.ndarray]) -> DataFrame:
    """classes with leaf and away: for rows of a cell with nodes, which of these is nearest, and how far."""
    schema = T.StructType([*classes.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("away", T.DoubleType())])
    shared = sent(classes.sparkSession, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("vector"))
            leaf, away = np.zeros(len(cells), np.int32), np.zeros(len(cells))
            for cell in np.unique(cells).tolist():
                if cell not in known:
                    continue
                at = np.flatnonzero(cells == cell)
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    x = unit(matrix(vectors.take(pa.array(part)), known[cell].shape[1]))
                    leaf[part] = (x @ known[cell].T).argmax(1)
                    away[part] = covertree.paired(x, known[cell], np.arange(len(part)), leaf[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(away)], names=schema.names)

    return classes.mapInArrow(tidy(run), schema)


def _runs(sizes: list[int], most: int) -> list[int]:
    """A number for each of a row of sizes: neighbours have the same one while their sum is most or less."""
    out, run, total = [], -1, most
    for n in sizes:
        if total + n > most:
            run, total = run + 1, 0
        total += n
        out.append(run)
    return out


def _dealt(classes: DataFrame, cosine: float, block: int, nodes: tuple[int, int]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """classes with their block and top cell, and the pairs of top cells that the upper levels don't rule out. What the driver holds is bounded by the numbers of nodes."""
    spark = classes.sparkSession
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    table = classes.withColumn("cell", F.size("vector").cast("long")).withColumn("top", F.col("cell"))
    sizes = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = [(c, c) for c in sizes]
    following = max(sizes, default=0) + 1
    for depth, count in enumerate(nodes):
        large = {c: n for c, n in sizes.items() if n > block}
        if not large:
            break
        share = F.create_map(*(F.lit(v) for c, n in large.items() for v in (c, count / n)))
        chance = F.pmod(F.col("k1"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample: dict[int, list] = {}
        for r in table.where(chance < F.coalesce(share[F.col("cell")], F.lit(0.0))).select("cell", "vector").collect():
            sample.setdefault(r["cell"], []).append(r["vector"])
        known = {}
        for c, found in sample.items():
            x = unit(np.array(found))
            known[c] = x[covertree.build(x).order]
        table = staged(_nearest(table, known), "placed")
        seen = sorted((r["cell"], r["leaf"], r["n"], r["away"]) for r in table.groupBy("cell", "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect())
        places, sizes = [], {}
        for c in dict.fromkeys(r[0] for r in seen):
            own = [r for r in seen if r[0] == c]
            runs = [following + k for k in _runs([r[2] for r in own], block)] if c in known else [c] * len(own)
            following = max(following, *runs) + 1
            for (_, leaf, n, _), to in zip(own, runs, strict=True):
                places.append((c, leaf, to))
                sizes[to] = sizes.get(to, 0) + n
            if depth == 0 and c in known:
                centers, radius = known[c][[r[1] for r in own]], np.array([r[3] for r in own])
                near = np.sqrt(covertree.squared(centers, centers)) <= reach + radius[:, None] + radius[None, :] + ROOM
                cuts = np.flatnonzero(np.diff(runs, prepend=-1))
                near = np.logical_or.reduceat(np.logical_or.reduceat(near, cuts, 0), cuts, 1)
                pairs.remove((c, c))
                pairs += [(runs[cuts[i]], runs[cuts[j]]) for i, j in zip(*np.nonzero(np.triu(near)), strict=True)]
        moved = spark.createDataFrame(places, "cell long, leaf int, to long")
        table = table.join(F.broadcast(moved), ["cell", "leaf"]).drop("leaf", "away")
        table = (table.withColumn("top", F.col("to")) if depth == 0 else table).drop("cell").withColumnRenamed("to", "cell")
    parts, base = [], 0
    for c, n in sorted(sizes.items()):
        parts.append((c, base, -(-n // block)))
        base += parts[-1][2]
    cut = spark.createDataFrame(parts, "cell long, base long, parts long")
    return table.join(F.broadcast(cut), "cell").withColumn("block", F.col("base") + F.pmod("k2", "parts")), pairs


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = BLOCK, nodes: tuple[int, int] = (NODES, MORE_NODES)) -> DataFrame:
    """One row for each row of rows: its id, n_links, component_id and kept.

    Two vectors are linked if their cosine, in double precision, is cosine (over 0) or more. n_links counts linked rows,
    equal vectors among them; component_id is the smallest id that links reach, kept says whether that is the row's own.
    A vector that is null, empty or zero, or has a component that is null or not finite, is linked with nothing, nor are
    vectors of different lengths. Rows that repeat an id are all given, each placed by its own vector. A null id counts as
    larger than any. Other columns aren't read. An empty table gives an empty result.
    """
    if not 0.0 < cosine <= 1.0:
        raise ValueError("cosine must be over 0 and at most 1")
    spark = rows.sparkSession
    with scratch() as keep:
        bounded_batches(spark)
        source = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector"))
        fit = usable("vector") & F.exists("vector", lambda x: x != 0)
        keyed = source.select("id", "vector", F.when(fit, F.xxhash64("vector")).alias("k1"), F.when(fit, F.xxhash64(F.lit(7), "vector")).alias("k2"))
        classes = staged(keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("rep")), "classes")
        placed, tops = _dealt(classes, cosine, block, nodes)
        trees = keep(staged(_packed(placed), "trees"))

        reach = float(np.sqrt(2.0 - 2.0 * cosine))
        top_pairs = spark.createDataFrame(tops, "top_a long, top_b long")
        blocks = trees.select("block", "top", "center", "radius")
        a, b = blocks.toDF("a", "top_a", "center_a", "radius_a"), blocks.toDF("b", "top_b", "center_b", "radius_b")
        away = F.sqrt(F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        block_pairs = top_pairs.join(a, "top_a").join(b, "top_b").where((F.col("top_a") != F.col("top_b")) | (F.col("a") <= F.col("b")))
        block_pairs = staged(block_pairs.where(away <= F.lit(reach + ROOM) + F.col("radius_a") + F.col("radius_b")).select("a", "b"), "block-pairs")
        both = block_pairs.join(trees.select(F.col("block").alias("a"), F.col("tree").alias("tree_a")), "a").join(trees.select(F.col("block").alias("b"), F.col("tree").alias("tree_b")), "b")
        found = staged(_compared(both.repartition(min(TASKS, max(1, block_pairs.count())), "a", "b"), cosine), "found")

        label = keep(components(found.where("class <> near").select(F.col("class").alias("a"), F.col("near").alias("b"))))
        counts = keep(staged(found.groupBy("class").agg(F.sum("n").alias("n")), "counts"))
        named = trees.select("block", F.posexplode("members").alias("place", "m")).select((F.col("block") * PLACES + F.col("place")).alias("class"), "m.k1", "m.k2", "m.rep")
        named = named.join(counts, "class", "left").join(label.withColumnRenamed("id", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        least = named.groupBy("label").agg(F.min("rep").alias("least"))
        facts = keep(staged(named.join(least, "label").join(classes.select("k1", "k2", "weight"), ["k1", "k2"]).select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "least"), "facts"))
        out = keyed.select("id", "k1", "k2").join(facts, ["k1", "k2"], "left")
        out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
        return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
