"""Lloyd's algorithm over whole numbers by dual trees.

Vectors are packed in blocks, each with its cover tree (see covertree), once and where they are read: nothing is shuffled.
In each round the centroids get a cover tree too, and the two trees of each block are walked together from their roots.
A pair (node of vectors, node of centroids) goes if no centroid in it can be the nearest of any vector in the node, by
the distance of the two centers and both radii. A node of vectors that has one centroid left is given to it whole, by its
sum; pairs of vectors and centroids that are left at the last level are compared exactly, in whole numbers.

A round returns k counts and sums from each task, added up by Spark, so the driver holds k centroids and nothing that
grows with the vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm import covertree
from labelmill.llm.shared import bounded_batches, scratch, staged, tidy
from labelmill.llm.vectors import matrix, usable

#: Vectors of a block, at most.
BLOCK = 4096
#: Components are whole numbers up to this, so that squared distances fit a long.
LIMIT = 1 << 27


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as far as LIMIT goes."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def _exact(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Squared distances of x[i] and c[j] in whole numbers."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), chunk):
        d = x[i[lo : lo + chunk]] - c[j[lo : lo + chunk]]
        out[lo : lo + chunk] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(x: np.ndarray, tree: covertree.Tree, c: np.ndarray, over: covertree.Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches (first, end, centroid) of the rows of x, which are in tree's order: all rows, each with its nearest centroid, the one with the smaller number if several are. c is in the order of its own tree, over."""
    near, far = x.astype(np.float64), c.astype(np.float64)
    level, upper = 0, 0
    i, j, bound, out = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.inf), []
    while len(i):
        away = covertree.paired(near, far, tree.center[level][i], over.center[upper][j])
        here, there = tree.radius[level][i], over.radius[upper][j]
        room = 1e-9 * (1.0 + away.max())
        # the center of a node of centroids is one itself, so no vector's nearest is farther than this
        np.minimum.at(bound, i, away + here)
        left = away - here - there <= bound[i] + room
        i, j = i[left], j[left]
        if upper == over.depth:
            alone = np.bincount(i, minlength=len(bound))[i] == 1
            if alone.any():
                out.append((tree.first[level][i[alone]], tree.end[level][i[alone]], over.order[over.center[upper][j[alone]]]))
                i, j = i[~alone], j[~alone]
            if level == tree.depth:
                if len(i):
                    rows, number = tree.center[level][i], over.order[over.center[upper][j]]
                    by = np.lexsort((number, _exact(x, c, rows, over.center[upper][j]), i))
                    best = by[np.flatnonzero(np.diff(i[by], prepend=-1))]
                    out.append((rows[best], rows[best] + 1, number[best]))
                break
        if upper < over.depth and (level == tree.depth or over.radius[upper].max() >= tree.radius[level].max()):
            first, end = over.child[upper]
            size = (end - first)[j]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j, upper = np.repeat(i, size), np.repeat(first[j], size) + nth, upper + 1
        else:
            first, end = tree.child[level]
            size = (end - first)[i]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            handed = np.full(len(tree.center[level + 1]), np.inf)
            handed[np.repeat(first[i], size) + nth] = np.repeat(bound[i], size)
            i, j, bound, level = np.repeat(first[i], size) + nth, np.repeat(j, size), handed, level + 1
    return out


def _packed(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """Blocks of (ids, tree) of rows (id, vector)."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("tree", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = whole_numbers(matrix(part.column(1), dim), scale)
                tree = covertree.build(x.astype(np.float64))
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0).take(pa.array(tree.order)))
                packed = pickle.dumps((x[tree.order].astype(np.int32), tree.center, tree.first, tree.end, tree.radius, tree.child), protocol=5)
                yield pa.RecordBatch.from_arrays([ids, pa.array([packed], pa.binary())], names=["ids", "tree"])

    return rows.select("id", "vector").mapInArrow(tidy(run), schema)


def _walked(packed: bytes, centroids: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """(vectors in the tree's order, stretches, centroids)."""
    x, *tree = pickle.loads(packed)
    over = covertree.build(centroids.astype(np.float64))
    x = x.astype(np.int64)
    return x, assigned(x, covertree.Tree(np.arange(len(x)), *tree), centroids[over.order], over), centroids


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each centroid that has any, and their sum."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for packed in batch.column(0):
                x, stretches, _ = _walked(packed.as_py(), centroids)
                upto = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(x, axis=0)])
                for first, end, number in stretches:
                    count += np.bincount(number, weights=end - first, minlength=k).astype(np.int64)
                    np.add.at(total, number, upto[end] - upto[first])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks.select("tree").mapInArrow(tidy(run), "cluster long, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(d))) for d in range(dim))).alias("total"))
    return {r["cluster"]: (r["n"], r["total"]) for r in added.collect()}


def centroid_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """One row for each vector of dim finite components: its id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors are floor(scale * x). The first centroids are the k vectors with the smallest sha256 of salt and id, in that
    order; each round gives every vector to its nearest centroid (the smaller number of equally near ones) and puts each
    centroid that has vectors at the floor of their mean. All is exact. A vector that is null, has another
    number of components, or one that is null or not finite, is left out. Rows that repeat an id are vectors each; of equal
    hashes the smaller vector comes first; a null id is hashed as an empty one. With fewer than k vectors there are fewer centroids.
    Components count as LIMIT (2**27) where they are larger. Other columns aren't read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    with scratch() as keep:
        bounded_batches(spark)
        fit = usable("vector") & (F.size("vector") == dim)
        source = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector")).where(fit)
        blocks = staged(_packed(source, dim, scale), "vector-trees")
        rank = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        begin = source.orderBy(rank, "vector").limit(k).select("vector").collect()
        centroids = whole_numbers(np.array([r["vector"] for r in begin], np.float64).reshape(-1, dim), scale)
        for _ in range(rounds if len(centroids) else 0):
            moved = centroids.copy()
            for cluster, (n, total) in _sums(blocks, centroids).items():
                moved[cluster] = [t // n for t in total]
            # from here on nothing would change
            if (moved == centroids).all():
                break
            centroids = moved

        schema = T.StructType([rows.schema[id_col], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, packed in zip(batch.column(0), batch.column(1), strict=True):
                    x, stretches, c = _walked(packed.as_py(), centroids)
                    cluster = np.empty(len(x), np.int64)
                    for first, end, number in stretches:
                        size = end - first
                        cluster[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(number, size)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(_exact(x, c, np.arange(len(x)), cluster))], names=[id_col, "cluster", "distance"])

        out = keep(staged(blocks.mapInArrow(tidy(run), schema), "clusters"))
        inertia = {r["cluster"]: int(r["inertia"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
        facts = [(n, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n].tolist())).encode()).hexdigest()) for n in inertia]
        named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return out.join(F.broadcast(named), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
