import hashlib
import math
import random

import numpy as np
import pytest

from labelmill.llm import covertree
from labelmill.llm.centroids import LIMIT, assigned, centroid_clusters
from labelmill.llm.vector_dup import near_vectors


def clustered(rng, n, dim, copies=0.5, spread=0.2):
    x = rng.normal(size=(n, dim))
    near = rng.random(n) < copies
    x[near] = x[rng.integers(0, max(1, n // 10), near.sum())] + rng.normal(size=(near.sum(), dim)) * spread * rng.random((near.sum(), 1))
    return x


@pytest.mark.parametrize("n,dim", [(1, 4), (2, 4), (300, 3), (900, 16)])
def test_trees_cover_separate_and_nest(n, dim):
    rng = np.random.default_rng(n)
    x = clustered(rng, n, dim)
    x[n // 2 :: 7] = x[0]
    tree = covertree.build(x)
    y = x[tree.order]
    assert sorted(tree.order) == list(range(n)) and len(tree.center[-1]) == n
    reach = tree.radius[0][0]
    for k in range(tree.depth + 1):
        first, end = tree.first[k], tree.end[k]
        assert first[0] == 0 and end[-1] == n and (first[1:] == end[:-1]).all() and (tree.center[k] == first).all()
        for c, a, z, r in zip(tree.center[k], first, end, tree.radius[k], strict=True):
            assert np.linalg.norm(y[a:z] - y[c], axis=1).max() == pytest.approx(r, abs=1e-12)
        if k < tree.depth:
            kids, stop = tree.child[k]
            assert (tree.first[k + 1][kids] == first).all() and (tree.end[k + 1][stop - 1] == end).all()
        if 0 < k <= covertree.LEVELS and len(first) < n:
            assert (tree.radius[k] <= reach / 2**k + 1e-9).all()
            kids, stop = tree.child[k - 1]
            for a, z in zip(kids, stop, strict=True):
                d = covertree.squared(y[tree.center[k][a:z]], y[tree.center[k][a:z]])
                assert (d[np.triu_indices(z - a, 1)] > (reach / 2**k) ** 2 - 1e-9).all()


def brute_links(rows, cosine=0.9):
    """(n_links, component) of each row by all pairs."""
    fit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fit[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    linked = {i: {j for j in fit if j != i and len(fit[i]) == len(fit[j]) and float(fit[i] @ fit[j]) >= cosine} for i in fit}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j), todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (rows[i][0], len(linked.get(i, ())), min(names, default=None))
    return sorted(out.values(), key=str)


def found(df, **how):
    rows = near_vectors(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("how", [{}, {"block": 40, "nodes": (6, 3)}, {"block": 25, "nodes": (3, 2), "cosine": 0.97}, {"block": 7, "nodes": ()}, {"block": 60, "nodes": (10, 2), "cosine": 0.5}])
def test_links_equal_all_pairs(spark, how):
    rng = np.random.default_rng(5)
    x = clustered(rng, 400, 12).astype(np.float32)
    x[100:160] = x[3]
    x[160:190] = x[3] * np.float32(2.5)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, component_id string")
    assert found(df, **how) == brute_links(rows, how.get("cosine", 0.9))


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, -3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (None, [-1.0, -2.0, 3.0]), (None, [-2.0, -4.0, 6.0]), (11, [1e200, 2e200, -3e200]), (12, [-0.0, 0.0, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_links([(i, [x / 1e200 for x in v] if i == 11 else [0.0, 0.0, 1.0] if i == 12 else v) for i, v in rows])
    assert found(df) == want
    assert found(spark.createDataFrame([], df.schema)) == []
    assert found(spark.createDataFrame([(1, None)], df.schema)) == [(1, 0, 1)]
    with pytest.raises(ValueError):
        near_vectors(df, cosine=0.0)


def test_links_at_the_threshold(spark):
    # a cosine of exactly 0.6, and one a little below it
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0 - 1e-9, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, cosine=0.6) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_large_group_of_near_copies_and_a_chain(spark):
    rng = np.random.default_rng(8)
    hot = np.ones(8) + rng.normal(size=(1500, 8)) * 0.3
    turn = np.arange(200) * 0.4
    chain = np.stack([np.cos(turn), np.sin(turn)], 1) @ rng.normal(size=(2, 8))
    x = np.concatenate([hot, chain])
    rows = [(int(i), r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.where(links, label[None, :], len(x)).min(1)
        if (new == label).all():
            break
        label = new
    want = sorted(((i, int(links[i].sum()) - 1, int(label[i])) for i in range(len(x))), key=str)
    assert found(df) == want
    assert found(df, block=300, nodes=(8, 4)) == want


def brute_lloyd(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = [[max(-LIMIT, min(LIMIT, math.floor(float(c) * scale))) for c in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"3:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    c = [x[r] for r in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c)) for v in x]

    for _ in range(rounds):
        at = nearest()
        for n in range(len(c)):
            own = [v for v, (_, m) in zip(x, at, strict=True) if m == n]
            if own:
                c[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = nearest()
    of = {n: sum(d for d, m in at if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, n, d, of[n], sum(of.values()), sha[n]) for (i, _), (d, n) in zip(kept, at, strict=True)), key=str)


def test_lloyd_equals_brute_force(spark, sf):
    rng = random.Random(2)
    nan = float("nan")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).collect()]
    rows += [(900, rows[0][1]), (5, rows[1][1]), (901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 63 + [None]), (905, [nan] * 64), (None, [rng.random() for _ in range(64)]), (906, [-0.0004] * 64), (907, [1e30] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = centroid_clusters(df.repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lloyd(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lloyd_with_ties_few_vectors_and_none(spark):
    # whole numbers on a small grid: many are equally near to several centroids, and some centroids are equal
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 5, 12):
        assert sorted(map(tuple, centroid_clusters(df, k=k, dim=3, scale=1, rounds=4).collect()), key=str) == brute_lloyd(rows, k=k, dim=3, scale=1, rounds=4)
    few = rows[:3]
    assert sorted(map(tuple, centroid_clusters(spark.createDataFrame(few, df.schema), dim=3, scale=1).collect()), key=str) == brute_lloyd(few, dim=3, scale=1)
    assert centroid_clusters(spark.createDataFrame([], df.schema), dim=3).count() == 0


def test_nodes_are_given_whole():
    rng = np.random.default_rng(1)
    means = rng.integers(-5000, 5000, size=(6, 8))
    x = means[rng.integers(0, 6, 2000)] + rng.integers(-40, 40, size=(2000, 8))
    tree, over = covertree.build(x.astype(float)), covertree.build(means.astype(float))
    parts = assigned(x[tree.order], tree, means[over.order], over)
    label = np.full(2000, -1)
    for first, end, number in parts:
        for a, z, n in zip(first, end, number, strict=True):
            label[a:z] = n
    d = ((x[tree.order][:, None, :] - means[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all()
    assert sum(len(first) for first, _, _ in parts) < 100
