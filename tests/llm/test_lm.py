import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from labelmill.llm import lm

W = r"[^\x20\x09-\x0D]+"


def toks(text):
    return [*re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(docs):
    train = [toks(t) for i, t in docs if not held(i)]
    c1 = Counter(w for ts in train for w in ts)
    total, distinct = sum(c1.values()), len(c1)
    scale = total + distinct + 1
    c2 = Counter((a, b) for ts in train for a, b in zip(ts, ts[1:]))
    c3 = Counter((a, b, c) for ts in train for a, b, c in zip(ts, ts[1:], ts[2:]))
    c2 = {k: c for k, c in c2.items() if c >= 2}
    c3 = {k: c for k, c in c3.items() if c >= 2}
    d = lm.DISCOUNT
    bow1, bow2 = {}, {}
    for (u, _), c in c2.items():
        bow1[u] = bow1.get(u, 1.0) - (c - d) / c1[u]
    for (u, v, _), c in c3.items():
        bow2[u, v] = bow2.get((u, v), 1.0) - (c - d) / c2[u, v]

    def p1(w):
        return (c1[w] + 1) / scale

    def p2(u, w):
        b = bow1.get(u, 1.0)
        return (c2[u, w] - d) / c1[u] + b * p1(w) if (u, w) in c2 else b * p1(w)

    def p3(t, u, w):
        if (t, u) not in bow2:
            return p2(u, w)
        b = bow2[t, u]
        return (c3[t, u, w] - d) / c2[t, u] + b * p2(u, w) if (t, u, w) in c3 else b * p2(u, w)

    out = {}
    for i, t in docs:
        ts = toks(t)
        score = 0.0
        for k, w in enumerate(ts):
            p = p1(w) if k == 0 else p2(ts[k - 1], w) if k == 1 else p3(ts[k - 2], ts[k - 1], w)
            score += math.log10(p)
        out[i] = (held(i), len(ts), sum(c1[w] > 0 for w in ts), total, sum(math.log10(p1(w)) for w in ts), score)
    return out


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    want = brute(docs)
    got = {r.doc_id: r for r in lm.language_scores(df).collect()}
    assert got.keys() == want.keys()
    for i, (h, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9), docs[i]
    return want


SMALL = ["a b c a b c a b d", "A b c.", None, "", "  ", "c a b e f", "a b c a b c", "zz a b c x", "a a a a", "b a b c q a b", "unseen words only"] * 4


def test_equals_brute_force(spark, sf):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = check(spark, list(enumerate([*docs, *SMALL])))
    assert sum(x[5] for x in want.values()) > sum(x[4] for x in want.values())


@pytest.mark.parametrize("bits", [(4, 2), (7, 3), (5, 12)])
def test_shards_and_splits_change_nothing(spark, bits, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_BITS", bits[0])
    monkeypatch.setattr(lm, "SPLIT_BITS", bits[1])
    monkeypatch.setattr(lm, "GROUP", 60)
    monkeypatch.setattr(lm, "SCORED_GROUP", 60)
    check(spark, list(enumerate([*SMALL, " ".join(f"w{k % 700}" for k in range(3000))] * 2)))


def test_cells_come_back():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**64, 800, dtype=np.uint64)
    names = lm.Names(words[:300])
    for order in (2, 3):
        columns = [words[rng.integers(0, 800, 5000)] for _ in range(order)]
        n = rng.integers(1, 1000, 5000)
        key = lm._keys(columns)[0]
        for bits in (3, 12, 20):
            by = np.argsort(key)
            key, columns, n = key[by], [c[by] for c in columns], n[by]
            parts = list(lm.split(key, bits))
            assert [s for s, _ in parts] == sorted(set((key >> np.uint64(64 - bits)).tolist()))
            got, m = lm.unpacked_ngrams(names, [lm.packed_ngrams([c[i] for c in columns], [names.numbers(c[i]) for c in columns], n[i]) for _, i in parts], order)
            assert sorted(zip(*(c.tolist() for c in got), m.tolist())) == sorted(zip(*(c.tolist() for c in columns), n.tolist()))
    parts = [lm.packed_asked(key[i], key[i] + np.uint64(1), n[i]) for _, i in lm.split(key, 4)]
    a, b, c = lm.unpacked_asked(parts)
    assert (np.sort(a) == np.sort(key)).all() and (a + np.uint64(1) == b).all() and c.sum() == n.sum()
    assert [len(a) for a in lm.unpacked_asked([])] == [0, 0, 0]
    none = lm.Names(words[:0])
    assert [len(a) for a in lm.unpacked_ngrams(none, [lm.packed_ngrams([words, words], [none.numbers(words)] * 2, words.astype(np.int64) & 7)], 2)[0]] == [800, 800]
    x = np.sort(words)
    w = rng.normal(size=800)
    k, c, v = lm.unpacked_arcs([lm.packed_arcs(x[i], -n[:800][i], w[i]) for _, i in lm.split(x, 3)][::-1])
    assert (k == x).all() and (c == -n[:800]).all() and (v == w).all()


def test_repeated_documents_score_apart(spark):
    rng = np.random.default_rng(8)
    ids = iter(range(10**6))
    def text():
        return " ".join(f"w{k}" for k in rng.integers(0, 3000, 120))
    train, out = [], []
    while len(train) < 60:
        i = next(ids)
        if not held(i):
            train.append((i, text()))
    while len(out) < 40:
        i = next(ids)
        if not held(i):
            continue
        out.append((i, text() if len(out) % 2 else train[len(out)][1]))
    twice = [(next(j for j in range(10**6 + 100 * k, 10**7) if not held(j)), train[2 * k][1]) for k in range(20)]
    got = {r.doc_id: r.score - r.base_score for r in lm.language_scores(spark.createDataFrame(train + twice + out, "doc_id long, text string")).collect()}
    copies, others = [got[i] for k, (i, _) in enumerate(out) if k % 2 == 0], [got[i] for k, (i, _) in enumerate(out) if k % 2]
    assert min(copies) > max(others) + 50


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.language_scores(df).count() == 0
    i = next(i for i in range(100) if held(i))
    got = lm.language_scores(spark.createDataFrame([(i, "a b"), (i, "a b"), (None, "x")], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.held_out for r in got)


def test_lookup():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        find = lm.Lookup(keys)
        assert (find(keys) == np.arange(len(keys))).all()
        assert (find(rng.integers(0, 2**64, 1000, dtype=np.uint64)) == -1).all()
    keys = np.array([2**64 - 9, 2**64 - 8, 2**64 - 3], np.uint64)
    assert lm.Lookup(keys)(np.array([2**64 - 8, 2**64 - 4, 2**64 - 2, 3], np.uint64)).tolist() == [1, -1, -1, -1]


def test_pairs_of_rare_words_have_arcs(spark):
    # every word is rarer than 2^-12 of the tokens, and each pair of x and y stands in two training texts
    train = [i for i in range(10000) if not held(i)][:3000]
    docs = [(i, f"x{k // 2} y{k // 2} z{k // 2} u{k}") for k, i in enumerate(train)]
    docs.append((next(i for i in range(10000) if held(i)), "x7 y7 z7 unseen"))
    want = check(spark, docs)
    assert all(x[5] > x[4] + 3 for x in want.values())


def test_keys_are_those_of_spark(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, (2, 100))
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) as k").collect()
    assert lm.ngram_key(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == [r.k for r in sorted(rows, key=lambda r: a.tolist().index(r.a))]
    bits = lm.bit_map(spark.createDataFrame([(x,) for x in a.tolist()], "k long"))
    assert lm.in_map(bits, a.view(np.uint64)).all() and lm.in_map(bits, b.view(np.uint64)).sum() < 20


@pytest.mark.parametrize("shares", [(1.0, 1.0), (2.0**-5, 2.0**-4)])
def test_what_is_held_changes_nothing(spark, monkeypatch, shares):
    monkeypatch.setattr(lm, "HEAD_SHARE", shares[0])
    monkeypatch.setattr(lm, "HEAD_ARC_SHARE", shares[1])
    check(spark, list(enumerate(["a b c a b c a b d", "A b c.", None, "", "c a b e f", "zz a b c x", "a a a a", "b a b c q a b"] * 4)))


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    ids = [i for i in range(400) if not held(i)][:6] + [i for i in range(400) if held(i)][:2]
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 800, 60_000))) for i in ids]
    docs[-1] = (docs[-1][0], docs[0][1])
    docs[1] = (docs[1][0], "y" * 3_000_000 + " " + docs[1][1])
    check(spark, docs)


def test_an_ngram_of_every_group_is_added_up_on_the_way(spark, monkeypatch):
    """Each text is a group and holds one pair that all hold: shards get it a few times, not once for each group."""
    for name, value in (("LEAST_BITS", 6), ("SPLIT_BITS", 2), ("GROUP", 40), ("SCORED_GROUP", 40)):
        monkeypatch.setattr(lm, name, value)
    seen = {}
    real = lm._resplit

    def kept(cells, again, bits):
        out = real(cells, again, bits)
        if "b" not in cells.columns and cells.columns == ["shard", "cell"] and not seen:
            seen["before"], seen["after"] = [r.cell for r in cells.collect()], [r.cell for r in out.collect()]
        return out

    monkeypatch.setattr(lm, "_resplit", kept)
    texts = [f"common pair own{i} word{i}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    names = np.zeros(0, np.uint64)
    got = lm._ngrams(df, 2, names, np.full(1 << 13, 255, np.uint8), 6).collect()
    assert [r.c for r in got] == [300]
    often = lambda cells: max(np.unique(lm._keys(lm.unpacked_ngrams(lm.Names(names), cells, 2)[0])[0], return_counts=True)[1])
    assert often(seen["before"]) == 300 and often(seen["after"]) <= 4
    assert sum(lm.unpacked_ngrams(lm.Names(names), seen["after"], 2)[1]) == sum(lm.unpacked_ngrams(lm.Names(names), seen["before"], 2)[1])
