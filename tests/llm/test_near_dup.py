import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import near_dup
from labelmill.llm.arrays import text_bytes

W = r"[^\x20\x09-\x0D]+"


def shingles(text):
    ws = re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    label = {i: i for i, _ in docs}
    holds = {}
    for k, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in holds.values() for a in ks for b in ks if a < b}
    links = []
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((docs[a][0], docs[b][0]))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return {i: (len(s), label[i], label[i] == i) for (i, _), s in zip(docs, sets, strict=True)}


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute(docs)
    return df


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, docs)


def test_groups_around_a_base_text(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW_MEMBERS", 4)
    rng = random.Random(5)
    docs, i = [], 0
    for _ in range(3):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 10**6)}"
            docs.append((i := i + 1, " ".join(t)))
    chain = [f"c{k}" for k in range(200)]
    for k in range(10):
        docs.append((i := i + 1, " ".join(chain[4 * k : 4 * k + 120])))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c d e"), (1006, docs[0][1].upper().replace("X", "x")), (1007, docs[0][1])]
    df = check(spark, docs)
    want = brute(docs)
    assert sorted(r.doc_id for r in near_dup.one_of_each(df.union(df)).collect()) == sorted(k for k, v in want.items() if v[2])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(df).count() == 0 and near_dup.one_of_each(df).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (2, None)], "doc_id long, text string")
    assert near_dup.near_duplicates(df).count() == 2


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for same in (60, 85, 95):
        sets = [" ".join(f"s{x}" for x in range(400)), " ".join(f"s{x}" for x in [*range(4 * same), *range(1000, 1400 - 4 * same)])]
        a, b = near_dup.shingle_sets(*text_bytes(pa.array(sets)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = near_dup.estimated(near_dup.packed(near_dup.minima(a))[None], near_dup.packed(near_dup.minima(b))[None])[0]
        assert abs(true - guess) < 0.12
    a = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    assert near_dup.estimated(near_dup.packed(near_dup.minima(a)), near_dup.packed(near_dup.minima(a))) == 1.0


def test_pair_whose_leader_has_another_first_leader(spark, monkeypatch):
    text = {i: " ".join(f"t{i}w{k}" for k in range(60)) for i in (1, 3, 4, 5, 6, 7)}
    docs = [(1, text[1]), (2, text[1] + " tail"), *((i, text[i]) for i in (3, 4, 5, 6, 7))]
    # 3 leads the one bucket that 1 and 2 share, and is itself led by 4, which is in more company
    bands = {1: [100, 1], 2: [100, 2], 3: [100, 200], 4: [300, 200], 5: [300, 5], 6: [300, 6], 7: [300, 7]}
    real = near_dup.signatures

    def crafted(*args):
        named = spark.createDataFrame(list(bands.items()), "id long, bands array<long>")
        return real(*args).drop("bands").join(named, "id")

    monkeypatch.setattr(near_dup, "signatures", crafted)
    assert brute(docs)[2] == (57, 1, False)
    check(spark, docs)


def test_pair_whose_leader_is_led_by_a_larger_group(spark):
    rng = random.Random(11)
    new = lambda: f"n{rng.randint(0, 10**9)}"
    docs = []
    for g in range(12):
        core = [new() for _ in range(300)]
        a, b, leader = (core + [new() for _ in range(k)] for k in (25, 25, 28))
        docs += [(1000 * g + 1, " ".join(a)), (1000 * g + 2, " ".join(b)), (1000 * g + 3, " ".join(leader))]
        for k in range(12):
            docs.append((1000 * g + 10 + k, " ".join([*leader[:240], *(new() for _ in range(70))])))
    check(spark, docs)


def test_open_members_cost_what_they_are(spark):
    core = [f"c{k}" for k in range(70)]
    # all share a passage of 66 shingles of 100 or so, none is linked with another
    docs = [(k, " ".join(core + [f"own{k}x{j}" for j in range(34)])) for k in range(6000)]
    docs.append((6000, docs[17][1] + " tail"))
    began = time.time()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {**{k: k for k in range(6000)}, 6000: 17}
    assert time.time() - began < 120


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_fine_pairs_lose_no_link(spark, percent):
    rng = random.Random(percent)
    sets = [frozenset(rng.sample(range(60), rng.randint(1, 40))) for _ in range(60)]
    for _ in range(140):
        s = set(rng.choice(sets))
        for _ in range(rng.randint(0, 4)):
            s ^= {rng.randint(0, 60)}
        sets.append(frozenset(s or {1}))
    rows = [(i, bytearray(np.array(sorted(s), np.uint64).tobytes()), i) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, set binary, label long")
    got = {frozenset(r) for r in near_dup._fine_pairs(df.select("id", "set"), df.select("id", "label"), percent).collect()}
    want = {frozenset((i, j)) for i in range(200) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 30


def test_texts_of_the_same_parts_make_few_pairs(spark):
    """Each text is 10 of 20 stock paragraphs in some order: all share much with all, and almost none are linked."""
    rng = random.Random(9)
    stock = [" ".join(f"p{p}w{k}x{rng.randrange(10**6)}" for k in range(30)) for p in range(20)]
    texts = [rng.sample(range(20), 10) for _ in range(7990)]
    texts += [t[:9] + [x for x in range(20) if x not in t][:1] for t in texts[:10]]
    made = {}
    for n in (2000, 4000, 8000):
        use = texts[-n:]
        data = [" ".join(stock[p] for p in t).encode() for t in use]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        sets = list(near_dup.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets))
        df = spark.createDataFrame([(i, bytearray(s.tobytes()), i) for i, s in enumerate(sets)], "id long, set binary, label long").repartition(8)
        pairs = {frozenset(r) for r in near_dup._fine_pairs(df.select("id", "set"), df.select("id", "label"), 85).collect()}
        made[n] = len(pairs)
        by_parts: dict = {}
        for i, t in enumerate(use):
            by_parts.setdefault(frozenset(t), []).append(i)
        for group in by_parts.values():
            for i in group:
                for j in group:
                    both = len(np.intersect1d(sets[i], sets[j])) if i < j else 0
                    if i < j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                        assert frozenset((i, j)) in pairs
    # pairs of texts of the same parts, whose number grows as the square, are a handful among 32 million
    assert made[8000] < 800, made


def test_repeated_kept_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words here", "z"), (3, None, "n"), (None, None, "n")], "doc_id long, text string, c string")
    assert sorted((r.doc_id or -1, r.c) for r in near_dup.one_of_each(df).collect() if r.doc_id != 1) == [(-1, "n"), (2, "z"), (3, "n")]
    assert near_dup.one_of_each(df).where("doc_id = 1").count() == 1


def test_long_texts(spark):
    rng = random.Random(2)
    long = [f"v{rng.randint(0, 5000)}" for _ in range(30_000)]
    other = list(long)
    for k in range(0, 30_000, 500):
        other[k] = "changed"
    check(spark, [(5, " ".join(long)), (6, " ".join(other)), (7, " ".join(long[:20_000])), (8, "short text")])
