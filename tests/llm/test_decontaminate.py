import random
import re
import time

from labelmill.llm.decontaminate import contamination, uncontaminated

W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    ws, hit, found = words(text), set(), set()
    for i, t in items:
        ts = words(t)
        if not ts:
            continue
        n = min(10, len(ts))
        windows = {tuple(ts[k : k + n]) for k in range(len(ts) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(ws), len(hit), sorted(found), hit


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(d, b, **kw).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        n, h, found, hit = brute(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, h, found), (i, t)
        assert {w for s in got[i].spans for w in range(s.first, s.end)} == hit
    clean = {r.doc_id for r in uncontaminated(d, b, **({"block_words": kw["block_words"]} if "block_words" in kw else {})).collect()}
    assert clean == {i for i in got if got[i].n_hit == 0}


def test_small_cases(spark):
    base = " ".join(f"t{i}" for i in range(30))
    items = [(1, base), (2, "short item HERE"), (3, "one"), (4, None), (5, ""), (6, " ".join(f"t{i}" for i in range(5, 15))), (7, "a a a a a a a a a a a a"), (8, "?!")]
    docs = ["", None, "x " + base, base, "t5 t6 t7 t8 t9 t10 t11 t12 t13", "t5-T6 t7 t8 t9 t10 t11 t12 t13 t14", "Short, item: here one", "a " * 30, base + " . " + base, "t0 t1 t2 t3 t4 t5 t6 t7 t8 t8 t9 t10 t11", "éa b"]
    run(spark, docs, items)
    run(spark, docs, items, block_words=20)


def test_random_overlaps(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for i in range(12)]
    docs = []
    for _ in range(80):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))]
        t = words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(t) - 1))
        parts.append(" ".join(t[a : a + rng.randint(5, 14)]))
        parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))))
        docs.append(" ".join(parts))
    run(spark, docs, items)


def test_no_benchmark_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(d, b).collect()] == [0, 0]
    assert contamination(d.limit(0), b).count() == 0
    b = spark.createDataFrame([(1, "a b"), (2, "b")], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, b, block_words=1).collect()] == [(1, 2, 2, ["1", "2"])] * 2


def test_common_passages_cost_no_product(spark):
    prompt = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"{prompt} own{i} words{i} of{i} item{i}") for i in range(20_000)]
    docs = [" . ".join([prompt] * 10_000), "short " + prompt, "p1 p2 p3 p4 p5 p6 p7 p8 p9", f"{prompt} own7 words7 x"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in contamination(d, b).selectExpr("doc_id", "n_hit", "size(items) n", "spans").collect()}
    assert time.time() - began < 20
    assert [(got[i].n_hit, got[i].n) for i in range(4)] == [(140_000, 20_000), (14, 20_000), (0, 0), (16, 20_000)]
    assert len(got[0].spans) == 1


def test_long_texts_by_both_ways(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))) for i in range(30)] + [(99, "w1 w2"), (98, "w3")]
    long = " ".join(rng.choice([f"w{rng.randint(0, 400)}", f"{rng.choice(items)[1]}"]) for _ in range(900))
    run(spark, [long, long.upper() + "!", None, "w3"], items)
    run(spark, [long, long.upper() + "!", None, "w3"], items, block_words=50)
