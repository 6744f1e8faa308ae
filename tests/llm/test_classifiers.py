import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from labelmill.llm import quality_model
from labelmill.llm.arrays import text_bytes
from labelmill.llm.labelled import Logistic, labelled_sample
from labelmill.llm.quality_model import quality_scores
from labelmill.llm.toxicity import ClassModels, _counted, spellings, toxicity_scores


def made(spark, kind, n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    stems = ["vequx", "grubo"]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        y = rng.random() < 0.3
        if kind == "toxic" and y:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(stems) + "".join(rng.choice("abcde") for _ in range(2))
        if kind == "quality" and not y:
            t = [w.upper() + "!!" for w in t]
        docs.append((i, " ".join(t), "en", 0.5))
        if rng.random() < 0.8:
            labels.append((i, int(y), int(y)))
    docs += [(n, None, None, None), (n + 1, "", "en", 0.1), (n + 2, "  \n", None, 0.2), (n + 2, "  \n", None, 0.2), (None, "words without id", None, None), (n + 3, "w " * 50000, None, None)]
    labels += [(n + 900, 1, 1), (None, 0, 0), (5, None, None), (n, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("kind", "score", "folds", "held"), [("toxic", toxicity_scores, 4, 2), ("quality", quality_scores, 5, 0)])
def test_held_out_accuracy(spark, kind, score, folds, held):
    docs, labels = made(spark, kind)
    got = score(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[kind] for r in labels.collect() if r.doc_id is not None and r[kind] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % folds == held)
    tried = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert len(tried) > 40 and sum(a == b for a, b in tried) >= 0.95 * len(tried)


def test_without_labels_or_rows(spark):
    docs, labels = made(spark, "toxic", 5)
    for score in (toxicity_scores, quality_scores):
        assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
        assert score(docs.limit(0), labels).count() == 0


def test_spellings_and_unknown_words():
    data, offsets = text_bytes(pa.array(["Éàçdèfg ab é", "éàçdè éàçd"]))
    rows, keys = spellings(data, offsets)
    assert rows.tolist() == [0, 0, 0, 1, 1]
    data, offsets = text_bytes(pa.array(["éàçdèzz ab"]))
    other = spellings(data, offsets)[1]
    assert other[1, 0] == keys[1, 0] and other[0, 0] != keys[3, 0] and len({keys[3, 1], other[0, 1]}) == 1
    h = [x for x in keys[:, 0].view("int64")]
    table = pa.table({"h": h, "h5": keys[:, 1].view("int64"), "h4": keys[:, 2].view("int64"), "t": [3, 0, 1, 0, 0], "o": [0, 5, 1, 2, 2]})
    models = ClassModels(table)
    assert models.ratios(keys)[0] > 0 > models.ratios(keys)[1]
    unknown = spellings(*text_bytes(pa.array(["qqqqqqq"])))[1]
    assert models.ratios(unknown)[0] == 0.0


def mixed(counts, lower):
    """Probabilities of both classes, as the module says, from counts by class."""
    n = sum(sum(c.values()) for c in counts)
    taken = min(0.75 * sum(1 for c in counts for x in c.values() if x) / max(n, 1), 1)
    out = []
    for c, low in zip(counts, lower):
        kept = {k: max(c[k] - 0.75, 0) for k in low}
        total = sum(kept.values())
        out.append({k: (1 - taken) * kept[k] / total + taken * low[k] if total else low[k] for k in low})
    return out


def brute_ratios(train, text):
    """(log ratio of each word of text by itself, and after the word before it)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    n, pairs = (Counter(), Counter()), (Counter(), Counter())
    for t, y in train:
        ws = cut(t)
        n[1 - y].update(ws)
        pairs[1 - y].update(zip([None, *ws], ws))
    vocabulary = set(n[0]) | set(n[1])
    firsts5 = {w: w[:5] for w in vocabulary}
    firsts4 = {p: p[:4] for p in firsts5.values()}
    all5, all4 = Counter(firsts5.values()), Counter(firsts4.values())
    types5 = [Counter(firsts5[w] for w in vocabulary if c[w]) for c in n]
    types4 = [Counter(firsts4[p] for p in all5 if c[p]) for c in types5]
    shared = {p: (all4[p] + 0.5) / (sum(all4.values()) + 0.5 * (len(all4) + 1)) for p in all4}
    p4 = mixed(types4, [shared, shared])
    p5 = mixed(types5, [{p: x[firsts4[p]] / (all4[firsts4[p]] + 1) for p in all5} for x in p4])
    below = [{w: x[firsts5[w]] / (all5[firsts5[w]] + 1) for w in vocabulary} for x in p5]
    p = mixed(n, below)
    q = mixed([Counter(b for _, b in c) for c in pairs], below)
    often = {k for k in set(pairs[0]) | set(pairs[1]) if pairs[0][k] + pairs[1][k] >= 2}
    alone, after = [], []
    ws = cut(text)
    ratio = lambda a, b: max(-6.0, min(6.0, math.log(a / b)))
    for v, w in zip([None, *ws], ws):
        if w in vocabulary:
            alone.append(ratio(p[0][w], p[1][w]))
            low = [x[w] for x in q]
        else:
            level = p5 if w[:5] in p5[0] else p4
            key = w[:5] if w[:5] in p5[0] else w[:4]
            low = [x[key] for x in level] if key in level[0] else [1, 1]
            alone.append(ratio(*low))
        both, lefts = [], []
        for c, x in zip(pairs, low):
            total = sum(m for (a, _), m in c.items() if a == v)
            given = {b: max(m - 0.75, 0) for (a, b), m in c.items() if a == v and (a, b) in often}
            left = 1 - sum(given.values()) / total if total else 1.0
            lefts.append(left)
            both.append((given.get(w, 0) / total if total else 0) + left * x)
        if (v, w) in often:
            after.append(ratio(*both))
        else:
            known = v is None or v in vocabulary
            after.append(max(-6.0, min(6.0, (math.log(lefts[0] / lefts[1]) if known else 0.0) + ratio(*low))))
    return alone, after


def test_class_models_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    train = [(" ".join(rng.choice(words[: 50 if y else 60]) for _ in range(rng.randint(1, 60))), y) for y in [1, 0, 0] * 20]
    sample = spark.createDataFrame(train, "text string, y int").repartition(3)
    models = ClassModels(*_counted(sample))
    texts = [" ".join(rng.choice([*words, "abéab", "bbbbbbb", "aaaaxx", "zzz", "abéa"]) for _ in range(40)) for _ in range(12)] + ["", words[0]]
    rows, keys = spellings(*text_bytes(pa.array(texts)))
    alone, after = models.pair_ratios(keys, rows)
    want = [brute_ratios(train, t) for t in texts]
    assert alone.tolist() == pytest.approx([x for a, _ in want for x in a], abs=1e-9)
    assert after.tolist() == pytest.approx([x for _, b in want for x in b], abs=1e-9)


def test_expressions_of_ordinary_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        y = i % 3 == 0
        for k in range(0, 60, 10):
            # toxic texts have these words side by side, others have them apart
            t[k : k + (2 if y else 6)] = [words[0], words[1]] if y else [words[1], *t[k + 1 : k + 5], words[0]]
        docs.append((i, " ".join(t)))
        labels.append((i, int(y)))
    got = toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert len(got) > 150 and sum(r.predicted == (r.doc_id % 3 == 0) for r in got) >= 0.95 * len(got)


def test_compression_scores_equal_brute_force(spark):
    docs, labels = made(spark, "quality", 150)
    sample = labelled_sample(docs, labels, "quality", 5, 0, 3000)
    rows = sample.selectExpr("text", "y", "part", "xxhash64(text) as h").orderBy("h").collect()
    train = {y: [r.text.encode() for r in rows if r.part == 0 and r.y == y] for y in (1, 0)}
    coders = []
    for y in (1, 0):
        parts = [t[k : k + 2048] for t in train[y] for k in range(0, len(t), 2048)]
        try:
            data = zstandard.train_dictionary(1 << 16, parts, level=1).as_bytes()
            trained = zstandard.ZstdCompressionDict(data)
        except zstandard.ZstdError:
            trained = zstandard.ZstdCompressionDict(b"".join(parts)[-(1 << 16) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append(zstandard.ZstdCompressor(level=1, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(text):
        data = (text or "").encode()
        good, bad = (sum(len(c.compress(data[k : k + 2048])) for k in range(0, len(data), 2048)) for c in coders)
        return [(bad - good) / max(good + bad, 1), (bad - good) / max(len(data), 1), min(good, bad) / max(len(data), 1), math.log1p(len(data))]

    fit = [r for r in rows if r.part == 1]
    curve = Logistic(np.array([features(r.text) for r in fit]), np.array([float(r.y) for r in fit]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_scores(docs, labels).collect():
        x = features(texts[r.doc_id])
        assert r.size_difference == pytest.approx(x[0], abs=1e-12) and r.score == pytest.approx(float(curve(np.array([x]))[0]), abs=1e-9)
    fewer = quality_model.quality_scores(docs, labels, training_bytes=5000).count()
    assert fewer == docs.count()


def test_logistic_curve_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 7.0]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    curve = Logistic(x, y)
    z = np.column_stack([np.ones(400), (x - x.mean(axis=0)) / x.std(axis=0)])
    slope = z.T @ (y - curve(x)) - np.array([1e-3, 1, 1, 1]) * curve.weights
    assert np.abs(slope).max() < 1e-6
