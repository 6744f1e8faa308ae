import random
import re
from collections import Counter

from labelmill.llm.quality_rules import keep_by_rules, repetition_stats

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    ws = re.findall(W, text)
    lines = [x for x in text.split("\n")]
    dup = [x for i, x in enumerate(lines) if re.search(W, x) and x in lines[:i]]
    out = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(dup)}
    out["dup_line_chars"] = sum(len(w) for x in dup for w in re.findall(W, x))
    for n in (3, 5, 6, 7, 8, 9, 10):
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        seen = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)}
        if n == 3:
            out["n_repeat_words"] = len(hit)
        else:
            hit = {i + k for i, g in enumerate(grams) if g in set(grams[:i]) for k in range(n)} if max(seen.values(), default=0) > 1 else set()
            out[f"dup_{n}"] = sum(len(ws[i]) for i in hit)
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    return out


CASES = ["", None, " \n ", "a b c a b c", "line one\nline one\n\n\nline one\nother", "one two three four five six " * 30, "Ünï cödé words é " * 3 + "tail", "# * | < > & % $ x", " ".join(f"w{i}" for i in range(80)), "\n".join(["same text here"] * 40)]


def test_equals_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + CASES
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r.doc_id: r.asDict() for r in repetition_stats(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (i, t)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept boolean")
    assert repetition_stats(df).count() == 0
    good = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, "c"), (1, good, "c"), (2, None, "c"), (3, "spam ham " * 60, None)], "doc_id long, text string, kept string")
    assert [tuple(r) for r in keep_by_rules(df).collect()] == [(1, good, "c"), (1, good, "c")]
    assert repetition_stats(df).count() == 4


def test_very_long_texts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(9000)]
    passage = [rng.choice(words) for _ in range(400)]
    long = [rng.choice(words) for _ in range(250_000)]
    for at in (10_000, 90_000, 170_000):
        long[at : at + 400] = passage
    text = " ".join(long[:200_000]) + "\n" + "\n".join(" ".join(long[k : k + 20]) for k in range(200_000, 250_000, 20)) + "\n" + "x" * 1_500_000 + "\n" + "x" * 1_500_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition_stats(df).collect()}[1]
    ws = re.findall(W, text)
    assert got.n_words == len(ws) and got.word_chars == sum(map(len, ws)) and got.n_dup_lines == 1 and got.dup_line_chars == 1_500_000
    for n in (5, 10):
        seen, hit = set(), set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in seen:
                hit.update(range(i, i + n))
            seen.add(g)
        assert got[f"dup_{n}"] == sum(len(ws[i]) for i in hit)


def test_lines_that_sums_of_powers_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a + "\n" + b), (2, a + "\n" + a)], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in repetition_stats(df).collect()} == {1: 0, 2: 1}


def test_repetition_decides(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fresh = lambda n: " ".join(word() for _ in range(n))
    paragraph, line = fresh(48), fresh(12)
    rows = {
        # a quarter of the text is a paragraph that stood in it before: the base rule doesn't mind, repetition does
        "paragraph twice": (f"{fresh(50)}\n{paragraph}\n{fresh(46)}\n{paragraph}", False),
        "paragraph inside a line": (f"{fresh(50)} {paragraph} {fresh(46)} {paragraph}", False),
        "lines again": ("\n".join([line, fresh(20), line, fresh(20), line]), False),
        "paragraph once": (f"{fresh(50)}\n{paragraph}\n{fresh(94)}", True),
        "first and last line alike": (f"{fresh(8)}\n" + fresh(60) + "\n" + fresh(8), True),
        "heading again at the end": ("\n".join([h := fresh(8), fresh(60), h]), True),
        "symbols": (" ".join(f"{word()}%%%" for _ in range(80)), True),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in repetition_stats(df).collect()}
    assert {k: r.kept for k, r in got.items()} == {k: want for k, (_, want) in rows.items()}
    assert not any(r.base_failed for r in got.values()) and [k for k, r in got.items() if r.symbols_failed] == ["symbols"]
    assert {r.doc_id for r in keep_by_rules(df).collect()} == {k for k, (_, want) in rows.items() if want}
