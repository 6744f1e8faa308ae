import hashlib
import random
import re

from labelmill.llm.infill import Infilling, count_units, ends_of, fill_in_middle, infill_digest, restored

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(UNITS, text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return text, n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h4 % 100 < 80:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", n, "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", n, "psm", len(prefix), len(middle)


CASES = [None, "", " ", "\n\t \r", "one", " lead", "trail  \n", "a<P>b", "x <S", "<M>", "< P> <", "é 𝄞 x  y", "<P <S <M " * 9, "\x1c\x1d\x85 w", "a\x0b\x0cb"]


def test_equals_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + CASES * 8
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(None, "a b c", 9, "x"), (3, texts[3], 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = sorted(((r.doc_id, r.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.restored) for r in fill_in_middle(df, prove=True).collect()), key=str)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t, *_ in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_digest_of_nothing_and_of_other_columns(spark):
    df = spark.createDataFrame([], "doc_id string, text string, output_sha256 int")
    assert infill_digest(df).count() == 0
    row = infill_digest(spark.createDataFrame([("k", None, 1)], df.schema)).first()
    assert (row.n, row.form, row.prefix_chars, row.output_sha256) == (0, "plain", None, hashlib.sha256(b"").hexdigest())


def test_long_texts_and_blank_runs(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["w", "ü", "longer"]) for _ in range(400_000)) + " " * 1_000_000
    df = spark.createDataFrame([(i, t) for i, t in enumerate([long, "x" * 3_000_000, " " * 3_000_000, "\n" * 500_000 + "end"] * 2)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in fill_in_middle(df, prove=True).collect():
        assert (r.output, r.n, r.form, r.prefix_chars, r.middle_chars) == brute(r.doc_id, texts[r.doc_id]) and r.restored == texts[r.doc_id]


def test_walks_hold_no_units():
    import tracemalloc

    text = "ab " * 300_000
    tracemalloc.start()
    assert count_units(text) == 300_001 and ends_of(text, 5, 299_999) == (14, 899_996)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_restoring_with_marks_cut_by_boundaries():
    how = Infilling(percent=100)
    for form, output in (("psm", "<P>a <<S>P> b<M> <S"), ("spm", "<S>P> b<P>a <<M> <S")):
        assert restored(output, form, how) == "a < <SP> b"
