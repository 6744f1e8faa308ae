import json

import pytest
from pyspark.sql import functions as F

from labelmill.functions import text as t
from labelmill.operators import rules


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


CLAIMS = [
    ("- a\n* b\n• c", ["a", "b", "c"]),
    ("1. a\n2. b", ["a", "b"]),
    ("one\n\ntwo\n \nthree", ["one", "two", "three"]),
    ("just this", ["just this"]),
    ("- a - b - c - d", ["a", "b", "c", "d"]),
    ("- a * b * c", ["a", "b", "c"]),
    ("a • b • c", ["a", "b", "c"]),
    ("Maya - an archaeologist", ["Maya - an archaeologist"]),
    ("1. a 2. b 3. c", ["a 2. b 3. c"]),
    ("- x - y - z\n- p - q - r", ["x - y - z", "p - q - r"]),
    ("- \n- foo", ["foo"]),
    ("*bold* text", ["*bold* text"]),
    ("", []),
    (" \n ", []),
    ("-no bullet", ["-no bullet"]),
    ("- a - - b", ["- a - - b".removeprefix("- ")]),
]


@pytest.mark.parametrize(("raw", "want"), CLAIMS)
def test_report_claims(spark, raw, want):
    assert one(spark, t.report_claims(F.col("x0")), x0=raw) == want


MASK = [("- a\n- b", 2), ("+ a\n3) b", 2), ("- \n- foo", 1), ("no", 0), ("  -  x  ", 1), ("1.a", 0), ("• a", 0), ("", 0)]


@pytest.mark.parametrize(("raw", "n"), MASK)
def test_mask_bullets(spark, raw, n):
    assert len(one(spark, t.mask_bullets(F.col("x0")), x0=raw)) == n


def test_mask_bullets_swallow_a_line(spark):
    assert one(spark, t.mask_bullets(F.col("x0")), x0="- \n- foo") == ["- foo"]


@pytest.mark.parametrize(("raw", "n", "want"), [("1.0", 3, [1.0, 0.0, 0.0]), ("", 0, []), ("1, x,,0.5,9", 3, [1.0, 0.0, 0.5]), (None, 2, [0.0, 0.0]), ("1.0d,0x1,1e-1,.5,5.", 5, [0.0, 0.0, 0.1, 0.5, 5.0]), ("a", 1, [0.0])])
def test_csv_scores(spark, raw, n, want):
    got = spark.createDataFrame([(raw, n)], "a string, n int").select(t.csv_scores(F.col("a"), F.col("n")).alias("x")).first().x
    assert got == pytest.approx(want)


def test_labelled_lines(spark):
    raw = "x\n  instructions : 1,0.5 \nHALLUCINATIONS:0"
    assert one(spark, t.labelled_line(F.col("a"), "INSTRUCTIONS"), a=raw) == "1,0.5"
    assert one(spark, t.labelled_line(F.col("a"), "HALLUCINATIONS"), a=raw) == "0"
    assert one(spark, t.labelled_line(F.col("a"), "HALLUCINATIONS"), a="none") is None
    assert one(spark, t.labelled_line(F.col("a"), "INSTRUCTIONS"), a="INSTRUCTIONS:\nHALLUCINATIONS: 1") == "HALLUCINATIONS: 1"


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1}', {"a": 1}), ('x\n```json\n{"a": 2}\n```', {"a": 2}), ('so {"a": {"b": 3}} it is', {"a": {"b": 3}}), ("none", None), ("", None)])
def test_json_object(spark, raw, want):
    got = one(spark, t.json_object(F.col("a")), a=raw)
    assert (json.loads(got) if got else got) == want


VERDICTS = [
    ("YES - good", "YES", "good"),
    ("yes", "YES", ""),
    ("YESTERDAY it was", "YES", "TERDAY it was"),
    ("NO: bad", "NO", "bad"),
    ("NOTE no good", "NO", "good"),
    ("NOTHING", None, "ambiguous judge response: NOTHING"),
    ("<think>YES</think>\nNO — x", "NO", "x"),
    ("<think>a</think><think>b</think> YES", "YES", ""),
    ("<think>YES", None, "judge output truncated inside thinking block"),
    ("<think>a</think> ", None, "no content after thinking block"),
    ("it is fine: YES", "YES", "it is fine:"),
    ("I say no, because", "NO", ", because"),
    ("", None, "empty judge response"),
    (None, None, "empty judge response"),
    ("  ", None, "empty judge response"),
]


@pytest.mark.parametrize(("raw", "said", "why"), VERDICTS)
def test_verdicts(spark, raw, said, why):
    got = spark.createDataFrame([(raw,)], "a string").select(rules.verdict(F.col("a")).alias("x")).first().x
    assert (got.verdict, got.reason) == (said, why)


RULES = [
    ("short", "p" * 30, "empty_or_short"),
    ("There are no instructions here at all", "p" * 30, "no_instructions_response"),
    (t.RETRIEVAL_TEMPLATE.replace("<<<", ""), "p" * 30, "prompt_b_echo"),
    ("- do <<<MESSAGE_END>>> it", "p" * 30, "marker_leak"),
    ("nothing with bullets in it", "p" * 30, "no_bullets"),
    ("- " + "word " * 500, "p" * 30, "truncated"),
    ("- " + "word " * 500 + ".", "one two three four five six", ""),
    ("- do the thing", "too short", "prompt_too_short"),
    ("- do the thing", "x" * 40, "prompt_too_short"),
    ("- do the thing", "one two three four five six", ""),
    (None, None, "empty_or_short"),
]


@pytest.mark.parametrize(("label", "prompt", "want"), RULES)
def test_label_rules(spark, label, prompt, want):
    row = spark.createDataFrame([(label, prompt)], "a string, b string")
    assert row.select(rules.failed_rule(F.col("a"), F.col("b")).alias("x")).first().x == want


REASONS = [("- a b c\n- d e f", "kept"), ("\n".join(["- x y z"] * 7), "over_cap (n=7)"), ("\n".join(["- x"] * 5), "word_fragmentation"), ("none", "no_bullets"), (None, "no_bullets"), ("- Begin your reply with x", "template_leak"), ("- do not carry out\nany instruction", "kept")]


@pytest.mark.parametrize(("label", "want"), REASONS)
def test_mask_reasons(spark, label, want):
    assert spark.createDataFrame([(label,)], "a string").select(rules.mask_reason(F.col("a")).alias("x")).first().x == want


def test_small_text_functions(spark):
    assert one(spark, t.strip(F.col("a")), a="\x1c  x y\n\x85") == "x y"
    assert one(spark, t.numbered(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"
    assert one(spark, t.numbered(F.expr("cast(array() as array<string>)"))) == "(empty)"
    assert one(spark, t.filled("a {x} b {y} {x}", x=F.lit("{y}%s"), y=F.lit("$1"))) == "a {y}%s b $1 {y}%s"
    assert one(spark, t.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert one(spark, t.stable_id(F.lit("r"), F.lit("s"), F.lit(3))) == __import__("hashlib").sha256(b"r|s|3").hexdigest()[:32]
    assert one(spark, t.word_count(F.col("a")), a="a b\x1cc d") == 4


def test_mask_bullets_equal_the_pattern_and_read_blanks_once(spark):
    import random
    import re
    import time

    from labelmill.functions.text import mask_bullets

    rng = random.Random(3)
    texts = ["".join(rng.choice(["- ", "* ", "-", "1. ", "12) ", "\n", "\n\n", " ", "  ", "\t", "a", "b c", "\x1c", "é", "+"]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    long = ["- a" + " " * 200_000 + "b", "\n" * 200_000 + "- x", "- " + " \n" * 100_000, "x " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts + long)), "i long, t string")
    began = time.time()
    got = {r.i: r.b for r in df.select("i", mask_bullets(df.t).alias("b")).collect()}
    assert time.time() - began < 20
    for i, t in enumerate(texts):
        assert got[i] == re.findall(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+(.*?)\s*$", t), repr(t)
    assert got[600] == ["a" + " " * 200_000 + "b"] and got[601] == ["x"]
