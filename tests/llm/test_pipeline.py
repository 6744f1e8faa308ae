import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as components
from tests.llm.test_pii import brute as personal
from tests.llm.test_quality_rules import brute as repetition


def kept_by_rules(text):
    b = repetition(text)
    total = max(1, b["word_chars"])
    bad = b["dup_line_chars"] > 0.20 * total
    bad = bad or any(b[f"dup_{n}"] > share * total for n, share in {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}.items())
    return not b["base_failed"] and not bad


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 120))) for _ in range(60)]
    docs += [docs[0], docs[1] + " tail", docs[2].replace("w1", "W1"), docs[3]]
    docs += ["spam ham eggs " * 60, " ".join(f"{w}%%%" for w in docs[4].split()), "short", None, "", "line one two\n" * 30]
    items = [" ".join(docs[7].split()[5:25]), "never seen " * 8]
    docs += ["mail jo@x.org and +1 (555) 555-0100 or 10.1.2.3 " + docs[8]]
    rows = [(i, t, "en", "s0" if i % 3 else None, len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in enumerate(docs) if kept_by_rules(t)]
    label = components(left)
    left = [(i, t) for i, t in left if label[i][2]]
    left = [(i, t) for i, t in left if not contaminated(t, list(enumerate(items)))[1]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in left} and len(got) > 40
    assert all(r.exact and r.n_ids == len(r.ids) > 0 for r in got.values())

    stage = dict(corpus_pipeline.STAGES)
    given = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in left], "doc_id long, text string, lang string, source string, n_chars long")
    clean = {r.doc_id: r for r in stage["personal_data"](spark, given, str(tmp_path)).collect()}
    for i, t in left:
        if not personal(t):
            assert clean[i].text == t
        assert not any(t[a:b] in clean[i].text for _, a, b in personal(t)) and clean[i].n_chars == len(clean[i].text)
    assert re.match("mail <EMAIL> and <PHONE> or <IP> ", clean[max(i for i, _ in left)].text)


def test_stages_of_nothing_and_extra_columns(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string"
    for name, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame([], schema)
        assert stage(spark, given, sf).count() == 0, name
    one = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(70)), None, None, None, None, "old"), (1, " ".join(f"x{i}" for i in range(70)), None, None, None, None, "old")], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, one, sf)
        assert out.columns == one.columns and out.count() == (1 if name == "near_duplicates" else 2), name
    assert [tuple(x) for x in corpus_pipeline.STAGES[-1][1](spark, one, sf).select("doc_id", "exact").collect()] == [(1, True)] * 2


def test_pii_stage_is_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.personal_data(spark, docs, sf).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_near_duplicates_from_four_fifths(spark, sf):
    rng = random.Random(4)
    texts = []
    for k in range(20):
        words = [f"v{k}x{rng.randrange(10**6)}" for _ in range(160)]
        # each changed word is in five of 156 shingles: three give 141 of 171 (0.82), four 136 of 176 (0.77)
        for changed in ((), (30, 80, 130), (20, 60, 100, 140)):
            texts.append(" ".join("new" + w if i in changed else w for i, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert got == {i for i in range(60) if i % 3 != 1} == {i for i, x in components(list(enumerate(texts)), percent=80).items() if x[2]}


def test_personal_data_stage_marks_terms(spark, sf):
    fresh = lambda k: " ".join(f"v{k}x{j}" for j in range(20))
    texts = [f"{fresh(i)} Zanzibar wrote from jo@x.org" for i in range(4)] + [f"{fresh(i)} wrote from u{i}@h{i}.net" for i in range(4, 16)] + ["zanzibar again"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(corpus_pipeline.STAGES)["personal_data"](spark, df, sf).collect()}
    want = [t.replace("Zanzibar", "<TERM>").replace("zanzibar", "<TERM>") for t in texts]
    want = [re.sub(r"\S+@\S+", "<EMAIL>", t) for t in want]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
