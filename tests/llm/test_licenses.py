import random
import re
import time

import pytest

from labelmill.llm.licenses import PHRASES, TEMPLATES, license_spans
from labelmill.llm.queries import op6_diagonal_voting

W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text):
    ws = words(text)
    return len(ws), sorted((label, i, i + len(p)) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p)


MIT = next(t for t, label in TEMPLATES.items() if label == "mit")
CASES = [None, "", "?!", "one", "MIT License", "mit license mit-license. The Apache\nLicense and general public license public license", "general public", "mit éx license", "x general general public license", "All rights reserved.", MIT, " ".join(w for i, w in enumerate(MIT.split()) if i not in (7, 8, 15)), "extra " + MIT.replace("to any person", "now to every single person") + " tail", "MİT License", "the Kelvin K", MIT.split(" obtaining")[0], "mit license " * 400]


def test_base_places_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + CASES
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in license_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, base = places(t)
        assert got[i].n_words == n and sorted((s.label, s.first, s.end) for s in got[i].spans if s.base) == base, t
        assert all(0 < s.share <= 1.0 and 0 <= s.first < s.end <= n for s in got[i].spans)
    labels = {k: {s.label for s in got[len(texts) - len(CASES) + k].spans} for k in range(len(CASES))}
    assert labels[9] == {"notice"} and labels[10] == labels[11] == labels[12] == {"mit"} and labels[15] == set()


def test_repeated_rows_empty_table_and_plan(spark, sf):
    df = spark.createDataFrame([(1, "the mit license"), (1, "the mit license"), (1, None), (None, "x"), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, len(r.spans)) for r in license_spans(df).collect()) == [(0, 1, 0), (1, 0, 0), (1, 3, 1), (1, 3, 1), (2, 0, 0), (2, 0, 0)]
    assert license_spans(df.limit(0)).count() == 0
    plan = op6_diagonal_voting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def brute_spans(text, templates, least=0.6, near=6):
    """(label, first, end, share) of templates: votes by diagonal, diagonals that lie close together as one span."""
    ws, out = words(text), []
    for t, label in templates.items():
        of = words(t)
        votes = {}
        for q in range(len(of) - 2):
            for p in range(len(ws) - 2):
                if ws[p : p + 3] == of[q : q + 3]:
                    votes.setdefault(p - q, set()).add(q)
        groups = []
        for d in sorted(votes):
            if not groups or d - groups[-1][-1] > near:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            found = {q + j for d in g for q in votes[d] for j in range(3)}
            if len(found) / len(of) >= least:
                out.append((label, min(d + min(votes[d]) for d in g), max(d + max(votes[d]) + 3 for d in g), round(len(found) / len(of), 9)))
    return sorted(out)


def test_method_equals_brute_force(spark):
    rng = random.Random(4)
    notices = list(TEMPLATES)
    texts = list(CASES)
    for _ in range(60):
        ws = rng.choice(notices).split()
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randint(0, 2)] = [rng.choice(["put", "in", "other", "software"])] * rng.randint(0, 2)
        texts.append(" ".join(["before", *ws, "after", *(rng.choice(notices).split()[: rng.randint(0, 40)])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: sorted((s.label, s.first, s.end, round(s.share, 9)) for s in r.spans if not s.base) for r in license_spans(df).collect()}
    want = {i: brute_spans(t, TEMPLATES) for i, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 40
    table = spark.createDataFrame([(t, label) for t, label in TEMPLATES.items()] * 2, "text string, label string")
    again = {r.doc_id: sorted((s.label, s.first, s.end, round(s.share, 9)) for s in r.spans if not s.base) for r in license_spans(df, templates=table).collect()}
    assert again == want


def test_labels_and_score_of_the_query(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in docs] + [(10**6 + k, t) for k, t in enumerate(CASES)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.base_labels, round(r.score, 9)) for r in op6_diagonal_voting(spark, str(tmp_path)).collect()}
    for i, t in texts:
        base = {label for label, _, _ in places(t)[1]}
        spans = brute_spans(t, TEMPLATES)
        score = max([1.0] * bool(base) + [s[3] for s in spans] + [0.0])
        assert got[i] == (",".join(sorted(base | {s[0] for s in spans})), ",".join(sorted(base)), score), t


def test_equal_hashes_are_not_enough(spark, monkeypatch):
    # all grams of a length share one hash here; only words tell them apart
    from pyspark.sql import functions as F

    from labelmill.llm import licenses

    monkeypatch.setattr(licenses, "_gram_hash", lambda k: F.when(F.col(f"gram.w{k - 1}").isNotNull(), F.lit(7).cast("long")))
    df = spark.createDataFrame([(1, "the mit license of all rights reserved and more"), (2, "nothing to be found here")], "doc_id long, text string")
    got = {r.doc_id: [(s.label, s.first, s.end) for s in r.spans] for r in license_spans(df).collect()}
    assert got == {1: [("mit", 1, 3), ("notice", 4, 7)], 2: []}


def test_time_grows_with_the_text(spark):
    texts = ["mit license " * 30_000, MIT + " x " + "all rights reserved " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    license_spans(df.limit(0)).count()
    began = time.time()
    got = {r.doc_id: r.n for r in license_spans(df).selectExpr("doc_id", "size(spans) as n").collect()}
    assert got[0] == 30_000 and got[1] >= 2 and time.time() - began < 30


def test_templates_have_a_bound(spark, monkeypatch):
    from labelmill.llm import licenses

    monkeypatch.setattr(licenses, "TEMPLATE_CHARS", 100)
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="more than 100"):
        license_spans(df, templates=spark.createDataFrame([("a b c" * 30, "l")], "text string, label string"))
    with pytest.raises(Exception, match="shorter"):
        license_spans(df, templates={"a b": "l"}).collect()
