import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from labelmill.llm.pii import KINDS, _merged, base_spans, personal_spans, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


CASES = [None, "", "a@b.c_d@e.f x", "a@b.c..d@e.f", "@@a@b", "a@b-.-c", "é a.b%+@x-y.zz. end", "1.2.3.4.5.6.7.8", "1.2.3.256 001.02.3.4 1.2.3", "255.255.255.255", "0000000000000000000000000000000000000000000001.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111--4111111111111111", "x4111111111111111 5 5 5", "4111 1111 1111 1111 1", "4111111111111111  4111111111111111 - 4111 1111-1111 1111", "+1 (555) 555-0100.", "+1", "+12345678", "+1234567", "+1 234 567 890 123 456", "++12 345 678 9+1 22 33 44 55", "𝄞𝄞 a@b.cc 𝄞 4111111111111111 𝄞 +49 30 1234567", "9" * 3000 + " 4111111111111111", "1 2 " * 3000, "a" * 3000 + "@b.cc", "a@b.cc " * 200, "a-" * 5000 + "@", "1." * 4000, "a@b" + ".c" * 20000 + " x", "a@b.cc x" * 3000, "+1 22 33 44 55, " * 700 + "4111 1111 1111 1111, " * 700]


def test_base_equals_the_patterns(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + CASES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in df.select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        assert [(s.kind, s.start, s.end) for s in r.s] == brute(texts[r.doc_id]), texts[r.doc_id][:200]


#: Other addresses, each once: without them one address would be all that there is of its kind.
OTHERS = [f"q{i} u{i}@h{i}.net" for i in range(8)]


def rows(spark):
    texts = [f"note {i} for zanzibar mail jo@x.org or call" for i in range(4)] + [f"for and mail or org only {i}" for i in range(9)] + [f"call me note {i}" for i in range(9)] + ["ip 1.2.3.4, 4111 1111 1111 1111 +1 4111 1111 1111", None, "", "a@b.cc", "zanzibar alone", *OTHERS]
    return texts, spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_disclosing_terms_and_sanitising(spark):
    texts, df = rows(spark)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "term"] == brute(t)
    term = [texts[0][a:b] for k, a, b in got[0] if k == "term"]
    assert term == ["zanzibar"]  # 4 of its 5 documents have it beside the address; for, mail, call and note are common
    assert [(i, texts[i][s[1] : s[2]]) for i in range(4, len(texts)) for s in got[i] if s[0] == "term"] == [(26, "zanzibar")]
    clean = {r.doc_id: (r.text, r.spans) for r in sanitised(df).collect()}
    assert clean[0] == ("note 0 for <TERM> mail <EMAIL> or call", "s")
    assert clean[22][0] == "ip <IP>, <CARD> <PHONE>" and clean[23][0] is None and clean[24][0] == "" and clean[25][0] == "<EMAIL>"
    assert clean[26][0] == "<TERM> alone"
    within = {r.doc_id: r.text for r in sanitised(df, everywhere=False).collect()}
    assert within[0] == clean[0][0] and within[26] == "zanzibar alone"


def test_repeated_rows_empty_table_and_plan(spark):
    df = spark.createDataFrame([(1, "a@b.cc x"), (1, "a@b.cc x"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in personal_spans(df).collect()) == [0, 1, 1]
    assert sanitised(df).count() == 3 and sanitised(df.limit(0)).count() == 0 and personal_spans(df.limit(0)).count() == 0
    plan = sanitised(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_disclosing_terms_everywhere(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    texts = [f"Zanzibar Li mail jo@x.org {filler} and ZANZIBAR again, zanzibars not. org" for _ in range(4)]
    texts += [f"mail and again and not of org k{i}" for i in range(9)] + [f"{filler} k{i}" for i in range(9)] + ["zanzibar alone, with li", "Li Éa", *OTHERS]
    texts[:4] = [f"{t} n{i}" for i, t in enumerate(texts[:4])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitised(df, disclosure=0.6).collect()}
    assert clean[0] == f"<TERM> <TERM> mail <EMAIL> {filler} and <TERM> again, <TERM> not. org n0"
    assert clean[22] == "<TERM> alone, with <TERM>" and clean[23] == "<TERM> Éa" and clean[4] == texts[4] and clean[13] == texts[13]
    within = {r.doc_id: r.text for r in sanitised(df, disclosure=0.6, everywhere=False, least_chars=3).collect()}
    assert within[0] == f"<TERM> Li mail <EMAIL> {filler} and <TERM> again, <TERM> not. org n0" and within[22] == texts[22]
    spans = {r.doc_id: r.spans for r in personal_spans(df, disclosure=0.6).collect()}
    assert [texts[0][s.start : s.end] for s in spans[0]] == ["jo@x.org", "Zanzibar", "Li", "ZANZIBAR", "zanzibars"]
    assert [(s.kind, s.start, s.end) for s in spans[22]] == [("term", 0, 8), ("term", 21, 23)]


def protected(text):
    """Entities of a text and their classes."""
    out = set()
    for k, a, b in brute(text):
        v, d = text[a:b].lower(), re.sub("[^0-9]", "", text[a:b])
        out |= {(k, v), (k, "*", {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:3]), "card": d[:6], "phone": d[:-4]}[k])}
    return out


def brute_terms(texts, support, disclosure, gain):
    """Spans of terms in each text, by counting over all texts, each once."""
    of_entity, of_kind, together, everywhere = Counter(), Counter(), Counter(), Counter()
    for t in {t or "" for t in texts}:
        left = list(t)
        for _, a, b in brute(t):
            left[a:b] = " " * (b - a)
        entities, terms = protected(t), {w.lower() for w in re.findall(WORDS, "".join(left))}
        of_entity.update(entities)
        of_kind.update({e[0] for e in entities})
        together.update((e, w) for e in entities for w in terms)
        everywhere.update({w.lower() for w in re.findall(WORDS, t)})
    told = {w for (e, w), n in together.items() if n >= support and n / everywhere[w] >= disclosure and math.log2(n / everywhere[w]) - math.log2(of_entity[e] / of_kind[e[0]]) >= gain}
    out = []
    for t in texts:
        base = brute(t)
        found = [(m.start(), m.end()) for m in re.finditer(WORDS, t or "") if m[0].lower() in told]
        out.append([x for x in found if not any(a < x[1] and x[0] < b for _, a, b in base)])
    return out


WORDS = "[0-9A-Za-z\x80-\U0010FFFF]+"


def test_terms_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] * 3
    rng = random.Random(3)
    for k in range(120):
        who = f"person{k % 9} family{k % 9}"
        texts.append(f"{who} wrote w{rng.randint(0, 30)} to p{k % 9}@mail.org, 10.0.0.{k % 9}; {who.upper()} and w{rng.randint(0, 30)}" if k % 4 else f"about person{k % 9} and w{k % 30}, W{k % 31}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # no address comes twice here, but all of a firm have its domain, its net or its exchange
    for k in range(60):
        texts.append(f"firm{k % 5}corp note {k} " + [f"a{k}@firm{k % 5}.com", f"192.168.{k % 5}.{k}", f"+1 555 0{k % 5} {1000 + k}"][k % 3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for support, disclosure, gain in ((3, 0.8, 1.0), (4, 0.3, 2.0)):
        want = brute_terms(texts, support, disclosure, gain)
        assert sum(map(len, want)) > 50
        got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in personal_spans(df, support=support, disclosure=disclosure, gain=gain).collect()}
        assert got == dict(enumerate(want))


def test_copies_are_one_witness_and_kinds_tell_nothing(spark):
    texts = ["secretword of jo@x.org and friends"] * 6 + [f"call us at u{i}@h{i}.net please" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # six copies are one text, and what stands beside addresses in general says nothing of anyone's
    assert not [s for r in personal_spans(df).collect() for s in r.spans if s.kind == "term"]
    one_domain = [f"write to u{i}@same.net, w{i}" for i in range(9)]
    assert not [s for r in personal_spans(spark.createDataFrame(list(enumerate(one_domain)), df.schema)).collect() for s in r.spans if s.kind == "term"]
    differing = [f"secretword {i} jo@x.org" for i in range(3)] + texts[6:]
    got = personal_spans(spark.createDataFrame(list(enumerate(differing)), df.schema)).collect()
    assert [(r.doc_id, differing[r.doc_id][s.start : s.end]) for r in got for s in r.spans if s.kind == "term"] == [(i, "secretword") for i in range(3)]


def test_time_grows_with_the_text(spark):
    def seconds(n):
        texts = [f"{' '.join(f'u{i}@host{i}.org' for i in range(n))} +1 22 33 44 55 end", "a@b" + ".c" * (20 * n), "1.2.3.4 " * n]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        began = time.time()
        rows = {r.doc_id: r.text for r in sanitised(df).collect()}
        assert rows[0] == " ".join(["<EMAIL>"] * n) + " <PHONE> end" and rows[1] == "<EMAIL>" and rows[2] == "<IP> " * n
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 30


def test_overlapping_spans_are_merged(spark):
    spans = [[("a", 5, 9), ("b", 0, 3), ("c", 8, 20), ("d", 20, 22), ("e", 6, 7)], [], [("x", i, i + 3) for i in range(0, 3000, 2)], [("x", i, i + 1) for i in range(0, 3000, 2)]]
    df = spark.createDataFrame([(i, [(k, a, b, "") for k, a, b in s]) for i, s in enumerate(spans)], "i long, s array<struct<kind: string, start: int, end: int, value: string>>")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", _merged(F.col("s")).alias("m")).collect()}
    assert got[0] == [(0, 3, "b"), (5, 20, "a"), (20, 22, "d")] and got[1] == [] and got[2] == [(0, 3001, "x")] and len(got[3]) == 1500


def test_base_columns_equal_sql(spark, sf):
    """Numbers of mail addresses and base spans of the query, against DuckDB."""
    import duckdb

    from labelmill.llm.queries import op7_disclosure_pii

    got = {r.doc_id: (r.n_email, r.n_phone) for r in op7_disclosure_pii(spark, sf).collect()}
    want = duckdb.sql(f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{PATTERNS["email"]}')),
        len(list_filter(regexp_extract_all(coalesce(text, ''), '{PATTERNS["phone"]}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) FROM '{sf}/documents.parquet'""").fetchall()
    assert got == {i: (a, b) for i, a, b in want}
